"""Tasks (task_id, depends_on, status, position) and the order their dependencies give. Rows without an id are no tasks; a repeated row counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1_000_000  # most tasks of one plan that are ordered on the driver; a plan is written by one author


def edges(tasks: DataFrame) -> DataFrame:
    """(task_id, needs) of dependencies on tasks that are there; others are ignored."""
    all_ = tasks.filter("task_id is not null").select("task_id", F.explode("depends_on").alias("needs")).distinct()
    return all_.join(tasks.select(F.col("task_id").alias("needs")), "needs", "left_semi").select("task_id", "needs")


def ready(tasks: DataFrame) -> DataFrame:
    """(task_id, position) of pending tasks all of whose known dependencies are done."""
    open_ = edges(tasks).join(tasks.filter("status <> 'done' or status is null").select(F.col("task_id").alias("needs")), "needs", "left_semi").select("task_id").distinct()
    return tasks.filter("status = 'pending' and task_id is not null").distinct().join(open_, "task_id", "left_anti").select("task_id", "position")


def dependents(tasks: DataFrame) -> DataFrame:
    """(task_id, dependents): how many tasks wait for each."""
    n = edges(tasks).groupBy(F.col("needs").alias("task_id")).agg(F.count("*").alias("dependents"))
    return tasks.select("task_id").filter("task_id is not null").distinct().join(n, "task_id", "left").select("task_id", F.coalesce("dependents", F.lit(0)).alias("dependents"))


def progress(tasks: DataFrame) -> DataFrame:
    """(tasks, done, pending) in one row."""
    return tasks.agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "pending").alias("pending"))


def ordered(tasks: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(task_id, place): dependencies before what needs them, roots in their position's order; an error names a task on a cycle.

    Depth-first order is sequential by nature, so one plan is ordered on the
    driver; a plan over ``largest`` tasks is refused, not cut.
    """
    rows = tasks.filter("task_id is not null").select(F.coalesce("position", F.lit(1 << 62)).alias("position"), "task_id", "depends_on").limit(largest + 1).collect()
    if len(rows) > largest:
        raise ValueError(f"a plan of more than {largest} tasks isn't ordered on the driver")
    needs = {r["task_id"]: r["depends_on"] or [] for r in sorted(rows, key=lambda r: (r["position"], r["task_id"]))}
    place: dict[str, int] = {}
    path: dict[str, None] = {}
    for root in needs:
        walk = [(root, iter(needs[root]))] if root not in place else []
        while walk:
            task, rest = walk[-1]
            path[task] = None
            following = next((d for d in rest if d in needs and d not in place), None)
            if following is None:
                walk.pop()
                path.pop(task)
                place[task] = len(place)
            elif following in path:
                raise ValueError(f"{following} depends on itself")
            else:
                walk.append((following, iter(needs[following])))
    return tasks.sparkSession.createDataFrame(list(place.items()), "task_id string, place int")


def levels(tasks: DataFrame) -> DataFrame:
    """(task_id, level): the longest chain of dependencies below each task, found round by round; for graphs too large for the driver. Tasks on a cycle have none."""
    from ..storage import store

    open_ = store(edges(tasks))
    waiting = store(tasks.select("task_id").filter("task_id is not null").distinct())
    out, level = None, 0
    while not waiting.isEmpty():
        free = store(waiting.join(open_.select("task_id").distinct(), "task_id", "left_anti"))
        if free.isEmpty():
            break
        now = free.select("task_id", F.lit(level).alias("level"))
        out = now if out is None else out.unionByName(now)
        waiting = store(waiting.join(free, "task_id", "left_anti"))
        open_ = store(open_.join(free.select(F.col("task_id").alias("needs")), "needs", "left_anti").select("task_id", "needs"))
        level += 1
    return out if out is not None else waiting.select("task_id", F.lit(0).alias("level"))
