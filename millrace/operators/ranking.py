"""Numbers and neighbours in an order, without a task per group or for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbers_within(df: DataFrame, group: list[str], key: str, name: str, width: int = 4096, ties: tuple[str, ...] = ()) -> DataFrame:
    """Number from 0 of every row within its group, in the order of a whole-numbered key (not null), rows of equal keys in the order of ``ties``.

    A group is parted by ranges of the key; parts are counted, the counts
    before a part added, and rows numbered within a part.
    """
    parts = df.withColumn("_part", F.floor(F.col(key) / width))
    counts = parts.groupBy(*group, "_part").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_part").orderBy(key, *ties)
    rows = parts.withColumn("_own", F.row_number().over(inside) - 1)
    right = offsets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, "_part"])], "_offset")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate([*group, "_part"])]  # null is a group too
    return rows.join(right, same).withColumn(name, F.col("_own") + F.col("_offset")).select(*df.columns, name)


def global_numbers(df: DataFrame, key: str, name: str, width: int = 4096) -> DataFrame:
    """Number from 0 of every row in the order of a whole-numbered key; only the counts of ranges are summed in one place."""
    return numbers_within(df.withColumn("_all", F.lit(0)), ["_all"], key, name, width).drop("_all")


def previous_within(df: DataFrame, group: list[str], key: str, value: Column, name: str, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``value`` of the row before each within its group, in the order of a whole-numbered key and ``ties``; null for the first.

    A group is parted by ranges of the key: each part looks back within itself,
    and its first row gets the last value of the part before, which an
    aggregate found.
    """
    parts = df.withColumn("_part", F.floor(F.col(key) / width)).withColumn("_value", value)
    rows = parts.withColumn(name, F.lag("_value").over(Window.partitionBy(*group, "_part").orderBy(key, *ties)))
    last = parts.groupBy(*group, "_part").agg(F.max_by("_value", F.struct(key, *ties)).alias("_last"))
    carried = last.select(*group, "_part", F.lag("_last").over(Window.partitionBy(*group).orderBy("_part")).alias("_carried"))
    return rows.join(carried, [*group, "_part"]).withColumn(name, F.coalesce(name, "_carried")).drop("_part", "_value", "_carried")


def best_within(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank", salts: int = 32) -> DataFrame:
    """The first ``k`` rows of every group with their place from 1.

    Each of ``salts`` shares of a group keeps its own best first (before any
    shuffle, Spark's window group limit keeps those of a task), so no task
    sorts a whole hot group.
    """
    some = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in group and not df.schema[c].dataType.typeName() == "map"] or [F.lit(0)]), F.lit(salts)))
    part = some.withColumn(name, F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).filter(F.col(name) <= k).drop(name, "_salt")
    return part.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def salted_pairs(posts: DataFrame, token: str, key: str, size: int = 2000) -> DataFrame:
    """(a, b, token), a < b: rows of (token, key) that share a token.

    A token of n rows is parted in ceil(n / size) blocks; a row of one block
    meets the rows of all, block by block, so that no task holds a hot token.
    """
    counts = posts.groupBy(token).agg(F.count("*").alias("_n")).filter("_n > 1").select(token, F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    rows = posts.join(counts, token).withColumn("_block", F.pmod(F.xxhash64(F.lit(7), key), F.col("_blocks")).cast("int"))
    left = rows.select(F.col(key).alias("a"), token, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_to"))
    right = rows.select(F.col(key).alias("b"), token, F.col("_block").alias("_to"))
    return left.join(right, [token, "_to"]).filter("a < b").select("a", "b", token)
