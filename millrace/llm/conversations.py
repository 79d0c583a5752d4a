"""Problem 3: conversations assembled from overlapping export fragments.

The rows of one export day form a fragment of each conversation they touch:
its messages, each known by a hash, in the order of (instant, id).  Where the
last messages of one fragment are the first of another (a suffix-prefix match
of their hashes) an edge of the conversation's overlap graph leads from the one
to the other.  Edges that are the only one out of their fragment and the only
one into the other are unambiguous: fragments along them are merged to a path,
their common messages once.  What the graph leaves open, as fragments without
common messages or with several followers, is put in order by time: paths of a
conversation are interleaved by instant and id.  Then defects are looked for,
and conversations with gaps (an unanswered user) and other defects dropped.

Only fragments (a conversation has one an export day) are handled as a list;
messages are numbered, matched and merged by parts, and the merged messages are
range-partitioned, so a hot conversation is many tasks' work: each folds its
stretch to a summary, and the few summaries are stitched in order.

Message: (conversation_id, id); repeated rows count once, the earliest export's
row standing for all.  Rows without an id are the same message only if role,
content and created_at are.  Instants that can't be read come last.  Null
conversation ids belong to no conversation; rows without ingested_at are a
fragment of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbers_within
from .storage import store

#: The roles and aliases of the project.
SPEAKERS = {"system": "system", "user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "tool": "tool", "observation": "tool", "environment": "tool"}
SYSTEM, USER, ASSISTANT, TOOL, UNKNOWN = range(5)
DEFECTS = ("empty", "unknown_role", "orphan_reply", "missing_reply")


def instant(text: Column | str) -> Column:
    """Timestamp of an ISO-like text; UTC where it has no offset; null if it can't be read."""
    x = F.trim(F.col(text) if isinstance(text, str) else text)
    numeric = x.rlike(r"^\d{9,11}(\.\d+)?$")
    zoned = F.when(x.rlike(r"(?i)(z|utc|[+-]\d\d:?\d\d)$"), x).otherwise(F.concat(x, F.lit("Z")))
    return F.when(numeric, F.timestamp_micros((x.try_cast("double") * 1e6).cast("bigint"))).otherwise(F.regexp_replace(zoned, r"([+-]\d\d)(\d\d)$", "$1:$2").try_cast("timestamp"))


def speaker(role: Column | str) -> Column:
    """One of system, user, assistant, tool; null for any other role."""
    x = F.lower(F.regexp_replace(F.col(role) if isinstance(role, str) else role, r"(?U)^\s+|\s+$", ""))
    pairs = [F.lit(v) for kv in SPEAKERS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(x, F.lit("")))


def visible(content: Column | str) -> Column:
    """Whether a text has a character that is neither white space nor of zero width."""
    x = F.col(content) if isinstance(content, str) else content
    return F.coalesce(x.rlike(r"[^\p{Z}\p{Cc}\p{Cf}]"), F.lit(False))


LAST = 1 << 62  # instant of messages whose own can't be read
HOUR = 3_600_000_000


def keyed(messages: DataFrame, *more: str) -> DataFrame:
    """(conversation_id, key, instant, id, kind, visible, export, more) of all rows that belong to a conversation."""
    own = speaker("role")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, n in (("system", SYSTEM), ("user", USER), ("assistant", ASSISTANT), ("tool", TOOL)) for v in (k, n)]), F.coalesce(own, F.lit("tool"))), F.lit(UNKNOWN))
    key = F.when(F.col("id").isNotNull(), F.xxhash64(F.lit(0), "id")).otherwise(F.xxhash64(F.lit(1), "role", "content", "created_at"))
    return messages.filter("conversation_id is not null").select(
        "conversation_id", key.alias("key"), F.coalesce(F.unix_micros(instant("created_at")), F.lit(LAST)).alias("instant"), F.coalesce("id", F.lit("")).alias("id"),
        F.when(own.isNull(), F.lit(UNKNOWN)).otherwise(kind).cast("int").alias("kind"), visible("content").alias("visible"), F.coalesce(F.datediff("ingested_at", F.lit("1970-01-01")), F.lit(-1)).alias("export"), *more,
    )


def overlaps(rows: DataFrame) -> DataFrame:
    """(conversation_id, a, b, messages): where the last messages of fragment a are the first of fragment b, and how many they are.

    Messages are placed within their fragments; those that several fragments
    hold are paired.  The common messages of two fragments are a suffix of the
    one if none of them is further from its end than they are many, and a
    prefix of the other likewise.
    """
    held = rows.groupBy("conversation_id", "export", "key").agg(F.min("instant").alias("instant"), F.min("id").alias("id"))
    common = held.groupBy("conversation_id", "key").agg(F.count("*").alias("holders")).filter("holders > 1").select("conversation_id", "key")
    touched = held.join(common, ["conversation_id", "key"], "left_semi").select("conversation_id", "export").distinct()
    # Only fragments that share a message need places.
    placed = numbers_within(held.join(touched, ["conversation_id", "export"], "left_semi"), ["conversation_id", "export"], "instant", "place", HOUR, ("id", "key"))
    size = placed.groupBy("conversation_id", "export").agg(F.count("*").alias("size"))
    shared = placed.join(common, ["conversation_id", "key"], "left_semi").join(size, ["conversation_id", "export"]).select("conversation_id", "key", "export", "place", "size")
    one = shared.select("conversation_id", "key", F.col("export").alias("a"), (F.col("size") - F.col("place")).alias("behind"), F.col("size").alias("n"))
    other = shared.select("conversation_id", "key", F.col("export").alias("b"), (F.col("place") + 1).alias("ahead"), F.col("size").alias("m"))
    pairs = one.join(other, ["conversation_id", "key"]).filter("a <> b").groupBy("conversation_id", "a", "b").agg(F.count("*").alias("messages"), F.max("behind").alias("behind"), F.max("ahead").alias("ahead"), F.max("n").alias("n"), F.max("m").alias("m"))
    # Equal fragments match both ways; the earlier goes first.
    return pairs.filter("behind = messages and ahead = messages and (messages < n or messages < m or a < b)").select("conversation_id", "a", "b", "messages")


def paths(rows: DataFrame) -> DataFrame:
    """(conversation_id, export, path): fragments that unambiguous overlaps join have one path, named by its first fragment."""
    edges = overlaps(rows)
    count = lambda end: F.count("*").over(Window.partitionBy("conversation_id", end))
    sure = edges.withColumn("_out", count("a")).withColumn("_in", count("b")).filter("_out = 1 and _in = 1").select("conversation_id", F.col("b").alias("export"), F.col("a").alias("before"))
    fragments = rows.groupBy("conversation_id", "export").agg(F.min("instant").alias("first"), F.count("*").alias("n")).join(sure, ["conversation_id", "export"], "left")
    listed = fragments.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("first", "n", "export", "before"))).alias("f"))
    # Edges lead forward in this order but for equal beginnings: a second pass settles these.
    none = F.create_map().cast("map<int,int>")
    step = lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["export"]), F.create_map(x["export"], F.coalesce(F.try_element_at(m, x["before"]), x["before"], x["export"])))
    twice = F.aggregate(F.col("f"), F.aggregate(F.col("f"), none, step), step)
    named = listed.select("conversation_id", F.explode(twice).alias("export", "path"))
    return named


def merged(rows: DataFrame, *more: str) -> DataFrame:
    """(conversation_id, instant, id, key, kind, visible, path, holders, more): the messages of all paths, each once, range-partitioned in order."""
    placed = rows.join(paths(rows), ["conversation_id", "export"])
    first = F.min_by(F.struct("kind", "visible", *more), F.struct("export", "kind", "visible")).alias("r")
    one = placed.groupBy("conversation_id", "key").agg(F.min("instant").alias("instant"), F.min("id").alias("id"), F.min("path").alias("path"), F.count_distinct("export").alias("holders"), first)
    order = ["conversation_id", "instant", "id", "key"]
    return one.select(*order, "r.kind", "r.visible", "path", "holders", *[f"r.{m}" for m in more]).repartitionByRange(*order).sortWithinPartitions(*order)


SUMMARY = "conversation_id string, part long, messages long, shared long, visible boolean, unknown boolean, opening int, first int, last int, gap boolean"


def summaries(ordered: DataFrame) -> DataFrame:
    """One row per conversation and partition of merged messages.

    first and last are the first and last event (a user message, or a visible
    assistant message; -1: none), gap tells of two user messages without a
    visible assistant message between them, opening is the first kind other
    than system, shared the number of messages that several exports hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state: list | None = None
        done: list[list] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                names = [x.split()[0] for x in SUMMARY.split(", ")]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done.clear()

        for batch in batches:
            for conversation, kind, seen, holders in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or state[0] != conversation:
                    if state is not None:
                        done.append(state)
                    state = [conversation, part, 0, 0, False, False, -1, -1, -1, False]
                state[2] += 1
                state[3] += holders > 1
                state[5] |= kind == UNKNOWN
                state[4] |= bool(seen) and kind in (USER, ASSISTANT)
                if state[6] < 0 and kind != SYSTEM:
                    state[6] = kind
                if kind == USER or kind == ASSISTANT and seen:
                    state[9] |= kind == USER and state[8] == USER
                    state[7] = kind if state[7] < 0 else state[7]
                    state[8] = kind
            yield from flush()
        if state is not None:
            done.append(state)
            yield from flush()

    return ordered.select("conversation_id", "kind", "visible", "holders").mapInArrow(run, SUMMARY)


def stitched(parts: DataFrame) -> DataFrame:
    """One row per conversation that has messages, with its first defect (null: none)."""
    s = parts.groupBy("conversation_id").agg(
        F.sum("messages").alias("messages"), F.sum("shared").alias("shared"), F.bool_or("visible").alias("visible"), F.bool_or("unknown").alias("unknown"), F.bool_or("gap").alias("gap"),
        F.sort_array(F.collect_list(F.struct("part", "opening", "first", "last"))).alias("parts"),
    )
    opening = F.try_element_at(F.filter(F.transform("parts", lambda p: p["opening"]), lambda k: k >= 0), F.lit(1))
    events = F.filter("parts", lambda p: p["first"] >= 0)
    joints = F.exists(F.arrays_zip(F.slice(events, 1, F.greatest(F.size(events) - 1, F.lit(0))).alias("l"), F.slice(events, 2, F.greatest(F.size(events), F.lit(1))).alias("r")), lambda z: (z["l"]["last"] == USER) & (z["r"]["first"] == USER))
    unanswered = F.coalesce(F.try_element_at(F.transform(events, lambda p: p["last"]), F.lit(-1)) == USER, F.lit(False))
    defect = (
        F.when(~F.col("visible"), "empty").when(F.col("unknown"), "unknown_role").when(opening != USER, "orphan_reply").when(F.col("gap") | F.coalesce(joints, F.lit(False)) | unanswered, "missing_reply")
    )
    return s.select("conversation_id", "messages", "shared", defect.alias("defect"))


def _judged(ordered: DataFrame, conversations: DataFrame) -> DataFrame:
    ids = conversations.select(F.col("id").alias("conversation_id")).filter("conversation_id is not null").distinct()
    joined = ids.join(stitched(summaries(ordered)), "conversation_id", "left")
    return joined.select("conversation_id", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("shared", F.lit(0)).alias("shared"), F.when(F.col("messages").isNull(), "empty").otherwise(F.col("defect")).alias("defect"))


def judged(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, messages, shared, defect) of every conversation; those without messages are empty."""
    return _judged(merged(store(keyed(messages))), conversations)


def assembled(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, position, id, speaker, content) of all sound conversations; positions count from 1.

    A conversation is numbered by its stretches: each partition counts its own
    messages, and the counts before it are added.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conversation, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            index = np.zeros(batch.num_rows, np.int64)
            for i, c in enumerate(batch.column(0).to_pylist()):
                conversation, n = c, n + 1 if c == conversation else 1
                index[i] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part)), pa.array(index), *(batch.column(j) for j in range(1, 6))], ["conversation_id", "part", "index", "id", "kind", "visible", "holders", "content"])

    schema = "conversation_id string, part long, index long, id string, kind int, visible boolean, holders long, content string"
    ordered = merged(store(keyed(messages, "content")), "content")
    rows = store(ordered.select("conversation_id", "id", "kind", "visible", "holders", "content").mapInArrow(number, schema))
    counts = rows.groupBy("conversation_id", "part").agg(F.max("index").alias("n"))
    before = Window.partitionBy("conversation_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("conversation_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    sound = judged(messages, conversations).filter("defect is null").select("conversation_id")
    names = F.element_at(F.array(*map(F.lit, ("system", "user", "assistant", "tool"))), F.col("kind") + 1)
    return rows.join(sound, "conversation_id").join(offset, ["conversation_id", "part"]).select("conversation_id", (F.col("index") + F.col("offset")).alias("position"), "id", names.alias("speaker"), "content")


def assembly(messages: DataFrame) -> DataFrame:
    """(conversation_id, fragments, paths, overlaps): how the fragments of every conversation came together."""
    rows = store(keyed(messages))
    found = overlaps(rows).groupBy("conversation_id").agg(F.count("*").alias("overlaps"))
    counts = paths(rows).groupBy("conversation_id").agg(F.count("*").alias("fragments"), F.count_distinct("path").alias("paths"))
    return counts.join(found, "conversation_id", "left").select("conversation_id", "fragments", "paths", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))
