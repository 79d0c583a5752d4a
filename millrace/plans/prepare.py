"""The corpus pipeline: normalization, filter, classification, deduplication, mixture, split and statistics, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import hash_split
from ..operators import corpus, records
from ..storage import store


@dataclass
class Limits:
    max_chars: int = 200_000
    require_user: bool = True
    require_assistant: bool = False
    minimum_quality: float = 0.0
    near: float | None = None  # ratio of near-duplicates; None leaves them


def judged(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Records (id, source, task_type, messages) with broken, label, evidence, flags and score. Repeated ids count once."""
    own = limits or Limits()
    one = rows.filter(F.col("id").isNotNull()).dropDuplicates(["id"])
    flagged = one.withColumn("flags", records.flags("messages", own.require_assistant))
    # The score looks at the flags' column, so that the patterns are searched once.
    scored = flagged.withColumn("score", records.quality("messages", own.max_chars, own.require_user, own.require_assistant, F.col("flags")))
    why = records.reject_reason("messages", own.max_chars, own.require_user, own.require_assistant)
    label = records.classified("messages", "task_type", F.col("source"))
    out = scored.withColumn("broken", F.coalesce(why, F.when(F.col("score") < own.minimum_quality, "quality_below_threshold"))).withColumn("_label", label)
    return out.withColumn("label", F.col("_label.label")).withColumn("evidence", F.col("_label.evidence")).drop("_label")


def prepared(rows: DataFrame, order: str = "id", limits: Limits | None = None) -> DataFrame:
    """``judged`` with reason and part: reason is the first of a broken rule or a duplicate; rows with one have no part."""
    own = limits or Limits()
    some = judged(rows, own)
    kept = corpus.duplicate_reasons(some.filter("broken is null"), order, own.near).select(F.col(order).alias("_o"), F.col("reason").alias("_why"))
    out = some.join(kept, F.col(order) == F.col("_o"), "left").withColumn("reason", F.coalesce("broken", "_why")).drop("broken", "_o", "_why")
    return out.withColumn("part", F.when(F.col("reason").isNull(), hash_split("id")))


@dataclass
class Corpus:
    """The tables of one run: every record with its fate, the mixture with its parts, statistics of the mixture, and counters by stage."""

    records: DataFrame
    mixture: DataFrame
    statistics: DataFrame
    counters: DataFrame
    weights: dict[str, float] = field(default_factory=dict)


def whole(raw: DataFrame, weights: dict[str, float], target: int | None = None, limits: Limits | None = None) -> Corpus:
    """The pipeline over raw lines (source, row_number, line): normalized, judged, made unique across sources, mixed by category in the order of the sources in turn, split, counted."""
    rows = records.normalized(raw, "line", F.col("source"))
    rows = store(rows.select("id", "source", "row_number", "messages", "license", F.lit(None).cast("string").alias("task_type"), F.col("reason").alias("unreadable")))
    fate = store(prepared(rows.filter("unreadable is null").drop("unreadable"), limits=limits))
    mixed = store(corpus.mixture(fate.filter("reason is null"), "label", "row_number", weights, target, "source").withColumn("part", hash_split("id")))
    stats = corpus.statistics(mixed.select("id", "source", F.col("label").alias("task_type"), "messages", F.col("score").alias("quality_score"), F.col("flags").alias("quality_flags")))
    stage = lambda name, df, why: df.groupBy(F.coalesce(why, F.lit("kept")).alias("counter")).agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "counter", "n")
    counters = stage("normalize", rows, F.col("unreadable")).unionByName(stage("judge", fate, F.col("reason"))).unionByName(stage("mixture", mixed, F.col("part")))
    return Corpus(fate, mixed, stats, counters, weights)
