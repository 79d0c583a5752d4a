"""Consecutive numbers within groups, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def numbered(rows: DataFrame, group: list[str], key: str, name: str = "rank", seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with a number from 0 within each group, in the order of a seeded hash of ``key``.

    A group is parted by the highest bits of the hash; the parts are counted,
    the counts before a part added, and rows are ranked within a part only.
    So a group that holds a third of all rows is ranked by many tasks.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    with_hash = rows.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 64 - buckets.bit_length() + 1))
    counts = with_hash.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", key)
    ranked = with_hash.withColumn("_r", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*group, "_b"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_h", "_b", "_r", "_o")
