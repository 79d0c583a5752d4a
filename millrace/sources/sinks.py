"""Sinks for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One canonical JSON object a row, keys sorted."""
    columns = sorted(df.columns)
    df.select(F.to_json(F.try_parse_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))).alias("value")).write.mode(mode).text(path)


def write_parts(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """Parquet files in one folder for each value of a column."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_accepted(df: DataFrame, reason: str, path: str, mode: str = "overwrite") -> None:
    """Rows without a reason to ``accepted``, the others with it to ``rejected``."""
    df.filter(F.col(reason).isNull()).drop(reason).write.mode(mode).parquet(f"{path}/accepted")
    df.filter(F.col(reason).isNotNull()).write.mode(mode).parquet(f"{path}/rejected")


def write_rejects(df: DataFrame, reason: str, raw: str, path: str, mode: str = "overwrite") -> None:
    """(row_number, reason, raw) of the rows with a reason, as JSON lines."""
    write_json_lines(df.filter(F.col(reason).isNotNull()).select("row_number", F.col(reason).alias("reason"), F.col(raw).alias("raw")), path, mode)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    write_json_lines(df, path, "append")


def report(df: DataFrame, stage: str, reason: str) -> DataFrame:
    """(stage, counter, n): rows seen, accepted, rejected, and rejected for each reason."""
    kept = F.col(reason).isNull()
    names = F.array(F.lit("records_seen"), F.when(kept, "accepted").otherwise("rejected"), F.when(~kept, F.concat(F.lit("reason_"), F.col(reason))))
    return df.select(F.explode(F.array_compact(names)).alias("counter")).groupBy("counter").agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "counter", "n")


def write_report(counters: DataFrame, path: str) -> dict:
    """Write a stage's counters as one indented JSON object of the driver's file system, and return it; a stage has a few dozen counters."""
    import json
    from pathlib import Path

    payload: dict = {}
    for r in counters.collect():
        payload.setdefault(r["stage"], {})[r["counter"]] = r["n"]
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return payload


def write_package(df: DataFrame, order: str, path: str, sample: int = 50) -> dict:
    """JSON lines of all rows and of a sample spread evenly over a whole-numbered order, and their manifest."""
    write_json_lines(df, f"{path}/full")
    write_json_lines(strided(df, order, sample), f"{path}/sample")
    spark = df.sparkSession
    facts = {n: spark.read.text(f"{path}/{n}").agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64("value"))).alias("h")).first() for n in ("full", "sample")}
    return {n: {"records": r["n"], "fingerprint": r["h"]} for n, r in facts.items()}


def strided(df: DataFrame, order: str, count: int) -> DataFrame:
    """About ``count`` rows spread evenly over a whole-numbered order, see ``curation.strided``."""
    from ..operators.curation import strided as spread

    return spread(df, order, count)
