"""Scans of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import parsed


def text_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(file, line_no, line) of text files; lines count from 1 in each file, the first ``skip`` are left out.

    Lines are numbered by blocks: each counts its own, and the counts of the
    blocks before are added; no file is read by one task alone.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = raw.join(offsets, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("offset") + 1).alias("line_no"), F.col("value").alias("line"))
    return rows.filter(F.col("line_no") > skip)


def json_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(file, line_no, line, record, parse_error): a line that isn't JSON has a null record and an error, and stops nothing.

    Blank lines are left out.
    """
    rows = text_lines(spark, path, skip).filter(F.trim("line") != "")
    rows = rows.withColumn("record", parsed("line"))
    return rows.select("*", F.when(F.col("record").isNull(), "malformed JSON record").alias("parse_error"))


def input_records(spark: SparkSession, path: str, kind: str = "jsonl", skip: int = 0) -> DataFrame:
    """(file, line_no, line, record, parse_error) of JSON lines or Parquet, by the path's ending first and then by ``kind``; rows of Parquet become JSON and count from 1."""
    if path.endswith(".parquet") or kind == "parquet":
        rows = parquet_rows(spark, path)
        line = F.to_json(F.struct(*[c for c in rows.columns if c not in ("_file", "_row")]), {"ignoreNullFields": "false"})
        return rows.filter(F.col("_row") > skip).select(F.col("_file").alias("file"), F.col("_row").alias("line_no"), line.alias("line"), F.try_parse_json(line).alias("record"), F.lit(None).cast("string").alias("parse_error"))
    return json_lines(spark, path, skip)


def message_pairs(lines: DataFrame) -> DataFrame:
    """(id, instruction, response) of records (line_no, record): the contents of the first two messages, whoever speaks; other records are passed over."""
    text = lambda i: F.when(F.schema_of_variant(F.try_variant_get("record", f"$.messages[{i}].content", "variant")) == "STRING", F.try_variant_get("record", f"$.messages[{i}].content", "string"))
    own = F.try_variant_get("record", "$.id", "string")
    key = F.when(own.isNull() | own.isin("", "0", "false"), F.concat(F.lit("line-"), F.col("line_no").cast("string"))).otherwise(own)
    return lines.select(key.alias("id"), text(0).alias("instruction"), text(1).alias("response")).filter("instruction is not null and response is not null")


def package_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a package's first file of JSON lines in the order of names, its sample aside; only those with a list of messages."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path").filter("not endswith(path, '/sample.jsonl')")
    first = names.agg(F.min("path")).first()[0]
    if first is None:
        return spark.createDataFrame([], "file string, line_no long, line string, record variant, parse_error string")
    return json_lines(spark, first).filter(F.schema_of_variant(F.try_variant_get("record", "$.messages", "variant")).startswith("ARRAY"))


def window_of(lines: DataFrame, offset: int, limit: int) -> DataFrame:
    """``limit`` lines (line_no from 1) after the first ``offset``."""
    return lines.filter(F.col("line_no").between(offset + 1, offset + limit))


#: Folders that listings pass over.
IGNORED = (".git", "__pycache__", "node_modules", ".venv", ".mypy_cache", ".ruff_cache")


def listed(files: DataFrame, pattern: str = "*", limit: int = 200) -> DataFrame:
    """The first files (uri) in order whose name matches a pattern with * and ?, ignored folders aside."""
    name = F.element_at(F.split("uri", "/"), -1)
    like = "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() else c for c in pattern) + "$"
    return files.filter(name.rlike(like) & ~F.arrays_overlap(F.split("uri", "/"), F.array(*map(F.lit, IGNORED)))).orderBy("uri").limit(limit)


def transcript_rows(messages: DataFrame, limit: int = 0) -> DataFrame:
    """Messages in the order of conversation, instant and id; the first ``limit`` of them, all for 0."""
    rows = messages.orderBy("conversation_id", "created_at", "id")
    return rows.limit(limit) if limit else rows


def indexed_files(files: DataFrame) -> DataFrame:
    """(uri, text) of files (uri, text) to be indexed; JSON gets sorted keys."""
    json_text = F.when(F.lower("uri").endswith(".json"), F.to_json(F.try_parse_json("text")))
    return files.select("uri", F.coalesce(json_text, "text").alias("text"))


def settings(path: str, known: dict[str, type]) -> dict:
    """Settings of a TOML file, on the driver; unknown names and wrong types are errors."""
    import tomllib

    with open(path, "rb") as f:
        given = tomllib.load(f)
    for name, value in given.items():
        if name not in known:
            raise ValueError(f"unknown setting {name}")
        if not isinstance(value, known[name]) or isinstance(value, bool) and known[name] is not bool:
            raise ValueError(f"{name} must be {known[name].__name__}")
    return given


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns of Parquet files with their file and row number from 1 (columns _file and _row)."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_row"))


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(uri, text) of text files, each as one row."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))


def found_lines(files: DataFrame, pattern: str) -> DataFrame:
    """(uri, line_no, line) of the lines of (uri, text) that match a pattern."""
    lines = files.select("uri", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.filter(F.col("line").rlike(pattern)).select("uri", (F.col("at") + 1).alias("line_no"), "line")


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(uri, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_size(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of files (uri, bytes)."""
    return files.groupBy(F.regexp_replace("uri", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
