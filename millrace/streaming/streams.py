"""Structured Streaming forms of the pipeline: resumable ingest, deduplication across runs, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_hash


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of text files in a folder, with their file; new files are read as they come."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is new since the last run, each row exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_texts(stream: DataFrame, text: str, accepted: str, checkpoint: str, buckets: int = 64) -> None:
    """Append rows whose normalized text isn't in the accepted table yet; of equal new texts the least row stays.

    The table is parted by the first bits of the text's hash, so a batch is
    compared with the hashes of the parts it touches, not with the whole table.
    """
    spark = stream.sparkSession

    def there() -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(accepted)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("text_hash", text_hash(text)).withColumn("bucket", F.pmod(F.xxhash64("text_hash"), F.lit(buckets)).cast("int"))
        first = rows.groupBy("bucket", "text_hash").agg(F.min(F.struct(*batch.columns)).alias("r")).select("bucket", "text_hash", "r.*")
        if there():
            known = batch.sparkSession.read.parquet(accepted).filter(F.col("batch") != number).select("bucket", "text_hash")
            first = first.join(known, ["bucket", "text_hash"], "left_anti")
        # A batch that is run again overwrites its own parts only.
        first.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(accepted)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def capped_run(spark: SparkSession, folder: str, path: str, checkpoint: str, most: int) -> int:
    """Write new lines until the table has ``most`` rows over all runs (0: no cap); returns how many rows it has then."""
    from ..functions.values import limit_left

    def step(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read
        seen = 0 if number == 0 else read.schema(batch.schema.add("batch", "long")).option("mergeSchema", "false").parquet(path).filter(F.col("batch") < number).count()
        left = limit_left(most, seen)
        kept = batch if left is None else batch.orderBy("file", "line").limit(left)
        kept.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    ingest(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).count()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, total) of events (ts, event_type, value); streams drop what comes later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, events): events of a user without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
