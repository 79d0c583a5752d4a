"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; one of this machine is set only where the session names none and runs on this machine alone (tests, local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def store(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there; survives the loss of executors.

    The table stays until ``clean`` is called, as frames that read it are evaluated later.
    """
    at = f"{folder(df.sparkSession)}/millrace/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _stored.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clean(spark: SparkSession) -> int:
    """Delete the tables that this process stored; to be called when their frames have been used. Returns how many there were."""
    hadoop, gone = spark._jvm.org.apache.hadoop.fs, 0
    while _stored:
        at = hadoop.Path(_stored.pop())
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone
