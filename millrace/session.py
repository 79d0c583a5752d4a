"""Session defaults for local runs; a cluster's own settings are never overridden by the library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in this process, UTC, with adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("millrace")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
