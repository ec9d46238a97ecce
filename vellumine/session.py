"""Session settings that the library's plans expect, and a session for local use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and merges small partitions; sizes suit tens of MB a task.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
    return builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(map=SETTINGS).getOrCreate()


def session() -> SparkSession:
    """The session that `spark-submit` has set up, on whatever master it names, with these settings where it has none; a local one without it."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return local_session()
    spark = SparkSession.builder.getOrCreate()
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.") and spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark
