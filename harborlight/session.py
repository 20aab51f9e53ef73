"""Session factory for local runs, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the submitted session already exists and is returned as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("harborlight")
        .config("spark.driver.memory", os.environ.get("HARBORLIGHT_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
