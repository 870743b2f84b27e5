"""Spark session used by tests, benches and the driver entry."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "loomline", cpus: str | None = None, shuffle: int = 8) -> SparkSession:
    """A session with adaptive execution; an active session is returned as it is."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
