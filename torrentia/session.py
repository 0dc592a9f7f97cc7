"""Session defaults shared by the bench, the tests and the examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "torrentia", cpus: str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the caller brings its own and none of this applies."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TORRENTIA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
