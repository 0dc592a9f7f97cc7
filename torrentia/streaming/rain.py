"""Rain windows over a stream of gauge readings; the same functions work on a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(readings: DataFrame, t: str, late: str) -> DataFrame:
    at = readings.withColumn("at", F.col(t).cast("timestamp"))
    return at.withWatermark("at", late) if readings.isStreaming else at


def window_totals(readings: DataFrame, key: str, t: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Totals of tumbling windows, or sliding ones: key, start, end, mm, n."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    out = _timed(readings, t, late).groupBy(key, w.alias("w")).agg(F.sum(value).alias("mm"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mm", "n")


def storms(readings: DataFrame, key: str, t: str, value: str, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    """Runs of readings at most `gap` apart: key, start, end (last reading plus gap), mm, n."""
    out = _timed(readings, t, late).groupBy(key, F.session_window("at", gap).alias("w")).agg(F.sum(value).alias("mm"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mm", "n")
