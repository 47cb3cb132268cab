"""Sliding-window statistics, the same for streams and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sliding_stats(
    df: DataFrame, at: str, value: str, size: str = "10 seconds", slide: str = "2 seconds",
    watermark: str | None = None,
) -> DataFrame:
    """Count, mean, least and greatest value per window; windows as flat columns.

    With a watermark, rows later than it are left out once their window is closed.
    """
    if watermark:
        df = df.withWatermark(at, watermark)
    stats = df.groupBy(F.window(at, size, slide)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return stats.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "n", "avg_value", "min_value", "max_value")
