"""The seven-day acquisition windows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(stream: DataFrame, end: str, column: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows, and the mean value, of each window. Windows begin on the weekday
    of 2024-01-01 (the epoch is a Thursday); the last is cut at ``end``."""
    out = (
        stream.withWatermark(column, delay)
        .where(F.col(column) < F.lit(end).cast("timestamp"))
        .groupBy(F.window(column, "7 days", startTime="4 days").alias("w"))
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    )
    return out.select(F.col("w.start").alias("window_start"), F.least(F.col("w.end"), F.lit(end).cast("timestamp")).alias("window_end"), "n", "mean_value")
