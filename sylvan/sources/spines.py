"""Date and window spines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def tumbling(spark: SparkSession, start: str, end: str, size: int = 7) -> DataFrame:
    """Windows of ``size`` days in [start, end); the last is cut at the end."""
    stop = F.lit(end).cast("date")
    first = F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(stop, 1), F.make_dt_interval(F.lit(size))))
    return spark.range(1).select(first.alias("window_start")).withColumn("window_end", F.least(F.date_add("window_start", size), stop))
