"""Hourly weather to daily sums and trailing calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KELVIN, BASE = 273.15, 10.0
WINDOWS = (7, 14, 30)


def celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(KELVIN)


def millimetres(metres: Column) -> Column:
    return metres * F.lit(1000.0)


def feet(metres: float) -> float:
    return metres * 3.280833333


def daily(hourly: DataFrame) -> DataFrame:
    """tmean_c, precip_mm, srad_j and growing degrees per tree and day."""
    out = hourly.groupBy("uniqueID", F.to_date("ts").alias("date")).agg(
        celsius(F.avg("temperature_2m")).alias("tmean_c"),
        millimetres(F.sum("total_precipitation_hourly")).alias("precip_mm"),
        F.sum("surface_solar_radiation_downwards_hourly").alias("srad_j"),
    )
    return out.withColumn("gdd_day", F.when(F.col("tmean_c").isNotNull(), F.greatest(F.col("tmean_c") - BASE, F.lit(0.0))))


def _day() -> Column:
    return F.datediff("date", F.lit("1970-01-01"))


def trailing(days: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Means and sums over the calendar days [d - n + 1, d] that exist."""
    out = {}
    for n in windows:
        w = Window.partitionBy("uniqueID").orderBy("day").rangeBetween(-(n - 1), 0)
        out |= {f"temp_mean_{n}d_c": F.avg("tmean_c").over(w), f"precip_sum_{n}d_mm": F.sum("precip_mm").over(w), f"srad_sum_{n}d_j_m2": F.sum("srad_j").over(w)}
    return days.withColumn("day", _day()).withColumns(out).drop("day")


def growing_degrees(days: DataFrame, spine_start: str | None = None) -> DataFrame:
    """Degree days since the year began, or since ``spine_start`` in its year."""
    if spine_start:
        days = days.where(F.col("date") >= F.lit(spine_start).cast("date"))
    w = Window.partitionBy("uniqueID", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("gdd_cum_ytd_base10_c", F.sum("gdd_day").over(w))


def at_dates(features: DataFrame, valid: DataFrame) -> DataFrame:
    """Features on the valid dates only, at every point that has them."""
    return features.join(valid.select("date").distinct(), "date", "left_semi")
