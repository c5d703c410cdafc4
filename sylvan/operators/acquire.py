"""Acquisition over scene, cloud and pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import keep_first

CLOUD_PCT, CLOUD_PROB = 70, 40
MASKED = (0, 1, 3, 8, 9, 10, 11)  # scene classes that never count


def in_period(df: DataFrame, start: str, end: str, column: str = "ts") -> DataFrame:
    """Rows of [start, end)."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp")))


def scene_source(scenes: DataFrame, start: str, end: str, most: float = CLOUD_PCT) -> DataFrame:
    return in_period(scenes, start, end).where(F.col("cloud_pct") <= most)


def save_first(scenes: DataFrame, clouds: DataFrame) -> DataFrame:
    """Each scene with its first cloud image; scenes without one go."""
    return scenes.join(keep_first(clouds, ["scene_id"], ["image"]).select("scene_id", "image"), "scene_id")


def mask(pixels: DataFrame) -> DataFrame:
    return pixels.where((F.col("probability") < CLOUD_PROB) & ~F.col("scl").isin(*MASKED))


def sample(scenes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Band values at points of the scenes, stamped with the date."""
    return mask(pixels).join(scenes.select("scene_id", F.to_date("ts").alias("date")), "scene_id")


def every_date_and_point(dates: DataFrame, points: DataFrame) -> DataFrame:
    """All pairs of the two: one row per date and point is what is asked for."""
    return dates.select("date").distinct().crossJoin(points.select("uniqueID").distinct())
