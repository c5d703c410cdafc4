"""First-row deduplication and key guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by a total order; NULL keys form a group."""
    w, n = Window.partitionBy(*keys).orderBy(*order), "n"
    while n in df.columns:
        n += "_"
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or ValueError with up to ten keys that repeat."""
    found = duplicate_keys(df, keys).orderBy(*keys).limit(10).collect()
    if found:
        raise ValueError(f"repeated keys: {[tuple(r[k] for k in keys) for r in found]}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that raises if either side repeats a key."""
    return require_unique(left, [key]).join(require_unique(right, [key]), key, "left")


def concat_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables with the same keys side by side, whatever their orders."""
    return left.join(right, list(keys))


def join_suffixed(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join in which only columns that both sides have get suffixes."""
    both = [c for c in left.columns if c in right.columns and c != key]
    for c in both:
        left, right = left.withColumnRenamed(c, c + suffixes[0]), right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, key)
