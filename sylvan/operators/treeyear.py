"""Tree-year sequences and annual metrics."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import cyclic, log_sum, n_valid, season
from ..functions.indices import BANDS, INDEX_NAMES
from ..sources.adapters import WEATHER
from . import runs

S2 = (*BANDS, *INDEX_NAMES)
COLUMNS = (*S2, *WEATHER)
SUMS = tuple(c for c in WEATHER if not c.startswith("temp"))
SEASONS = ("winter", "spring", "summer", "fall")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` with its year, dealt by tree-year: what is derived from its
    columns afterwards, such as indices, isn't shuffled."""
    return df.withColumn("year", F.year("date")).repartition("uniqueID", "year")


def annual_metrics(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Mean, min, max, range and population deviation of each column, 0 where
    a tree-year has no value, in one aggregation. Rows are dealt by tree-year
    first, unless they have a year from ``dealt``: with a few rows in each (a
    year's observations at most), sums of all columns before the exchange
    would be larger than the rows."""
    aggs: list[Column] = []
    for c in columns:
        x = F.col(c)
        for name, a in (("mean", F.avg(x)), ("min", F.min(x)), ("max", F.max(x)), ("range", F.max(x) - F.min(x)), ("std", F.stddev_pop(x))):
            aggs.append(F.coalesce(a, F.lit(0.0)).alias(f"{c}_{name}"))
    rows = (df if "year" in df.columns else dealt(df.select("uniqueID", "date", *columns))).select("uniqueID", "year", *columns)
    return rows.groupBy("uniqueID", "year").agg(*aggs)


METRICS = ("mean", "min", "max", "range", "std")


def _arrays(v: np.ndarray, new: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """``METRICS`` of a column for tree-years of ``n`` rows from ``new`` on; NaN is a missing value."""
    there = ~np.isnan(v)
    count = np.add.reduceat(there.astype(np.int64), new)
    mean = np.add.reduceat(np.where(there, v, 0.0), new) / np.maximum(count, 1)
    low, high = np.minimum.reduceat(np.where(there, v, np.inf), new), np.maximum.reduceat(np.where(there, v, -np.inf), new)
    far = np.where(there, v - np.repeat(mean, n), 0.0)
    std = np.sqrt(np.add.reduceat(far * far, new) / np.maximum(count, 1))
    return [np.where(count > 0, x, 0.0) for x in (mean, low, high, high - low, std)]


def flat_metrics(df: DataFrame, others: Sequence[str] = (), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``annual_metrics`` for rows with a year that lie by uniqueID and year:
    arrays of many tree-years at a time, where generated code for 165
    aggregates is too large to be compiled. ``others`` are alike in all rows
    of a tree-year."""
    runs.travel(sys.modules[__name__])
    kept = ["uniqueID", "year", *others]
    names = [f"{c}_{k}" for c in columns for k in METRICS]
    rows = df.select(*kept, *[F.col(c).cast("double") for c in columns])
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches):
        for t in runs.whole(batches, ("uniqueID", "year")):
            new = runs.starts(t, ("uniqueID", "year"))
            n = np.diff(np.append(new, t.num_rows))
            found = [pa.array(x) for c in columns for x in _arrays(runs.column(t, c), new, n)]
            own = t.select(kept).take(pa.array(new)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*own.columns, *found], [*kept, *names])

    return rows.mapInArrow(run, schema)


def seasonal_ndvi(df: DataFrame) -> DataFrame:
    """Seasonal means that fall back to the year's, two differences, and the
    share above the year's mean; zeros for a year without NDVI."""
    year = F.year("date")
    x = df.withColumn("year", year).withColumn("season", season("date"))
    x = x.withColumn("year_mean", F.avg("NDVI").over(Window.partitionBy("uniqueID", "year")))
    out = x.groupBy("uniqueID", "year").agg(
        F.avg("NDVI").alias("year_mean"),
        *[F.avg(F.when(F.col("season") == s, F.col("NDVI"))).alias(s) for s in SEASONS],
        F.avg((F.col("NDVI") > F.col("year_mean")).cast("double")).alias("above"),
    )
    mean = lambda s: F.coalesce(s, "year_mean", F.lit(0.0))
    return out.select(
        "uniqueID", "year", *[mean(s).alias(f"NDVI_{s}_mean") for s in SEASONS],
        (mean("spring") - mean("winter")).alias("NDVI_spring_minus_winter"), (mean("fall") - mean("summer")).alias("NDVI_fall_minus_summer"),
        F.coalesce("above", F.lit(0.0)).alias("NDVI_share_above_mean"),
    )


def coverage(df: DataFrame, columns: tuple[str, ...] = S2) -> DataFrame:
    n = F.count("*")
    return df.groupBy("uniqueID", F.year("date").alias("year")).agg(n.alias("length"), n.cast("double").alias("coverage"), F.sum(n_valid(*columns)).cast("double").alias("valid_measurements"))


def _in_year() -> Window:
    return Window.partitionBy("uniqueID", "year").orderBy("date", "ord1", "ord2")


def with_gaps(df: DataFrame) -> DataFrame:
    """Months of 30 days since the previous observation of the year; the first has 0."""
    days = F.datediff("date", F.lag("date").over(_in_year()))
    return df.withColumn("year", F.year("date")).withColumn("delta_days", F.coalesce(days, F.lit(0)) / F.lit(30.0))


def timesteps(df: DataFrame, columns: tuple[str, ...] = COLUMNS, masks: tuple[str, ...] = S2) -> DataFrame:
    """Filled columns (sums logged), gap, sine and cosine, and validity masks."""
    sin, cos = cyclic("date", 365.25)
    filled = [(log_sum(c) if c in SUMS else F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns]
    return with_gaps(df).select("uniqueID", "year", "date", "ord1", "ord2", *filled, "delta_days", sin.alias("doy_sin"), cos.alias("doy_cos"), *[F.col(c).isNotNull().cast("int").alias(f"{c}_mask") for c in masks])


def sequences(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row per tree-year: its time steps in order, as rows of a matrix."""
    step = F.struct("date", "ord1", "ord2", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    ordered = F.array_sort(F.collect_list(step))
    return df.groupBy("uniqueID", "year").agg(F.transform(ordered, lambda s: s["x"]).alias("seq"), F.count("*").alias("length"))


def padded(seqs: DataFrame, length: int, width: int) -> DataFrame:
    """Sequences cut or filled with zero rows to one length, and their masks."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), length)
    return seqs.select("uniqueID", "year", F.slice(F.concat("seq", zero), 1, length).alias("seq"), F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.col("length")).cast("int")).alias("mask"))


def moments(train: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row of means and population deviations, 1 for a deviation of 0."""
    std = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    return train.agg(*[F.avg(c).alias(f"{c}_mu") for c in columns], *[std(c).alias(f"{c}_sd") for c in columns])


def standardise(df: DataFrame, stats: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(x - mean) / deviation with the one row of ``moments``."""
    met = df.crossJoin(F.broadcast(stats))  # one row
    return met.select(*[((F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd")).alias(c) if c in columns else F.col(c) for c in df.columns])
