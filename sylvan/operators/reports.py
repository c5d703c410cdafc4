"""Error analysis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import same
from .dedup import join_suffixed, keep_first


def by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def row_flags(rows: DataFrame, true: str = "y_true_name", pred: str = "y_pred_name") -> DataFrame:
    """correct, error_type, and where there are probabilities the largest and
    the true class's."""
    ok = same(true, pred)
    out = rows.withColumn("correct", ok).withColumn("error_type", F.when(ok, "correct").otherwise(F.concat(F.col(true), F.lit("_as_"), F.col(pred))))
    probs = by_prefix(rows, "prob_")
    if len(probs) > 1:
        out = out.withColumn("max_prob", F.greatest(*probs)).withColumn("prob_true_class", F.when(F.col(true) == "conifer", F.col("prob_conifer")).otherwise(F.col("prob_broadleaf")))
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def _accuracy() -> list[Column]:
    return [F.count("*").alias("n_rows"), F.avg(F.col("correct").cast("double")).alias("row_accuracy"), F.avg("max_prob").alias("mean_confidence"), F.avg("valid_measurements").alias("mean_valid_measurements")]


def accuracy_by(flagged: DataFrame, key: str) -> DataFrame:
    return flagged.dropna(subset=[key]).groupBy(key).agg(*_accuracy())


def error_counts(flagged: DataFrame) -> DataFrame:
    return flagged.where(~F.col("correct")).dropna(subset=["genus_name", "error_type"]).groupBy("genus_name", "error_type").agg(F.count("*").alias("n_errors"))


#: Values that the first pass of ``quantiles`` keeps for a group.
ACCURACY = 20_000


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``q``: exact quantiles of the values that are not NULL, with
    linear interpolation, NULL without values.

    A sketch brackets every quantile. A second pass counts the values below
    each bracket and gathers, by value, only those inside (about four in
    ACCURACY) and the nearest on either side; ranks among these are exact. No
    task holds the distinct values of a group. ``by`` must have few groups.
    """
    off = 2 / ACCURACY
    sides = [min(1.0, max(0.0, s + d)) for s in shares for d in (-off, off)]
    x = df.select(*by, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    sketch = x.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("x", sides, ACCURACY).alias("side"))
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share"), F.get("side", F.lit(2 * i)).alias("low"), F.get("side", F.lit(2 * i + 1)).alias("high")) for i, s in enumerate(shares)])
    spans = F.broadcast(sketch.select(*by, "n", spans.alias("spans")))  # a row for each group
    met = x.join(spans, list(by)) if by else x.crossJoin(spans)
    inside = F.filter("spans", lambda s: F.col("x").between(s["low"], s["high"]))
    own = met.select(*by, "n", "x", F.explode(inside).alias("s")).groupBy(*by, "n", "x", "s").agg(F.count("*").alias("m"))
    side = lambda s, below: F.struct(
        F.count_if(F.col("x") < s["low"]).alias("m"), F.max(F.when(F.col("x") < s["low"], F.col("x"))).alias("x")
    ) if below else F.min(F.when(F.col("x") > s["high"], F.col("x")))
    each = [F.get("spans", F.lit(i)) for i in range(len(shares))]
    around = met.groupBy(*by, "n", "spans").agg(*[side(s, True).alias(f"under{i}") for i, s in enumerate(each)], *[side(s, False).alias(f"over{i}") for i, s in enumerate(each)])
    edges = [e for i, s in enumerate(each) for e in (F.struct(s.alias("s"), F.col(f"under{i}.x").alias("x"), F.col(f"under{i}.m").alias("m"), F.lit(True).alias("below")), F.struct(s.alias("s"), F.col(f"over{i}").alias("x"), F.lit(1).cast("long").alias("m"), F.lit(False).alias("below")))]
    outside = around.select(*by, "n", F.explode(F.array(*edges)).alias("e")).select(*by, "n", "e.s", "e.x", "e.m").where("x IS NOT NULL")
    upto = F.sum("m").over(Window.partitionBy(*by, "s").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = own.select(*by, "n", "s", "x", "m").union(outside).withColumn("upto", upto)
    at = F.col("s.share") * (F.col("n") - 1)
    has = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("m") <= rank), F.col("x")))
    found = ranked.groupBy(*by, "s", "n").agg(has(F.floor(at)).alias("a"), has(F.ceil(at)).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))
    per = found.select(*by, F.col("s.i").alias("i"), value.alias("v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("q"))
    return per.select(*by, F.array(*[F.try_element_at("q", F.lit(i)) for i in range(len(shares))]).alias("q"))


def quantile_edges(df: DataFrame, column: str, q: int) -> DataFrame:
    """One row of the distinct quantile edges, to nine places."""
    return quantiles(df, column, [i / q for i in range(q + 1)]).select(F.array_distinct(F.transform("q", lambda x: F.round(x, 9))).alias("edges"))


def quantile_bins(df: DataFrame, column: str, q: int) -> DataFrame:
    """``bin`` (1 is the lowest), and its bounds: right-closed, the lowest
    value included, equal edges merged; NULL has no bin."""
    met = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(quantile_edges(df, column, q)))  # one row
    below = F.size(F.filter("edges", lambda e: e < F.round(F.col(column).cast("double"), 9)))
    met = met.withColumn("bin", F.greatest(below, F.lit(1)))
    return met.withColumn("bin_left", F.get("edges", F.col("bin") - 1)).withColumn("bin_right", F.coalesce(F.get("edges", F.col("bin")), F.get("edges", F.col("bin") - 1))).drop("edges")


def accuracy_by_bin(flagged: DataFrame, column: str = "valid_measurements", q: int = 5) -> DataFrame:
    return quantile_bins(flagged, column, q).groupBy("bin", "bin_left", "bin_right").agg(*_accuracy())


def deciles(df: DataFrame, column: str, by: str, value: str, q: int = 10) -> DataFrame:
    """By bin and class. The median is found without holding a group's
    values together; a group without values has none."""
    binned = quantile_bins(df, column, q)
    middle = quantiles(binned, value, [0.5], ["bin", by]).select("bin", by, F.get("q", F.lit(0)).alias("median_value"))
    return binned.groupBy("bin", by).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).join(F.broadcast(middle), ["bin", by], "left")


def confident_errors(flagged: DataFrame, least: float = 0.90) -> DataFrame:
    return flagged.where(~F.col("correct") & (F.col("max_prob") >= least)).orderBy(F.desc_nulls_last("max_prob"), "uniqueID", "year")


def tree_error_rows(row_flagged: DataFrame, tree_flagged: DataFrame) -> DataFrame:
    """Rows of the trees that are wrong; shared columns get _row and _tree."""
    errors = tree_flagged.where(~F.col("correct")).select("uniqueID", "y_true_name", "y_pred_fused_name", "error_type")
    return join_suffixed(row_flagged, errors, "uniqueID", ("_row", "_tree"))


def with_genus(tree_flagged: DataFrame, rows: DataFrame) -> DataFrame:
    first = keep_first(rows.select("uniqueID", "year", "genus_name"), ["uniqueID"], ["year"]).select("uniqueID", "genus_name")
    return tree_flagged.join(first, "uniqueID", "left")


def tree_accuracy_by_genus(named: DataFrame) -> DataFrame:
    return named.dropna(subset=["genus_name"]).groupBy("genus_name").agg(F.count("*").alias("n_trees"), F.avg(F.col("correct").cast("double")).alias("tree_accuracy"), F.count_if(~F.col("correct")).alias("n_errors"))


def cross_tab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)


def describe(df: DataFrame, column: str) -> DataFrame:
    every = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    met = every.join(quantiles(df, column, [0.25, 0.5, 0.75]), F.lit(True), "left")  # one row each
    return met.select("count", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(f"p{n}") for i, n in enumerate((25, 50, 75))], "max")
