"""Yearly class probabilities to one decision per tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import steady
from ..functions.labels import argmax2, class_name

LEAST = 1e-8
CONIFER_BIAS = 0.05
TINY = 1e-12


def _log(p: str) -> Column:
    return F.ln(F.least(F.greatest(F.col(p), F.lit(LEAST)), F.lit(1.0)))


def _weighted(total: Column, x: Column, w: Column) -> Column:
    return F.when(total, F.avg(x)).otherwise(F.sum(w * x) / F.sum(w))


def simple(rows: DataFrame, weight: str = "valid_measurements") -> DataFrame:
    """Weighted mean of log probabilities, renormalised; equal weights if they sum to 0."""
    w = F.col(weight).cast("double")
    none = F.sum(w) == 0
    g = rows.groupBy("uniqueID").agg(
        F.max("y_true").alias("y_true"), _weighted(none, _log("prob_conifer"), w).alias("a"), _weighted(none, _log("prob_broadleaf"), w).alias("b"), F.sum(w).alias("total_weight")
    )
    p = F.exp("a") / (F.exp("a") + F.exp("b"))
    return g.select("uniqueID", "y_true", argmax2(steady(p), steady(1 - p)).alias("y_pred_fused"), p.alias("prob_conifer"), "total_weight")


def temporal(rows: DataFrame, weight: str = "valid_measurements", bias: float = CONIFER_BIAS, conifer_max: float = 0.0) -> DataFrame:
    """As ``simple``, with a bias to conifers, whose score blends by
    ``conifer_max`` with its largest of all years; the larger score decides."""
    w = F.col(weight).cast("double")
    none = F.sum(w) <= 0
    g = rows.groupBy("uniqueID").agg(
        F.count("*").alias("n_years"), F.sum(w).alias("total_weight"), F.max("y_true").alias("y_true"),
        _weighted(none, _log("prob_conifer"), w).alias("a"), _weighted(none, _log("prob_broadleaf"), w).alias("b"),
        F.max(_log("prob_conifer")).alias("top_a"),
    )
    g = g.withColumn("a", F.lit(1 - conifer_max) * F.col("a") + F.lit(conifer_max) * F.col("top_a") + F.lit(bias))
    top = F.greatest("a", "b")
    ea, eb = F.exp(F.col("a") - top), F.exp(F.col("b") - top)
    pred = argmax2(steady("a"), steady("b"))
    return g.select(
        "uniqueID", "n_years", "total_weight", "y_true", pred.alias("y_pred_fused"), class_name(F.col("y_true")).alias("y_true_name"), class_name(pred).alias("y_pred_fused_name"), (ea / (ea + eb)).alias("prob_conifer")
    )


def mean_log(rows: DataFrame) -> DataFrame:
    """Unweighted mean of log probabilities; the larger decides."""
    g = rows.groupBy("uniqueID").agg(F.max("y_true").alias("y_true"), F.avg(F.ln(F.col("prob_conifer") + F.lit(TINY))).alias("a"), F.avg(F.ln(F.col("prob_broadleaf") + F.lit(TINY))).alias("b"))
    return g.select("uniqueID", "y_true", argmax2(steady("a"), steady("b")).alias("y_pred"), F.col("a").alias("log_conifer"), F.col("b").alias("log_broadleaf"))


def decide(prob_conifer: Column, threshold: float | None = None) -> Column:
    """Class of a probability: by threshold, or the larger of the two."""
    return F.when(prob_conifer >= F.lit(0.5 if threshold is None else threshold), 0).otherwise(1)


def normalised_weights(rows: DataFrame, weight: str = "valid_measurements") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("uniqueID")
    total = F.sum(F.col(weight).cast("double")).over(w)
    return rows.withColumn("weight", F.when(total <= 0, F.lit(1.0) / F.count("*").over(w)).otherwise(F.col(weight) / total))
