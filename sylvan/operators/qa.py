"""Neighbourhood quality flags, the threshold sweep and its best setting."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .evaluate import metrics

# The grid.
TOTALS, OPPOSITES, RATES = (1, 2, 3), (1, 2, 3), (0.0, 0.1, 0.2, 0.3, 0.4)
PRED_TOTALS, DISAGREEING, PRED_RATES = (1, 2, 3), (1, 2, 3), (0.1, 0.2, 0.3, 0.4, 0.5)
NEVER = 999999  # stands for a parameter that doesn't apply
PARAMETERS = ("min_total", "min_opposite", "min_rate", "use_predicted", "min_pred_total", "min_disagree", "min_pred_rate")
GRID = "grid_ordinal int, min_total int, min_opposite int, min_rate double, use_predicted boolean, min_pred_total int, min_disagree int, min_pred_rate double"
SCORES = ("accuracy", "macro_f1", "weighted_f1", "conifer_f1", "broadleaf_f1", "conifer_recall", "broadleaf_recall", "conifer_precision", "broadleaf_precision")


def grid(spark: SparkSession) -> DataFrame:
    """2,070 settings in loop order; ordinals decide ties."""
    rows = []
    for a, b, c in product(TOTALS, OPPOSITES, RATES):
        rows += [(a, b, c, False, None, None, None), *((a, b, c, True, d, e, f) for d, e, f in product(PRED_TOTALS, DISAGREEING, PRED_RATES))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], GRID)


def flags(n: Column, opposite: Column, disagree: Column, p: dict[str, Column]) -> tuple[Column, Column]:
    """(true-mixed, predicted-mixed) under parameters; no neighbours rate 0."""
    rate = lambda x: F.coalesce(ratio(x, n), F.lit(0.0))
    off = lambda c: F.coalesce(c, F.lit(NEVER))
    mixed = (n >= p["min_total"]) & (opposite >= p["min_opposite"]) & (rate(opposite) >= p["min_rate"])
    predicted = p["use_predicted"] & (n >= off(p["min_pred_total"])) & ((disagree >= off(p["min_disagree"])) | (rate(disagree) >= off(p["min_pred_rate"])))
    return mixed, predicted


_N, _O, _D = "n_neighbors_within_radius", "n_true_opposite_neighbors_within_radius", "n_pred_disagree_neighbors_within_radius"


def apply_flags(base: DataFrame, setting: dict) -> DataFrame:
    p = {k: F.lit(setting[k]) for k in PARAMETERS}
    mixed, predicted = flags(F.col(_N), F.col(_O), F.col(_D), p)
    out = base.withColumn("true_mixed_QA_flag", mixed).withColumn("predicted_mixed_QA_flag", F.coalesce(predicted, F.lit(False)))
    return out.withColumn("remove_by_mixed_QA", F.col("true_mixed_QA_flag") | F.col("predicted_mixed_QA_flag"))


def sweep(base: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Every setting on every group. Flags depend on three counts only, so
    records are first counted by them; the grid meets those few rows."""
    settings = grid(base.sparkSession) if settings is None else settings
    small = base.groupBy("train_status", "true_label", "pred_label", _N, _O, _D).agg(F.count("*").alias("m"))
    met = small.crossJoin(F.broadcast(settings))  # 2,070 rows
    mixed, predicted = flags(F.col(_N), F.col(_O), F.col(_D), {k: F.col(k) for k in PARAMETERS})
    kept = ~(mixed | F.coalesce(predicted, F.lit(False)))
    cell = lambda t, p: F.coalesce(F.sum(F.when(kept & (F.col("true_label") == t) & (F.col("pred_label") == p), F.col("m"))), F.lit(0)).alias(f"n{t}{p}")
    keys = ["grid_ordinal", *PARAMETERS, "train_status"]
    counts = met.groupBy(*keys).agg(F.sum("m").alias("n_total_before_QA"), *[cell(t, p) for t in (0, 1) for p in (0, 1)])
    counts = counts.withColumn("n_evaluated_after_QA", F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    scores = metrics()
    removed = F.col("n_total_before_QA") - F.col("n_evaluated_after_QA")
    return counts.select(
        *keys, "n_total_before_QA", "n_evaluated_after_QA", removed.alias("n_removed_by_QA"), ratio(removed, "n_total_before_QA").alias("removed_fraction"),
        *[F.when(F.col("n_evaluated_after_QA") > 0, scores[s]).alias(s) for s in SCORES],
    )


def candidates(swept: DataFrame, group: str = "non_training", most: float = 0.5, least: int = 100) -> DataFrame:
    return swept.where((F.col("train_status") == group) & (F.col("removed_fraction") <= most) & (F.col("n_evaluated_after_QA") >= least))


def best(found: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """The best row; equal rows by the order of the grid."""
    order = [F.desc_nulls_last(c) for c in (metric, "conifer_f1", "macro_f1", "accuracy")]
    return found.orderBy(*order, F.asc_nulls_last("removed_fraction"), "grid_ordinal").limit(1)


def qa_summary(flagged: DataFrame) -> DataFrame:
    n = F.count("uniqueID")
    out = flagged.groupBy("train_status", "split").agg(
        n.alias("n_total"), F.count_if("remove_by_mixed_QA").alias("n_removed_by_mixed_QA"), F.count_if("true_mixed_QA_flag").alias("n_true_mixed_QA"), F.count_if("predicted_mixed_QA_flag").alias("n_predicted_mixed_QA"),
        F.avg(_N).alias("mean_neighbors"), F.avg(_O).alias("mean_true_opposite_neighbors"), F.avg("true_opposite_neighbor_rate").alias("mean_true_opposite_rate"),
        F.avg(_D).alias("mean_pred_disagree_neighbors"), F.avg("neighbor_prediction_disagreement_rate").alias("mean_pred_disagreement_rate"),
    )
    return out.withColumn("pct_removed_by_mixed_QA", ratio("n_removed_by_mixed_QA", "n_total"))
