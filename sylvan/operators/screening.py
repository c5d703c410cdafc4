"""Summer NDVI and brightness summaries, threshold screens, selectivity."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import same, steady
from ..functions.indices import with_raw

# The thresholds.
NDVI_BELOW = (0.30, 0.35, 0.40, 0.45, 0.50)
BRIGHTER_THAN = (0.06, 0.08, 0.10, 0.12, 0.14, 0.16)
TREE_KEYS = ("uniqueID", "genus_name", "y_true_name", "y_pred_fused_name", "tree_correct", "tree_error_type")
SCREEN_KEYS = ("level", "ndvi_metric", "brightness_metric", "ndvi_threshold", "brightness_threshold", "rule", "error_col")


def _years(raw: DataFrame) -> DataFrame:
    return raw.withColumn("year", F.year("date"))


def _summer(when) -> list[Column]:
    """Summer's aggregates of the values that ``when`` lets through."""
    n, b = when(F.col("raw_NDVI")), when(F.col("raw_visible_brightness"))
    return [
        F.avg(n).alias("raw_NDVI_summer_mean"), F.min(n).alias("raw_NDVI_summer_min"), F.max(n).alias("raw_NDVI_summer_max"), F.stddev_samp(n).alias("raw_NDVI_summer_std"),
        F.avg(b).alias("raw_visible_brightness_summer_mean"), F.max(b).alias("raw_visible_brightness_summer_max"),
        *[F.avg(when(F.col(f"raw_{c}_brightness"))).alias(f"raw_{c}_brightness_summer_mean") for c in ("red", "green", "blue")],
    ]


def _annual() -> list[Column]:
    n, b = F.col("raw_NDVI"), F.col("raw_visible_brightness")
    return [F.avg(n).alias("raw_NDVI_annual_mean"), F.min(n).alias("raw_NDVI_annual_min"), F.max(n).alias("raw_NDVI_annual_max"), F.avg(b).alias("raw_visible_brightness_annual_mean"), F.count(n).alias("n_annual_obs")]


def summer_summary(raw: DataFrame) -> DataFrame:
    rows = _years(raw).where(F.month("date").isin(6, 7, 8))
    return rows.groupBy("uniqueID", "year").agg(*_summer(lambda c: c), F.count("raw_NDVI").alias("n_summer_obs"))


def annual_summary(raw: DataFrame) -> DataFrame:
    return _years(raw).groupBy("uniqueID", "year").agg(*_annual())


def tree_year_summary(obs: DataFrame) -> DataFrame:
    """Annual summaries, and summer's where the year has one (NULL elsewhere):
    the left join of the two as one aggregation, so with one shuffle."""
    summer = F.month("date").isin(6, 7, 8)
    any_summer = F.when(F.count_if(summer) > 0, F.count(F.when(summer, F.col("raw_NDVI"))))
    return _years(with_raw(obs)).groupBy("uniqueID", "year").agg(*_annual(), *_summer(lambda c: F.when(summer, c)), any_summer.alias("n_summer_obs"))


def error_label(true: Column, pred: Column) -> Column:
    return (
        F.when(same(true, pred), "correct")
        .when(same(true, F.lit("conifer")), "conifer_false_negative")
        .otherwise("broadleaf_false_positive")
    )


def tree_years(summaries: DataFrame, rows: DataFrame, fused: DataFrame) -> DataFrame:
    """Summaries with predictions of the row, and of the tree where it has one."""
    x = summaries.join(rows.select("uniqueID", "year", "genus_name", "y_true_name", "y_pred_name", "prob_conifer", "prob_broadleaf", "valid_measurements"), ["uniqueID", "year"])
    x = x.join(fused.select("uniqueID", "y_pred_fused_name"), "uniqueID", "left")
    t = F.col("y_true_name")
    return x.withColumns(
        {"row_correct": same(t, F.col("y_pred_name")), "row_error_type": error_label(t, F.col("y_pred_name")), "tree_correct": same(t, F.col("y_pred_fused_name")), "tree_error_type": error_label(t, F.col("y_pred_fused_name"))}
    )


def tree_summary(tree_year: DataFrame) -> DataFrame:
    """Nineteen aggregates per tree; rows with a NULL key go first."""
    s = "raw_NDVI_summer_mean"
    b = "raw_visible_brightness_summer"
    return tree_year.dropna(subset=list(TREE_KEYS)).groupBy(*TREE_KEYS).agg(
        F.avg("prob_conifer").alias("mean_prob_conifer"), F.max("prob_conifer").alias("max_prob_conifer"), F.min("prob_conifer").alias("min_prob_conifer"), F.avg("prob_broadleaf").alias("mean_prob_broadleaf"),
        F.avg(s).alias(f"mean_{s}"), F.min(s).alias(f"min_{s}"), F.max(s).alias(f"max_{s}"), F.avg("raw_NDVI_summer_std").alias("mean_raw_NDVI_summer_std"),
        F.avg(f"{b}_mean").alias(f"mean_{b}_mean"), F.max(f"{b}_mean").alias(f"max_{b}_mean"), F.avg(f"{b}_max").alias(f"mean_{b}_max"),
        *[F.avg(f"raw_{c}_brightness_summer_mean").alias(f"mean_raw_{c}_brightness_summer_mean") for c in ("red", "green", "blue")],
        F.avg("raw_NDVI_annual_mean").alias("mean_raw_NDVI_annual_mean"), F.avg("raw_visible_brightness_annual_mean").alias("mean_raw_visible_brightness_annual_mean"),
        F.count_distinct("year").alias("n_years"), F.count(s).alias("n_years_with_summer_obs"), F.coalesce(F.sum("valid_measurements"), F.lit(0)).alias("total_valid_measurements"),
    )


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(product(NDVI_BELOW, BRIGHTER_THAN)), "ndvi_threshold double, brightness_threshold double")


#: level, NDVI and brightness metric, error column
LEVELS = (
    ("tree_mean_across_years", "mean_raw_NDVI_summer_mean", "mean_raw_visible_brightness_summer_mean", "tree_error_type"),
    ("tree_min_ndvi_max_brightness_across_years", "min_raw_NDVI_summer_mean", "max_raw_visible_brightness_summer_mean", "tree_error_type"),
    ("tree_year", "raw_NDVI_summer_mean", "raw_visible_brightness_summer_mean", "row_error_type"),
)


def screen(stacked: DataFrame) -> DataFrame:
    """What each pair of thresholds removes, by true class and error type.
    Rows (level, y_true_name, error_type, x, b) are counted once by how many
    thresholds of either kind they pass; the 30 pairs meet those counts."""
    x, b = steady("x"), steady("b")
    below = sum(((x < F.lit(t)).cast("int") for t in NDVI_BELOW), F.lit(0))
    above = sum(((b > F.lit(t)).cast("int") for t in BRIGHTER_THAN), F.lit(0))
    keys = ["level", "y_true_name", "error_type"]
    counts = stacked.dropna(subset=["x", "b", "y_true_name", "error_type"]).groupBy(*keys, below.alias("below"), above.alias("above")).agg(F.count("*").alias("m"))
    pairs = [(i, j, n, t) for i, n in enumerate(NDVI_BELOW) for j, t in enumerate(BRIGHTER_THAN)]
    grid = stacked.sparkSession.createDataFrame(pairs, "i int, j int, ndvi_threshold double, brightness_threshold double")
    passes = (F.col("below") >= len(NDVI_BELOW) - F.col("i")) & (F.col("above") > F.col("j"))
    out = counts.crossJoin(F.broadcast(grid)).groupBy(*keys, "ndvi_threshold", "brightness_threshold").agg(F.sum("m").alias("n_total"), F.sum(F.when(passes, F.col("m")).otherwise(0)).alias("n_removed"))  # 30 rows
    named = lambda at: F.create_map(*[F.lit(v) for row in LEVELS for v in (row[0], row[at])])[F.col("level")]
    out = out.withColumn("ndvi_metric", named(1)).withColumn("brightness_metric", named(2)).withColumn("error_col", named(3))
    return out.select(
        "level", "ndvi_metric", "brightness_metric", "ndvi_threshold", "brightness_threshold",
        F.concat("ndvi_metric", F.lit(" < "), F.col("ndvi_threshold").cast("string"), F.lit(" AND "), "brightness_metric", F.lit(" > "), F.col("brightness_threshold").cast("string")).alias("rule"),
        "error_col", "y_true_name", "error_type", "n_total", "n_removed", (100 * F.col("n_removed") / F.col("n_total")).alias("pct_removed"),
    )


def all_screens(tree_year: DataFrame) -> DataFrame:
    """The three levels from one aggregation: a tree's means and extremes,
    where none of its keys is missing, and its years."""
    n, b = LEVELS[2][1:3]
    year = F.struct("y_true_name", F.col("row_error_type").alias("error_type"), F.col(n).alias("x"), F.col(b).alias("b"))
    trees = tree_year.groupBy(*TREE_KEYS).agg(F.avg(n).alias("x0"), F.avg(b).alias("b0"), F.min(n).alias("x1"), F.max(b).alias("b1"), F.collect_list(year).alias("years"))
    whole = F.lit(True)
    for c in TREE_KEYS:
        whole = whole & F.col(c).isNotNull()
    row = lambda level, err, x, b: F.struct(F.lit(level).alias("level"), F.col("y_true_name"), err.alias("error_type"), x.alias("x"), b.alias("b"))
    own = F.when(whole, F.array(*[row(LEVELS[i][0], F.col("tree_error_type"), F.col(f"x{i}"), F.col(f"b{i}")) for i in (0, 1)])).otherwise(F.array())
    years = F.transform("years", lambda y: F.struct(F.lit(LEVELS[2][0]).alias("level"), y["y_true_name"].alias("y_true_name"), y["error_type"].alias("error_type"), y["x"].alias("x"), y["b"].alias("b")))
    return screen(trees.select(F.explode(F.concat(own, years)).alias("r")).select("r.*"))


def selectivity(screens: DataFrame) -> DataFrame:
    """Shares removed of each kind of record, and their differences."""
    is_ = lambda label, err: (F.col("y_true_name") == label) & (F.col("error_type") == err)
    kinds = {"conifer_false_negative": is_("conifer", "conifer_false_negative"), "correct_conifer": is_("conifer", "correct"), "correct_broadleaf": is_("broadleaf", "correct"), "broadleaf_false_positive": is_("broadleaf", "broadleaf_false_positive")}
    out = screens.groupBy(*SCREEN_KEYS).agg(
        *[F.max(F.when(c, F.col("pct_removed"))).alias(f"pct_removed_{k}") for k, c in kinds.items()],
        *[F.coalesce(F.max(F.when(kinds[k], F.col("n_removed"))), F.lit(0)).alias(f"n_removed_{k}") for k in list(kinds)[:3]],
    )
    fn = F.col("pct_removed_conifer_false_negative")
    return out.withColumn("selectivity_vs_correct_broadleaf", fn - F.col("pct_removed_correct_broadleaf")).withColumn("selectivity_vs_correct_conifer", fn - F.col("pct_removed_correct_conifer"))


def by_selectivity(found: DataFrame) -> DataFrame:
    return found.orderBy(*[F.desc_nulls_last(c) for c in ("selectivity_vs_correct_broadleaf", "selectivity_vs_correct_conifer", "pct_removed_conifer_false_negative")], *SCREEN_KEYS)


