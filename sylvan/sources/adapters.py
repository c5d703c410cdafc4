"""The engine's logical tables as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point samples: a row for each tree, date and acquisition order."""
    x, q, d, n = F.col("l_tax"), F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("uniqueID"), F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("ord1"), n.alias("ord2"),
        F.when(n != 7, x + 0.01).alias("B2"), (x + 0.02).alias("B3"), (d + 0.01).alias("B4"), (0.05 + d * 0.5 + x * 0.5).alias("B5"),
        (0.10 + q / 200.0).alias("B6"), (0.12 + q / 150.0).alias("B7"), F.when(n != 6, 0.05 + q / 100.0).alias("B8"),
        (0.06 + q / 100.0).alias("B8A"), (0.05 + d).alias("B11"), (0.04 + x).alias("B12"),
    )


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"PROMO": "Picea", "SMALL": "Pinus", "ECONOMY": "Acer", "LARGE": "Quercus", "MEDIUM": "Ginkgo"}
    genus = F.lit("Salix")
    for kind, name in kinds.items():
        genus = F.when(F.col("p_type") == kind, name).otherwise(genus)
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("uniqueID"), (F.col("p_size").cast("double") * 20).alias("X_COORD"), ((key * 7 % 400).cast("double") * 25).alias("Y_COORD"), genus.alias("BOTANICALG")
    )


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("uniqueID"), "ts", (263.15 + v / 10.0).alias("temperature_2m"),
        ((F.col("event_id") % 7).cast("double") / 1000).alias("total_precipitation_hourly"), (v * 1000.0).alias("surface_solar_radiation_downwards_hourly"),
    )


WEATHER = ("temp_mean_7d_c", "temp_mean_14d_c", "temp_mean_30d_c", "precip_sum_7d_mm", "precip_sum_14d_mm", "precip_sum_30d_mm", "srad_sum_7d_j_m2", "srad_sum_14d_j_m2", "srad_sum_30d_j_m2", "gdd_cum_ytd_base10_c")


def weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather of four in five observation days, made from keys."""
    day = obs(spark, sf_dir).select("uniqueID", "date").distinct().where((F.col("uniqueID") + F.dayofyear("date")) % 5 != 0)
    k = F.col("uniqueID") * 3 + F.dayofyear("date")
    return day.select("uniqueID", "date", *[((k * (i + 2)) % (29 + 2 * i)).cast("double").alias(c) for i, c in enumerate(WEATHER)])


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("scene_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") * 7 % 101).cast("double").alias("cloud_pct"))


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud images: two thirds of the scenes have one, some have two."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts"))
    one = o.where("k % 3 <> 0").withColumn("image", F.col("k") * 2)
    return one.union(o.where("k % 6 = 1").withColumn("image", F.col("k") * 2 + 1)).select(F.col("k").cast("string").alias("scene_id"), "ts", "image")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band samples of scenes at points, with a scene class and a cloud probability."""
    o = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        o.cast("string").alias("scene_id"), F.col("l_partkey").alias("uniqueID"), F.col("l_linenumber").alias("line"), (F.col("l_discount") + 0.01).alias("B4"), (0.05 + F.col("l_quantity") / 100.0).alias("B8"),
        ((o + F.col("l_linenumber")) % 12).cast("int").alias("scl"), ((o * 13 + F.col("l_linenumber") * 7) % 100).cast("double").alias("probability"),
    )


def row_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of tree-years: probabilities, true class and split from keys."""
    years = obs(spark, sf_dir).groupBy("uniqueID", F.year("date").alias("year")).agg((F.count("B2") + F.count("B8") + 8 * F.count("*")).alias("valid_measurements"))
    p = ((F.col("uniqueID") * 37 + F.col("year") * 11) % 101).cast("double") / 100
    last = F.col("uniqueID") % 10
    named = years.join(trees(spark, sf_dir).where("BOTANICALG <> 'Salix'").select("uniqueID", F.col("BOTANICALG").alias("genus_name")), "uniqueID")
    y_true = F.when(F.col("genus_name").isin("Picea", "Pinus"), 0).otherwise(1)
    full = named.select(
        "uniqueID", "year", "genus_name", "valid_measurements", y_true.alias("y_true"), p.alias("prob_conifer"), (1.0 - p).alias("prob_broadleaf"),
        F.when(last < 8, "train").when(last == 8, "val").otherwise("test").alias("split"),
    )
    y_pred = F.when(F.col("prob_conifer") >= F.col("prob_broadleaf"), 0).otherwise(1)
    name = lambda c: F.when(c == 0, "conifer").otherwise("broadleaf")
    return full.withColumn("y_pred", y_pred).withColumn("y_true_name", name(F.col("y_true"))).withColumn("y_pred_name", name(F.col("y_pred")))
