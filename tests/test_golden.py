"""Small cases with answers worked out by hand or from the formulas."""

import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylvan.functions import expr, indices, labels
from sylvan.operators import dedup, evaluate, fusion, phenology, qa, reports, spatial, split, treeyear, weather
from sylvan.sources import files, spines

NEAR = pytest.approx


def near(x):
    return pytest.approx(x, abs=2e-6)


BANDS = "B3 double, B4 double, B5 double, B6 double, B7 double, B8 double, B8A double, B11 double"


def index_row(spark, *values):
    return spark.createDataFrame([values], BANDS).select(*[c.alias(n) for n, c in indices.indices().items()]).first()


def test_indices(spark):
    a = index_row(spark, 0.05, 0.10, 0.12, 0.20, 0.25, 0.30, 0.32, 0.15)
    want = dict(NDVI=0.5, GNDVI=0.714286, CIg=5, CIre=1.666667, MTCI=4, MCARI=0.0072, NDVIre1=0.428571, NDVIre2=0.2, REPI=727.5, NDII=0.333333, MSAVI=0.310102, LAI_ndvi=0.18885, LAI_re=0.985333)
    for k, v in want.items():
        assert a[k] == near(v), k
    b = index_row(spark, 0.05, 0.01, 0.08, 0.20, 0.25, 0.90, 0.32, 0.15)
    assert b["LAI_ndvi"] is None and b["LAI_re"] == 1 and b["MCARI"] == near(0.512) and b["REPI"] == near(716.666667)
    c = index_row(spark, 0.05, 0.08, 0.08, 0.20, 0.25, 0.90, 0.32, 0.15)
    assert c["MTCI"] == NEAR(1.2e9, rel=1e-6)
    d = index_row(spark, 0.05, 0.08, 0.08, 0.20, 0.25, None, 0.32, 0.15)
    assert d["NDVI"] is None and d["LAI_ndvi"] is None


def test_null_expressions(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0), (None, None), (3.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(expr.nullify("a"), expr.clip("a", 0, 2), expr.ratio("a", "b"), expr.row_mean("a", "b")).collect()]
    assert [g[0] for g in got] == [None, None, None, 3.0]
    assert got[2] == (None, None, None, None) and got[3][1:] == (2.0, None, 1.5)


def pheno(spark, rows):
    df = spark.createDataFrame([(1, dt.date(2023, *d), float(v), None, i, 0) for i, (d, v) in enumerate(rows)], "uniqueID long, date date, NDVI double, CIre double, ord1 long, ord2 long")
    return phenology.features(phenology.steps(phenology.long_form(df))).first()


def test_phenology(spark):
    r = pheno(spark, [((1, 15), 0.2), ((4, 10), 0.5), ((7, 1), 0.8), ((8, 30), 0.8), ((11, 5), 0.3)])
    want = dict(mean=0.52, std=0.248193, range=0.6, doy_max_sin=0.008607, doy_max_cos=-0.999963, doy_min_sin=0.255353, doy_min_cos=0.966848, center_green_sin=-0.068802, center_green_cos=-0.99763, max_positive_slope=0.003659, max_negative_slope=-0.007463, frac_above_yearly_mean=0.4, frac_time_above_yearly_mean=0.710884, frac_time_above_80pct_max=0.482993, spring_minus_winter=0.3, fall_minus_summer=-0.5)
    for k, v in want.items():
        assert r[k] == near(v), k


def test_seasonal_fallback(spark):
    rows = [((1, 5), 0.1), ((3, 5), 0.4), ((5, 5), 0.6), ((7, 5), 0.9)]
    df = spark.createDataFrame([(1, dt.date(2023, *d), v) for d, v in rows], "uniqueID long, date date, NDVI double")
    r = treeyear.seasonal_ndvi(df).first()
    assert (r.NDVI_winter_mean, r.NDVI_spring_mean, r.NDVI_summer_mean, r.NDVI_fall_mean) == tuple(map(near, (0.1, 0.5, 0.9, 0.5)))
    assert r.NDVI_spring_minus_winter == near(0.4) and r.NDVI_fall_minus_summer == near(-0.4) and r.NDVI_share_above_mean == near(0.5)


FUSED = [(1, 2020, 10, 0.6), (1, 2021, 30, 0.4), (2, 2020, 0, 0.7), (2, 2021, 0, 0.2), (3, 2020, 5, 0.5), (4, 2020, 5, 0.49)]


def test_fusion(spark):
    df = spark.createDataFrame([(*r, 1 - r[3], 0) for r in FUSED], "uniqueID long, year int, valid_measurements long, prob_conifer double, prob_broadleaf double, y_true int")
    s = {r.uniqueID: (r.prob_conifer, r.y_pred_fused) for r in fusion.simple(df).collect()}
    t = {r.uniqueID: (r.prob_conifer, r.y_pred_fused) for r in fusion.temporal(df).collect()}
    m = {r.uniqueID: r.prob_conifer for r in fusion.temporal(df, bias=0.0, conifer_max=1.0).collect()}
    assert m[1] == near(0.6 / (0.6 + math.exp((10 * math.log(0.4) + 30 * math.log(0.6)) / 40)))  # the largest of all years, for conifers alone
    assert s == {1: (near(0.449490), 1), 2: (near(0.433030), 1), 3: (near(0.5), 0), 4: (near(0.49), 1)}
    assert t == {1: (near(0.461891), 1), 2: (near(0.445345), 1), 3: (near(0.512497), 0), 4: (near(0.502499), 0)}


POINTS = [(1, 0.0, 0.0, 0, 0), (2, 0.0, 65.6, 1, 0), (3, 0.0, 131.3, 0, 1), (4, 500.0, 500.0, 1, 1), (5, 0.0, 0.0, 1, 1)]


def test_neighbours(spark):
    df = spark.createDataFrame(POINTS, "uniqueID long, X_COORD double, Y_COORD double, true_label int, pred_label int")
    got = {r.uniqueID: (r.n_neighbors_within_radius, r.n_true_opposite_neighbors_within_radius, r.n_pred_disagree_neighbors_within_radius, r.true_opposite_neighbor_rate) for r in spatial.neighbour_counts(df).collect()}
    assert got[1] == (2, 2, 1, 1.0) and got[2][:3] == (2, 1, 1) and got[3] == (0, 0, 0, None) and got[4] == (0, 0, 0, None) and got[5][:3] == (2, 1, 2)


def test_grid_join_is_the_theta_join(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 211), float(i * 91 % 173)) for i in range(200)], "uniqueID long, X_COORD double, Y_COORD double")
    got = {(r.a, r.b) for r in spatial.radius_pairs(df, 20.0).collect()}
    p = df.collect()
    assert got == {(a.uniqueID, b.uniqueID) for a in p for b in p if a.uniqueID != b.uniqueID and math.dist(a[1:], b[1:]) <= 20} and {(b, a) for a, b in got} == got


def test_trailing_window_has_gaps(spark):
    days = spark.createDataFrame([(1, dt.date(2024, 1, d), float(v), float(v), 1.0) for d, v in ((1, 10), (3, 20), (8, 30), (9, 40))], "uniqueID long, date date, tmean_c double, precip_mm double, srad_j double")
    got = [(r.temp_mean_7d_c, r.precip_sum_7d_mm) for r in weather.trailing(days, (7,)).orderBy("date").collect()]
    assert got == [(10, 10), (15, 30), (25, 50), (30, 90)]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3, 4, 10)], "x double")
    got = [tuple(r) for r in reports.quantile_bins(df, "x", 5).groupBy("bin", "bin_right").count().orderBy("bin").collect()]
    assert got == [(1, 2.2, 5), (2, 3.6, 1), (3, 10.0, 2)]


def test_quantiles_are_exact(spark, monkeypatch):
    """Brackets of a coarse sketch, ties and groups, against a plain sort."""
    monkeypatch.setattr(reports, "ACCURACY", 20)
    rows = [(g, float(v * v % 89) if v % 7 else None) for g, n in ((0, 1), (1, 2), (2, 30), (3, 700)) for v in range(1, n + 1)] + [(4, 1.0)] * 50 + [(5, None)]
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)

    def want(values):
        v = sorted(x for x in values if x is not None)
        at = [s * (len(v) - 1) for s in shares]
        return [near(v[math.floor(a)] + (v[math.ceil(a)] - v[math.floor(a)]) * (a - math.floor(a))) for a in at]

    got = {r.g: r.q for r in reports.quantiles(df, "x", shares, ["g"]).collect()}
    assert got == {g: want([x for h, x in rows if h == g]) for g in range(5)}
    assert reports.quantiles(df, "x", shares).first().q == want([x for _, x in rows])


def test_report(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(1, 1)] * 4
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    got = {r.class_or_average: r for r in evaluate.report(df).collect()}
    assert (got["conifer"].precision, got["conifer"].recall, got["conifer"].f1_score, got["conifer"].support) == (near(0.6), near(0.75), near(0.666667), 4)
    assert got["broadleaf"].f1_score == near(0.727273) and got["accuracy"].f1_score == near(0.7) and got["macro avg"].f1_score == near(0.69697) and got["accuracy"].precision is None
    lone = {r.class_or_average: r for r in evaluate.report(spark.createDataFrame([(0, 0)], "y_true int, y_pred int")).collect()}
    assert lone["broadleaf"].f1_score == 0
    assert sum(r.n for r in evaluate.confusion(df).collect()) == 10


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 25 + [(1,)] * 100, "y int")
    assert [r.weight for r in split.class_weights(df, "y").orderBy("class").collect()] == [near(1.5), near(0.5)]
    assert [r.weight for r in split.class_weights(df.where("y = 1"), "y").orderBy("class").collect()] == [0.0, near(1.0)]


def test_label_order(spark):
    rows = [(1, "Salix", 0), (1, "Acer", 1), (2, " Pinus ", 2), (3, None, 3), (4, None, 4), (4, "Acer", 5)]
    df = spark.createDataFrame(rows, "uniqueID long, g string, at int")
    label = labels.two_class(F.col("g"))
    first = dedup.keep_first(df, ["uniqueID"], ["at"]).withColumn("label", label).where("label IS NOT NULL")
    assert [(r.uniqueID, r.label) for r in first.collect()] == [(2, "conifer")]
    clean = dedup.keep_first(df.dropna(subset=["g"]), ["uniqueID"], ["at"]).withColumn("label", label).where("label IS NOT NULL")
    assert sorted((r.uniqueID, r.label) for r in clean.collect()) == [(2, "conifer"), (4, "broadleaf")]
    three = dedup.keep_first(df, ["uniqueID"], ["at"]).select("uniqueID", labels.three_class(F.col("g")).alias("x"))
    assert dict(map(tuple, three.collect())) == {1: "deciduous", 2: "conifer", 3: "deciduous", 4: "deciduous"}


def test_sweep_ties_and_totals(spark):
    base = spark.createDataFrame([(i, "non_training", "val", i % 2, (i // 2) % 2, 0, 0, 0) for i in range(120)], "uniqueID long, train_status string, split string, true_label int, pred_label int, n_neighbors_within_radius long, n_true_opposite_neighbors_within_radius long, n_pred_disagree_neighbors_within_radius long")
    swept = qa.sweep(base)
    assert swept.count() == 2070 and qa.best(qa.candidates(swept)).first().grid_ordinal == 0
    assert swept.where("n_removed_by_QA <> 0").count() == 0


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)] * 2, "id long, y int")
    got = split.stratified(df, "id", "y").collect()
    assert len(got) == 300 and {r.split for r in got} == {"train", "val", "test"} and sum(r.split == "test" for r in got) == 30
    assert {r["count"] for r in split.balanced(df.distinct().where("y <> 0 OR id < 100"), "y", "id").groupBy("y").count().collect()} == {34}


def test_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
    with pytest.raises(ValueError, match="missing columns: z"):
        files.require(df, ["id", "z"])
    with pytest.raises(ValueError, match="repeated keys"):
        dedup.join_one_to_one(df, df, "id")
    with pytest.raises(Exception):
        files.load_or_status(spark, "a", "b", str(tmp_path / "none"), required=True)
    files.write_cache(df, str(tmp_path / "c"), "one")
    with pytest.raises(ValueError, match="tag"):
        files.read_cache(spark, str(tmp_path / "c"), "two")
    assert spines.tumbling(spark, "2024-01-01", "2025-01-01").count() == 53


def test_weekly_stream(spark, tmp_path):
    from sylvan.streaming.windows import weekly_counts

    rows = [(dt.datetime(2024, 1, d, 6), float(d)) for d in (1, 7, 8, 30)]
    spark.createDataFrame(rows, "ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = weekly_counts(stream, "2024-01-10").writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.window_start.day, r.window_end.day, r.n) for r in spark.table("weekly").orderBy("window_start").collect()]
    assert got == [(1, 8, 2), (8, 10, 1)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_of_repeated_places(spark, monkeypatch):
    """Places that repeat, lists cut at BLOCK, a key at two places, nulls: pairs and counts against a plain loop."""
    monkeypatch.setattr(spatial, "BLOCK", 3)
    rows = [(i, float(i % 4) * 15, float(i % 3) * 20) for i in range(60)] + [(7, 0.0, 0.0), (7, 0.0, 0.0), (100, 900.0, 900.0), (100, 900.0, 900.0), (None, 0.0, 0.0), (101, None, 0.0), (102, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "uniqueID long, X_COORD double, Y_COORD double")
    whole = [r for r in rows if None not in r]
    want = sorted((a, b, round(math.hypot(x - u, y - v), 6)) for a, x, y in whole for b, u, v in whole if a != b and (x - u) ** 2 + (y - v) ** 2 <= 400)
    assert sorted((r.a, r.b, round(r.distance, 6)) for r in spatial.radius_pairs(df, 20.0).collect()) == want
    assert {r.a: r.n for r in spatial.radius_counts(df, 20.0).collect()} == Counter(a for a, _, _ in want)


def test_radius_pairs_broadcast_nothing(spark):
    """Spark expects the repeated side to be small: as a broadcast it filled the driver at 1.2 million trees."""
    df = spark.range(50).select(F.col("id").alias("uniqueID"), F.col("id").cast("double").alias("X_COORD"), F.lit(0.0).alias("Y_COORD"))
    near = spatial._near(df, 20.0, "X_COORD", "Y_COORD", {})
    assert "SortMergeJoin" in _plan(near) and "BroadcastExchange" not in _plan(near)
    assert "SortMergeJoin" in _plan(spatial.radius_pairs(df, 20.0))
