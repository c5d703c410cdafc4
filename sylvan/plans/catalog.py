"""Every operator as a query with its oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import indices as I
from ..functions import labels as L
from ..operators import acquire, dedup, evaluate, forest, fusion, ml, network, phenology, qa, reports, screening, spatial, split, treeyear, weather
from ..sources import adapters as A
from ..sources import config, files, spines
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
R, W = V.r, V.with_views


#: Parts of the names of columns that may hold a million or more.
LARGE = ("MTCI", "REPI", "srad", "total")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, whole numbers as longs: what oracles compare."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = X.rounded(c, large=any(x in f.name for x in LARGE))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, done: bool = False) -> Callable[[Query], Query]:
    """``done``: its columns are tidy already."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f if done else lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rs(*cols: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


def big(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


# ---------------------------------------------------------------- sources


@query("S1_scene_source", W("SELECT scene_id, " + rs("cloud_pct") + " FROM scenes WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01' AND cloud_pct <= 70", "scenes"))
def s1(s, d):
    return acquire.scene_source(A.scenes(s, d), "1996-01-01", "1997-01-01").select("scene_id", "cloud_pct")


@query("S2_cloud_source", W("SELECT scene_id, image FROM clouds WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'", "clouds"))
def s2(s, d):
    return acquire.in_period(A.clouds(s, d), "1996-01-01", "1997-01-01").select("scene_id", "image")


@query("S3_point_source", W("SELECT uniqueID, " + rs("X_COORD", "Y_COORD") + " FROM trees", "trees"))
def s3(s, d):
    return A.trees(s, d).select("uniqueID", "X_COORD", "Y_COORD")


def valid_dates(s, d):
    """Days on which any tree was observed."""
    return A.weather_hourly(s, d).select(F.to_date("ts").alias("date")).distinct()


_VALID = "SELECT DISTINCT CAST(ts AS DATE) AS date FROM weather_hourly"


@query("S4_weather_source", W("SELECT uniqueID, count(*) AS n FROM weather_hourly, (SELECT min(date) AS a, max(date) AS b FROM valid) WHERE ts >= a - INTERVAL 30 DAY AND ts < b + INTERVAL 1 DAY GROUP BY uniqueID", "weather_hourly", valid=_VALID))
def s4(s, d):
    low, high = valid_dates(s, d).agg(F.min("date"), F.max("date")).first()  # one row
    hours = A.weather_hourly(s, d)
    if low is not None:
        hours = hours.where((F.col("ts") >= F.date_sub(F.lit(low), 30).cast("timestamp")) & (F.col("ts") < F.date_add(F.lit(high), 1).cast("timestamp")))
    return hours.groupBy("uniqueID").agg(F.count("*").alias("n"))


def csv_copy(s, d, name):
    path = config.scratch(s, f"csv-{name}")
    files.write_table(A.table(s, d, name), path, "csv")
    return path


_CUSTOMER = "c_custkey LONG, c_name STRING, c_nationkey LONG, c_acctbal DOUBLE, c_mktsegment STRING"


@query("S5_csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, " + rs("c_acctbal") + ", c_mktsegment FROM customer")
def s5(s, d):
    return files.read_csv(s, csv_copy(s, d, "customer"), _CUSTOMER)


@query("S6_csv_projection", "SELECT c_custkey, " + rs("c_acctbal") + " FROM customer")
def s6(s, d):
    return files.read_csv(s, csv_copy(s, d, "customer"), _CUSTOMER, ["c_custkey", "c_acctbal"])


@query("S7_folder_scan", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def s7(s, d):
    return files.read_folder(s, csv_copy(s, d, "nation"), "n_nationkey LONG, n_name STRING, n_regionkey LONG", ["n_nationkey"]).drop("file")


@query("S8_load_status", "SELECT 'val' AS split, 'non_training' AS train_status, true AS loaded, count(*) AS n_rows, 'ok' AS message FROM customer UNION ALL SELECT 'test', 'non_training', false, 0, 'AnalysisException'")
def s8(s, d):
    _, a = files.load_or_status(s, "val", "non_training", f"{d}/customer.parquet", required=True)
    _, b = files.load_or_status(s, "test", "non_training", f"{d}/absent.parquet")
    return a.union(b).drop("path", "required")


@query("S9_cache_read", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def s9(s, d):
    path = config.scratch(s, "cache")
    files.write_cache(A.table(s, d, "nation"), path, "seq0_ann1")
    return files.read_cache(s, path, "seq0_ann1")


QUICK = network.Settings(hidden=(8,), epochs=2, workers=2)


def small_network(s, d, folder):
    """A network on two columns of the predictions: what checkpoints are tried with."""
    rows = A.row_pred(s, d).withColumn("weight", F.col("valid_measurements").cast("double"))
    names = ["weight", "prob_broadleaf"]
    net, _ = network.train(s, rows.where("split = 'train'"), rows.where("split = 'val'"), names, "y_true", folder, QUICK, "small")
    return net, rows.select("uniqueID", "year", "valid_measurements", "y_true", *names)


@query("S10_checkpoint_read", W("SELECT count(DISTINCT uniqueID) AS n_trees, 0 AS n_different, 'checkpoint is of tag small' AS refused FROM row_pred", "row_pred"))
def s10(s, d):
    """New rows through a saved network to fused trees that are written, against the network at hand."""
    folder = config.scratch(s, "checkpoint")
    net, rows = small_network(s, d, folder)
    network.save(s, net, f"{folder}/best")
    network.infer(s, f"{folder}/best", "small", rows, f"{folder}/fused")
    found = network.compared(s.read.parquet(f"{folder}/fused"), fusion.temporal(network.predict(net, rows)))
    try:
        network.load(s, f"{folder}/best", "other")
        refused = "none"
    except ValueError as e:
        refused = "checkpoint is of tag small" if "'small'" in str(e) else str(e)
    return found.select("n_trees", "n_different", F.lit(refused).alias("refused"))


@query("S11_date_spine", "SELECT CAST(range AS DATE) AS date FROM range(DATE '2023-12-15', DATE '2024-01-21', INTERVAL 1 DAY)")
def s11(s, d):
    return spines.days(s, "2023-12-15", "2024-01-20")


_SPINE = "SELECT CAST(range AS DATE) AS window_start, CAST(least(range + INTERVAL 7 DAY, TIMESTAMP '2025-01-01') AS DATE) AS window_end FROM range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 7 DAY)"


@query("S12_tumbling_spine", _SPINE)
def s12(s, d):
    return spines.tumbling(s, "2024-01-01", "2025-01-01")


@query("S13_settings", "SELECT * FROM (VALUES ('EARTH_PROJECT', 'trees 2024'), ('POINTS_ASSET', 'users/trees'), ('absent', 'default')) AS t(name, value)")
def s13(s, d):
    path = config.scratch(s, "settings")
    lines = ["# keys of a run", "", "EARTH_PROJECT='trees 2024'", "export POINTS_ASSET=users/trees"]
    s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    found = config.read_env(s, path) | {"absent": config.setting(s, "no.such.setting", "default")}
    return s.createDataFrame(sorted(found.items()), "name string, value string")


# ---------------------------------------------------------------- sinks


@query("K1_windowed_export", W("SELECT s.window_start, count(*) AS n, " + R("sum(temperature_2m)") + " AS total FROM weather_hourly w JOIN spine s ON w.ts >= s.window_start AND w.ts < s.window_end GROUP BY s.window_start", "weather_hourly", spine=_SPINE))
def k1(s, d):
    path = config.scratch(s, "export")
    hours = A.weather_hourly(s, d).withColumn("window_start", F.to_date(F.window("ts", "7 days", startTime="4 days").start))
    files.write_table(hours, path, "csv", ["window_start", "uniqueID", "temperature_2m"], ["window_start"])
    back = s.read.schema("uniqueID LONG, temperature_2m DOUBLE, window_start DATE").option("header", True).csv(path)
    return back.groupBy("window_start").agg(F.count("*").alias("n"), F.sum("temperature_2m").alias("total"))


@query("K2_single_export", W("SELECT uniqueID, date, " + rs("tmean_c", "precip_mm") + " FROM daily", "daily"))
def k2(s, d):
    path = config.scratch(s, "daily")
    files.write_table(weather.daily(A.weather_hourly(s, d)), path, "csv", ["uniqueID", "date", "tmean_c", "precip_mm"])
    return files.read_csv(s, path, "uniqueID LONG, date DATE, tmean_c DOUBLE, precip_mm DOUBLE")


@query("K3_result_tables", W("SELECT genus_name, count(*) AS n FROM row_pred GROUP BY genus_name", "row_pred"))
def k3(s, d):
    path = config.scratch(s, "result")
    files.write_table(A.row_pred(s, d).groupBy("genus_name").agg(F.count("*").alias("n")), path)
    return s.read.parquet(path)


@query("K4_indexed_table", W("SELECT error_type, count(*) AS count FROM flagged GROUP BY error_type", "flagged"))
def k4(s, d):
    path = config.scratch(s, "counts")
    files.write_table(reports.value_counts(flagged(s, d), "error_type"), path, "csv")
    return files.read_csv(s, path, "error_type STRING, count LONG")


@query("K5_json_sidecar", """SELECT '{"classes": ["conifer", "broadleaf"], "seed": 42}' AS value""")
def k5(s, d):
    path = config.scratch(s, "meta")
    files.write_json(s, path, {"seed": 42, "classes": list(L.CLASSES)})
    return s.read.text(path)


@query("K6_cache_write", "SELECT 'v5' AS tag, 'r_regionkey,r_name' AS columns")
def k6(s, d):
    path = config.scratch(s, "cache")
    files.write_cache(A.table(s, d, "region"), path, "v5")
    return s.read.parquet(f"{path}/meta")


@query("K7_model_write", W("""SELECT '{"metric": "conifer_f1", "tag": "v5"}' AS meta, count(*) AS n, 0 AS n_different FROM row_pred""", "row_pred"))
def k7(s, d):
    """A saved forest's predictions against those of the forest at hand."""
    path, rows = config.scratch(s, "model"), A.row_pred(s, d)
    data = rows.select("uniqueID", "year", F.col("valid_measurements").cast("double").alias("x"), F.col("prob_conifer").alias("z"), F.col("y_true").cast("double").alias("y"))
    model = ml.random_forest(data, ["x", "z"], "y", trees=5, depth=5)
    files.save_model(model, path, {"tag": "v5", "metric": "conifer_f1"})
    key = ["uniqueID", "year"]
    there = ml.probabilities(files.load_model(s, path, "v5"), data).select(*key, F.col("prob_conifer").alias("p"))
    met = ml.probabilities(model, data).join(there, key, "full")
    meta = s.read.text(f"{path}/meta").first().value
    return met.agg(F.lit(meta).alias("meta"), F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("p") == F.col("prob_conifer"), F.lit(False))).alias("n_different"))


_BINNED = "SELECT *, greatest(len(list_filter(edges, lambda e: e < round(v, 9))), 1) AS bin FROM (SELECT *, CAST({c} AS DOUBLE) AS v FROM {t}), (SELECT list_sort(list_distinct(list_transform(quantile_cont(CAST({c} AS DOUBLE), {q}), lambda e: round(e, 9)))) AS edges FROM {t}) WHERE v IS NOT NULL"


def binned(t: str, c: str, q: int) -> str:
    return _BINNED.format(t=t, c=c, q=[i / q for i in range(q + 1)])


@query("K8_plotted_relation", W("SELECT bin, y_true_name, count(*) AS n, " + R("avg(prob_conifer)") + " AS mean_value, " + R("median(prob_conifer)") + " AS median_value FROM b GROUP BY bin, y_true_name", "tree_year", b=binned("tree_year", "raw_NDVI_annual_mean", 10)))
def k8(s, d):
    return reports.deciles(tree_years(s, d), "raw_NDVI_annual_mean", "y_true_name", "prob_conifer")


@query("K9_console_head", W("SELECT uniqueID, year, " + rs("prob_conifer") + " FROM row_pred ORDER BY uniqueID, year LIMIT 20", "row_pred"))
def k9(s, d):
    return A.row_pred(s, d).select("uniqueID", "year", "prob_conifer").orderBy("uniqueID", "year").limit(20)


# ---------------------------------------------------------------- projections and filters


def idx(s, d):
    return I.with_indices(A.obs(s, d))


_OBS_KEY = "uniqueID, date, ord1, CAST(ord2 AS BIGINT) AS ord2, "


@query("P1_index_block", W("SELECT " + _OBS_KEY + rs(*I.INDEX_NAMES) + " FROM idx", "idx"))
def p1(s, d):
    return idx(s, d).select("uniqueID", "date", "ord1", "ord2", *I.INDEX_NAMES)


@query("P2_alias_repair", "SELECT p_partkey AS uniqueID, p_name FROM part")
def p2(s, d):
    return files.repair_id(A.table(s, d, "part").select(F.col("p_partkey").alias("unique_id"), "p_name"))


@query("P3_static_projection", W("SELECT uniqueID, BOTANICALG FROM trees", "trees"))
def p3(s, d):
    return A.trees(s, d).select("uniqueID", "BOTANICALG")


@query("P4_prefix_projection", W("SELECT " + rs("prob_conifer", "prob_broadleaf") + " FROM row_pred", "row_pred"))
def p4(s, d):
    rows = A.row_pred(s, d)
    return rows.select(*reports.by_prefix(rows, "prob_"))


@query("P5_provenance", W("SELECT uniqueID, 'val' AS split, 'non_training' AS train_status, 'NDVI < 0.3 AND brightness > 0.1' AS rule FROM trees", "trees"))
def p5(s, d):
    return A.trees(s, d).select("uniqueID", F.lit("val").alias("split"), F.lit("non_training").alias("train_status"), F.format_string("NDVI < %s AND brightness > %s", F.lit("0.3"), F.lit("0.1")).alias("rule"))


@query("P6_date_stamp", W("SELECT scene_id, strftime(ts, '%Y-%m-%d') AS date FROM scenes", "scenes"))
def p6(s, d):
    return A.scenes(s, d).select("scene_id", F.date_format("ts", "yyyy-MM-dd").alias("date"))


@query("P7_code_names", W(f"SELECT uniqueID, year, {V.name('y_pred')} AS y_pred_name FROM row_pred", "row_pred"))
def p7(s, d):
    return A.row_pred(s, d).select("uniqueID", "year", L.class_name(F.col("y_pred")).alias("y_pred_name"))


@query("P8_lossy_cast", "SELECT p_partkey, " + R("TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE)") + " AS x FROM part")
def p8(s, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_retailprice").cast("string"))
    return A.table(s, d, "part").select("p_partkey", text.alias("t")).selectExpr("p_partkey", "try_cast(t AS DOUBLE) AS x")


@query("P9_strict_cast", W("SELECT CAST(uniqueID AS VARCHAR) AS id, CAST(year AS BIGINT) AS year, CAST(prob_conifer * 100 AS BIGINT) >= 0 AS ok FROM row_pred", "row_pred"))
def p9(s, d):
    return A.row_pred(s, d).select(F.col("uniqueID").cast("string").alias("id"), F.col("year").cast("int").alias("year"), ((F.col("prob_conifer") * 100).cast("int") >= 0).alias("ok"))


@query("F1_any_band", W("SELECT " + _OBS_KEY + rs("B2", "B8") + " FROM obs WHERE coalesce(B2, B8) IS NOT NULL", "obs"))
def f1(s, d):
    return A.obs(s, d).dropna(how="all", subset=["B2", "B8"]).select("uniqueID", "date", "ord1", "ord2", "B2", "B8")


@query("F2_all_bands", W("SELECT " + _OBS_KEY + rs("B2", "B8") + " FROM obs WHERE B2 IS NOT NULL AND B8 IS NOT NULL", "obs"))
def f2(s, d):
    return A.obs(s, d).dropna(subset=["B2", "B8"]).select("uniqueID", "date", "ord1", "ord2", "B2", "B8")


@query("F3_unmapped_labels", W(f"SELECT DISTINCT BOTANICALG FROM trees WHERE {V.two_class('BOTANICALG')} IS NULL", "trees"))
def f3(s, d):
    return A.trees(s, d).where(L.two_class(F.col("BOTANICALG")).isNull()).select("BOTANICALG").distinct()


@query("F4_summer_months", W("SELECT " + _OBS_KEY + R("B8") + " AS B8 FROM obs WHERE month(date) IN (6, 7, 8)", "obs"))
def f4(s, d):
    return A.obs(s, d).where(F.month("date").isin(6, 7, 8)).select("uniqueID", "date", "ord1", "ord2", "B8")


@query("F5_half_open_dates", W("SELECT uniqueID, date FROM obs WHERE date >= DATE '1997-03-01' AND date < DATE '1997-03-08'", "obs"))
def f5(s, d):
    return acquire.in_period(A.obs(s, d), "1997-03-01", "1997-03-08", "date").select("uniqueID", "date")


@query("F6_pixel_mask", W("SELECT scene_id, uniqueID, CAST(line AS BIGINT) AS line FROM pixels WHERE probability < 40 AND scl NOT IN (0, 1, 3, 8, 9, 10, 11)", "pixels"))
def f6(s, d):
    return acquire.mask(A.pixels(s, d)).select("scene_id", "uniqueID", "line")


def base(s, d):
    """Fused predictions with places, as the spatial checks take them."""
    fused = fusion.temporal(A.row_pred(s, d)).select("uniqueID", F.col("y_true").alias("true_label"), F.col("y_pred_fused").alias("pred_label"))
    places = A.trees(s, d).where(L.two_class(F.col("BOTANICALG")).isNotNull())
    last = F.col("uniqueID") % 10
    return fused.join(places, "uniqueID").select(
        "uniqueID", F.when(last < 8, "train").when(last == 8, "val").otherwise("test").alias("split"), F.when(last < 8, "training").otherwise("non_training").alias("train_status"),
        F.col("BOTANICALG").alias("genus"), "X_COORD", "Y_COORD", "true_label", "pred_label",
    )


def neighbours(s, d):
    return spatial.neighbour_counts(base(s, d)).drop("X_COORD", "Y_COORD")


SETTING = {"min_total": 1, "min_opposite": 1, "min_rate": 0.2, "use_predicted": True, "min_pred_total": 2, "min_disagree": 2, "min_pred_rate": 0.5}
_FLAGS = """SELECT *, true_mixed_QA_flag OR predicted_mixed_QA_flag AS remove_by_mixed_QA FROM (SELECT *,
  n_neighbors_within_radius >= 1 AND n_true_opposite_neighbors_within_radius >= 1 AND coalesce(true_opposite_neighbor_rate, 0) >= 0.2::DOUBLE AS true_mixed_QA_flag,
  n_neighbors_within_radius >= 2 AND (n_pred_disagree_neighbors_within_radius >= 2 OR coalesce(neighbor_prediction_disagreement_rate, 0) >= 0.5::DOUBLE) AS predicted_mixed_QA_flag FROM neighbours)"""


def qa_flags(s, d):
    return qa.apply_flags(neighbours(s, d), SETTING)


@query("F7_retained_split", W("SELECT remove_by_mixed_QA AS removed, uniqueID FROM f WHERE NOT remove_by_mixed_QA UNION ALL SELECT remove_by_mixed_QA, uniqueID FROM f WHERE remove_by_mixed_QA", "neighbours", f=_FLAGS))
def f7(s, d):
    f = qa_flags(s, d)
    removed = F.col("remove_by_mixed_QA")
    return f.where(~removed).union(f.where(removed)).select(removed.alias("removed"), "uniqueID")


def flagged(s, d):
    return reports.row_flags(A.row_pred(s, d))


def tree_flagged(s, d):
    return reports.row_flags(fusion.temporal(A.row_pred(s, d)), pred="y_pred_fused_name")


@query("F9_confident_errors", W("SELECT uniqueID, CAST(year AS BIGINT) AS year, error_type, " + rs("max_prob") + " FROM flagged WHERE NOT correct AND max_prob >= 0.9", "flagged"))
def f9(s, d):
    return reports.confident_errors(flagged(s, d)).select("uniqueID", "year", "error_type", "max_prob")


def stepped(s, d):
    return phenology.steps(phenology.long_form(idx(s, d)))


_LONG = "SELECT uniqueID, year(date) AS year, date, dayofyear(date) AS doy, " + V.season("date") + " AS season, ord1, ord2, variable, value FROM (SELECT *, 'NDVI' AS variable, NDVI AS value FROM idx UNION ALL SELECT *, 'CIre', CIre FROM idx) WHERE value IS NOT NULL"
_STEPS = """SELECT *, CASE WHEN dt > 0 THEN (value - was) / dt END AS slope, CASE WHEN dt > 0 THEN (value + was) / 2.0::DOUBLE END AS mid, CASE WHEN dt > 0 THEN dt END AS span FROM (
  SELECT *, lag(value) OVER w AS was, doy - lag(doy) OVER w AS dt, avg(value) OVER p AS year_mean, max(value) OVER p AS year_max FROM longs
  WINDOW w AS (PARTITION BY uniqueID, year, variable ORDER BY date, ord1, ord2), p AS (PARTITION BY uniqueID, year, variable))"""


@query("F10_group_subsets", W("SELECT uniqueID, year, variable, " + R("coalesce(max(slope) FILTER (slope > 0), 0)") + " AS up, " + R("coalesce(min(slope) FILTER (slope < 0), 0)") + " AS down FROM steps GROUP BY ALL", "idx", longs=_LONG, steps=_STEPS))
def f10(s, d):
    f = phenology.features(stepped(s, d))
    return f.select("uniqueID", "year", "variable", F.col("max_positive_slope").alias("up"), F.col("max_negative_slope").alias("down"))


@query("F11_input_guards", "SELECT 'missing columns: Z_COORD' AS message")
def f11(s, d):
    try:
        files.require(A.trees(s, d), ["uniqueID", "Z_COORD"])
        said = "ok"
    except ValueError as e:
        said = str(e)
    return s.createDataFrame([(said,)], "message string")


# ---------------------------------------------------------------- joins

_SAVED = "SELECT s.scene_id, s.ts, s.cloud_pct, c.image FROM scenes s JOIN (SELECT scene_id, min(image) AS image FROM clouds GROUP BY scene_id) c USING (scene_id)"


@query("J1_save_first", W("SELECT scene_id, " + rs("cloud_pct") + ", image FROM j", "scenes", "clouds", j=_SAVED))
def j1(s, d):
    return acquire.save_first(A.scenes(s, d), A.clouds(s, d)).select("scene_id", "cloud_pct", "image")


def met(s, d):
    return idx(s, d).join(A.weather_features(s, d), ["uniqueID", "date"])


@query("J2_observation_weather", W("SELECT " + _OBS_KEY + rs("NDVI", *A.WEATHER) + " FROM met", "met"))
def j2(s, d):
    return met(s, d).select("uniqueID", "date", "ord1", "ord2", "NDVI", *A.WEATHER)


def label_rows(s, d):
    """First row of each tree, then its class; unknown genera go."""
    first = dedup.keep_first(A.trees(s, d), ["uniqueID"], ["BOTANICALG"])
    return first.withColumn("label", L.two_class(F.col("BOTANICALG"))).where("label IS NOT NULL").select("uniqueID", "label")


_LABELS = f"SELECT uniqueID, label FROM (SELECT uniqueID, {V.two_class('BOTANICALG')} AS label FROM trees) WHERE label IS NOT NULL"


@query("J3_tree_year_labels", W("SELECT uniqueID, year, label, length FROM (SELECT uniqueID, year(date) AS year, count(*) AS length FROM obs GROUP BY ALL) JOIN l USING (uniqueID)", "obs", "trees", l=_LABELS))
def j3(s, d):
    return treeyear.coverage(A.obs(s, d), I.BANDS).join(label_rows(s, d), "uniqueID").select("uniqueID", "year", "label", "length")


@query("J4_labelled_observations", W("SELECT uniqueID, date FROM obs WHERE uniqueID IN (SELECT uniqueID FROM l)", "obs", "trees", l=_LABELS))
def j4(s, d):
    return A.obs(s, d).join(label_rows(s, d), "uniqueID", "left_semi").select("uniqueID", "date")


@query("J5_one_to_one_places", W("SELECT f.uniqueID, CAST(y_pred_fused AS BIGINT) AS y_pred_fused, " + rs("X_COORD", "Y_COORD") + " FROM fused f JOIN trees t USING (uniqueID) WHERE X_COORD IS NOT NULL AND Y_COORD IS NOT NULL", "fused", "trees"))
def j5(s, d):
    met_ = dedup.join_one_to_one(fusion.temporal(A.row_pred(s, d)), A.trees(s, d), "uniqueID")
    return met_.dropna(subset=["X_COORD", "Y_COORD"]).select("uniqueID", "y_pred_fused", "X_COORD", "Y_COORD")


@query("J6_radius_neighbors", W("SELECT p.uniqueID AS a, q.uniqueID AS b, " + R("sqrt((p.X_COORD - q.X_COORD) * (p.X_COORD - q.X_COORD) + (p.Y_COORD - q.Y_COORD) * (p.Y_COORD - q.Y_COORD))") + " AS distance FROM trees p JOIN trees q ON abs(p.X_COORD - q.X_COORD) <= 65.61666666 AND p.uniqueID <> q.uniqueID AND (p.X_COORD - q.X_COORD) * (p.X_COORD - q.X_COORD) + (p.Y_COORD - q.Y_COORD) * (p.Y_COORD - q.Y_COORD) <= 65.61666666::DOUBLE * 65.61666666::DOUBLE", "trees"), done=True)
def j6(s, d):
    return spatial.radius_pairs(A.trees(s, d), shown=lambda x: X.rounded(x, large=False))  # rounded by pairs of places, not of trees


@query("J7_date_point_product", W("SELECT v.date, t.uniqueID FROM valid v, trees t", "weather_hourly", "trees", valid=_VALID))
def j7(s, d):
    return acquire.every_date_and_point(valid_dates(s, d), A.trees(s, d))


_TY = ("raw_NDVI_annual_mean", "raw_visible_brightness_annual_mean", "raw_NDVI_summer_mean", "raw_NDVI_summer_std", "raw_visible_brightness_summer_mean", "raw_visible_brightness_summer_max")


@query("J8_tree_year_summary", W("SELECT uniqueID, year, n_annual_obs, n_summer_obs, " + rs(*_TY) + " FROM annual LEFT JOIN summer USING (uniqueID, year)", "annual", "summer"))
def j8(s, d):
    return screening.tree_year_summary(A.obs(s, d)).select("uniqueID", "year", "n_annual_obs", "n_summer_obs", *_TY)


def tree_years(s, d):
    rows = A.row_pred(s, d)
    return screening.tree_years(screening.tree_year_summary(A.obs(s, d)), rows, fusion.temporal(rows))


@query("J9_summary_predictions", W("SELECT uniqueID, year, " + rs("raw_NDVI_annual_mean", "prob_conifer") + " FROM annual JOIN row_pred USING (uniqueID, year)", "annual", "row_pred"))
def j9(s, d):
    return tree_years(s, d).select("uniqueID", "year", "raw_NDVI_annual_mean", "prob_conifer")


@query("J10_tree_predictions", W("SELECT uniqueID, year, y_pred_fused_name FROM row_pred LEFT JOIN fused USING (uniqueID)", "row_pred", "fused"))
def j10(s, d):
    rows = A.row_pred(s, d)
    fused = dedup.keep_first(fusion.temporal(rows), ["uniqueID"], ["n_years"]).select("uniqueID", "y_pred_fused_name")
    return rows.join(fused, "uniqueID", "left").select("uniqueID", "year", "y_pred_fused_name")


@query("J11_suffixed_join", W("SELECT r.uniqueID, r.year, r.y_true_name AS y_true_name_row, t.y_true_name AS y_true_name_tree, t.y_pred_fused_name, r.error_type AS error_type_row, t.error_type AS error_type_tree FROM flagged r JOIN tree_flagged t USING (uniqueID) WHERE NOT t.correct", "flagged", "tree_flagged"))
def j11(s, d):
    return reports.tree_error_rows(flagged(s, d), tree_flagged(s, d)).select("uniqueID", "year", "y_true_name_row", "y_true_name_tree", "y_pred_fused_name", "error_type_row", "error_type_tree")


_GENUS = "SELECT uniqueID, arg_min(genus_name, year) AS genus_name FROM row_pred GROUP BY uniqueID"


@query("J12_genus_attach", W("SELECT uniqueID, correct, genus_name FROM tree_flagged LEFT JOIN g USING (uniqueID)", "tree_flagged", g=_GENUS))
def j12(s, d):
    return reports.with_genus(tree_flagged(s, d), A.row_pred(s, d)).select("uniqueID", "correct", "genus_name")


@query("J13_string_keys", W("SELECT CAST(p.uniqueID AS VARCHAR) AS id, CAST(p.year AS BIGINT) AS year, " + R("NDVI_mean") + " AS NDVI_mean, " + rs("prob_conifer") + " FROM row_pred p JOIN (SELECT uniqueID, year(date) AS year, avg(NDVI) AS NDVI_mean FROM idx GROUP BY ALL) USING (uniqueID, year) WHERE NDVI_mean IS NOT NULL", "row_pred", "idx"))
def j13(s, d):
    annual = treeyear.annual_metrics(idx(s, d).dropna(subset=["NDVI"]), ("NDVI",)).select(F.col("uniqueID").cast("string").alias("id"), "year", "NDVI_mean")
    return A.row_pred(s, d).select(F.col("uniqueID").cast("string").alias("id"), "year", "prob_conifer").join(annual, ["id", "year"])


@query("J14_keyed_concat", W("SELECT uniqueID, date, ord1, CAST(ord2 AS BIGINT) AS ord2, " + rs("NDVI", "raw_NDVI") + " FROM idx JOIN raw USING (uniqueID, date, ord1, ord2)", "idx", "raw"))
def j14(s, d):
    """Columns side by side by key, where positions would serve a local table."""
    key = ["uniqueID", "date", "ord1", "ord2"]
    return dedup.concat_columns(idx(s, d).select(*key, "NDVI"), raw(s, d).select(*key, "raw_NDVI"), key)


@query("J15_grid_product", "SELECT n AS ndvi_threshold, b AS brightness_threshold FROM (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5])::DOUBLE AS n), (SELECT unnest([0.06, 0.08, 0.1, 0.12, 0.14, 0.16])::DOUBLE AS b)")
def j15(s, d):
    return screening.thresholds(s)


@query("J16_lookup", W("SELECT uniqueID, label FROM l WHERE uniqueID IN (SELECT DISTINCT uniqueID FROM obs)", "obs", "trees", l=_LABELS))
def j16(s, d):
    ids = A.obs(s, d).select("uniqueID").distinct()
    return ids.join(label_rows(s, d), "uniqueID")


def daily(s, d):
    return weather.daily(A.weather_hourly(s, d))


def trailing_sql(n: int) -> str:
    w = f"OVER (PARTITION BY uniqueID ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"
    return f"avg(tmean_c) {w} AS temp_mean_{n}d_c, sum(precip_mm) {w} AS precip_sum_{n}d_mm, sum(srad_j) {w} AS srad_sum_{n}d_j_m2"


_TRAIL = "SELECT *, " + ", ".join(map(trailing_sql, (7, 14, 30))) + " FROM daily"
_TRAILED = tuple(f"{a}_{n}d_{b}" for n in (7, 14, 30) for a, b in (("temp_mean", "c"), ("precip_sum", "mm"), ("srad_sum", "j_m2")))


@query("J17_trailing_range_join", W("SELECT uniqueID, date, " + rs("temp_mean_7d_c") + " FROM t WHERE date IN (SELECT date FROM valid)", "daily", t=_TRAIL, valid=_VALID))
def j17(s, d):
    return weather.at_dates(weather.trailing(daily(s, d)), valid_dates(s, d)).select("uniqueID", "date", "temp_mean_7d_c")


# ---------------------------------------------------------------- aggregations


@query("A1_valid_dates", W("SELECT date, min(date) OVER () AS first, max(date) OVER () AS last FROM valid", "weather_hourly", valid=_VALID))
def a1(s, d):
    every = Window.partitionBy()  # a few dates
    return valid_dates(s, d).withColumn("first", F.min("date").over(every)).withColumn("last", F.max("date").over(every))


@query("A2_daily_rollup", W("SELECT uniqueID, date, " + rs("tmean_c", "precip_mm", "srad_j", "gdd_day") + " FROM daily", "daily"))
def a2(s, d):
    return daily(s, d)


def annual_sql(cols) -> str:
    out = []
    for c in cols:
        for n, x in (("mean", f"avg({c})"), ("min", f"min({c})"), ("max", f"max({c})"), ("range", f"max({c}) - min({c})"), ("std", f"stddev_pop({c})")):
            out.append(f"{R(f'coalesce({x}, 0)')} AS {c}_{n}")
    return "SELECT uniqueID, year(date) AS year, " + ", ".join(out) + " FROM met GROUP BY ALL"


@query("A3_annual_metrics", W(annual_sql(treeyear.COLUMNS), "met"))
def a3(s, d):
    return treeyear.annual_metrics(met(s, d))


_SEASONAL = "SELECT uniqueID, year, avg(NDVI) AS m, " + ", ".join(f"avg(NDVI) FILTER (season = '{x}') AS {x}" for x in treeyear.SEASONS) + ", avg(CASE WHEN NDVI IS NOT NULL THEN CAST(NDVI > year_mean AS INT) END) AS above FROM (SELECT uniqueID, year(date) AS year, " + V.season("date") + " AS season, NDVI, avg(NDVI) OVER (PARTITION BY uniqueID, year(date)) AS year_mean FROM idx) GROUP BY ALL"
_SM = {x: f"coalesce({x}, m, 0)" for x in treeyear.SEASONS}


@query("A4_seasonal_ndvi", W("SELECT uniqueID, year, " + ", ".join(f"{R(_SM[x])} AS NDVI_{x}_mean" for x in treeyear.SEASONS) + f", {R(_SM['spring'] + ' - ' + _SM['winter'])} AS NDVI_spring_minus_winter, {R(_SM['fall'] + ' - ' + _SM['summer'])} AS NDVI_fall_minus_summer, {R('coalesce(above, 0)')} AS NDVI_share_above_mean FROM x", "idx", x=_SEASONAL))
def a4(s, d):
    return treeyear.seasonal_ndvi(idx(s, d))


@query("A5_coverage", W("SELECT uniqueID, year(date) AS year, count(*) AS length, " + R("count(*)") + " AS coverage, " + R(" + ".join(f"count({c})" for c in treeyear.S2)) + " AS valid_measurements FROM idx GROUP BY ALL", "idx"))
def a5(s, d):
    return treeyear.coverage(idx(s, d))


_ANGLE = "2 * pi() * {} / 365.0::DOUBLE"
_PHENO = """SELECT uniqueID, year, variable, avg(value) AS mean, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, stddev_pop(value) AS std,
  first(doy ORDER BY value DESC, date, ord1, ord2) AS dmax, first(doy ORDER BY value, date, ord1, ord2) AS dmin, CASE WHEN sum(greatest(value, 0)) > 0 THEN sum(doy * greatest(value, 0)) / sum(greatest(value, 0)) END AS centre,
  coalesce(max(slope) FILTER (slope > 0), 0) AS max_positive_slope, coalesce(min(slope) FILTER (slope < 0), 0) AS max_negative_slope, avg(CAST(value > year_mean AS INT)) AS frac_above_yearly_mean,
  CASE WHEN sum(span) > 0 THEN coalesce(sum(span) FILTER (mid > year_mean), 0) / sum(span) END AS frac_time_above_yearly_mean, CASE WHEN sum(span) > 0 THEN coalesce(sum(span) FILTER (mid > 0.8::DOUBLE * year_max), 0) / sum(span) END AS frac_time_above_80pct_max,
  avg(value) FILTER (season = 'winter') AS winter, avg(value) FILTER (season = 'spring') AS spring, avg(value) FILTER (season = 'summer') AS summer, avg(value) FILTER (season = 'fall') AS fall FROM steps GROUP BY ALL"""
_PF = ("mean", "min", "max", "range", "std", "max_positive_slope", "max_negative_slope", "frac_above_yearly_mean", "frac_time_above_yearly_mean", "frac_time_above_80pct_max")


@query("A6_phenology", W("SELECT uniqueID, year, variable, " + rs(*_PF) + ", " + ", ".join(f"{R(f'{fn}({_ANGLE.format(c)})')} AS {n}_{fn}" for n, c in (("doy_max", "dmax"), ("doy_min", "dmin"), ("center_green", "centre")) for fn in ("sin", "cos")) + f", {R('summer')} AS summer_mean, {R('winter')} AS winter_mean, {R('spring - winter')} AS spring_minus_winter, {R('fall - summer')} AS fall_minus_summer FROM p", "idx", longs=_LONG, steps=_STEPS, p=_PHENO))
def a6(s, d):
    return phenology.features(stepped(s, d))


@query("A6_phenology_wide", W("SELECT uniqueID, year(date) AS year, count(*) AS n_obs, " + R("avg(NDVI)") + " AS NDVI_mean, " + R("max(CIre)") + " AS CIre_max FROM idx GROUP BY ALL", "idx"))
def a6w(s, d):
    return phenology.wide(idx(s, d)).select("uniqueID", "year", "n_obs", "NDVI_mean", "CIre_max")


def raw(s, d):
    return I.with_raw(A.obs(s, d))


_SUM = ("raw_NDVI_summer_mean", "raw_NDVI_summer_min", "raw_NDVI_summer_max", "raw_NDVI_summer_std", "raw_visible_brightness_summer_mean", "raw_visible_brightness_summer_max", "raw_red_brightness_summer_mean", "raw_green_brightness_summer_mean", "raw_blue_brightness_summer_mean")


@query("A7_summer_summary", W("SELECT uniqueID, year, n_summer_obs, " + rs(*_SUM) + " FROM summer", "summer"))
def a7(s, d):
    return screening.summer_summary(raw(s, d))


@query("A8_annual_summary", W("SELECT uniqueID, year, n_annual_obs, " + rs("raw_NDVI_annual_mean", "raw_NDVI_annual_min", "raw_NDVI_annual_max", "raw_visible_brightness_annual_mean") + " FROM annual", "annual"))
def a8(s, d):
    return screening.annual_summary(raw(s, d))


_TS = ("mean_prob_conifer", "max_prob_conifer", "min_prob_conifer", "mean_prob_broadleaf", "mean_raw_NDVI_summer_mean", "min_raw_NDVI_summer_mean", "max_raw_NDVI_summer_mean", "mean_raw_NDVI_summer_std", "mean_raw_visible_brightness_summer_mean", "max_raw_visible_brightness_summer_mean", "mean_raw_visible_brightness_summer_max", "mean_raw_red_brightness_summer_mean", "mean_raw_green_brightness_summer_mean", "mean_raw_blue_brightness_summer_mean", "mean_raw_NDVI_annual_mean", "mean_raw_visible_brightness_annual_mean")


def tree_summary(s, d):
    return screening.tree_summary(tree_years(s, d))


@query("A9_tree_summary", W("SELECT uniqueID, genus_name, y_true_name, y_pred_fused_name, tree_correct, tree_error_type, n_years, n_years_with_summer_obs, total_valid_measurements, " + rs(*_TS) + " FROM tree_summary", "tree_summary"))
def a9(s, d):
    return tree_summary(s, d)


_ACC = "count(*) AS n_rows, " + R("avg(CAST(correct AS INT))") + " AS row_accuracy, " + R("avg(max_prob)") + " AS mean_confidence, " + R("avg(valid_measurements)") + " AS mean_valid_measurements"


@query("A10_accuracy_by_genus", W(f"SELECT genus_name, {_ACC} FROM flagged GROUP BY genus_name", "flagged"))
def a10(s, d):
    return reports.accuracy_by(flagged(s, d), "genus_name")


@query("A10_accuracy_by_year", W(f"SELECT year, {_ACC} FROM flagged GROUP BY year", "flagged"))
def a10y(s, d):
    return reports.accuracy_by(flagged(s, d), "year")


@query("A11_genus_error_counts", W("SELECT genus_name, error_type, count(*) AS n_errors FROM flagged WHERE NOT correct GROUP BY ALL", "flagged"))
def a11(s, d):
    return reports.error_counts(flagged(s, d))


@query("A12_quantile_bins", W(f"SELECT bin, {R('edges[bin]')} AS bin_left, {R('coalesce(edges[bin + 1], edges[bin])')} AS bin_right, {_ACC} FROM b GROUP BY bin, edges", "flagged", b=binned("flagged", "valid_measurements", 5)))
def a12(s, d):
    return reports.accuracy_by_bin(flagged(s, d))


@query("A13_tree_accuracy_by_genus", W("SELECT genus_name, count(*) AS n_trees, " + R("avg(CAST(correct AS INT))") + " AS tree_accuracy, count(*) FILTER (NOT correct) AS n_errors FROM tree_flagged JOIN g USING (uniqueID) GROUP BY genus_name", "tree_flagged", g=_GENUS))
def a13(s, d):
    return reports.tree_accuracy_by_genus(reports.with_genus(tree_flagged(s, d), A.row_pred(s, d)))


def screen_sql(table, ndvi, bright, level, err):
    return f"""SELECT '{level}' AS level, '{ndvi}' AS ndvi_metric, '{bright}' AS brightness_metric, n AS ndvi_threshold, b AS brightness_threshold, '{ndvi} < ' || CAST(n AS VARCHAR) || ' AND {bright} > ' || CAST(b AS VARCHAR) AS rule, '{err}' AS error_col, y_true_name, {err} AS error_type,
  count(*) AS n_total, count(*) FILTER (round({ndvi}, 12) < n AND round({bright}, 12) > b) AS n_removed, CAST(100 * count(*) FILTER (round({ndvi}, 12) < n AND round({bright}, 12) > b) AS DOUBLE) / count(*) AS pct_removed
FROM {table}, (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5])::DOUBLE AS n), (SELECT unnest([0.06, 0.08, 0.1, 0.12, 0.14, 0.16])::DOUBLE AS b) WHERE {ndvi} IS NOT NULL AND {bright} IS NOT NULL GROUP BY ALL"""


_NM, _BM = "raw_NDVI_summer_mean", "raw_visible_brightness_summer_mean"
_SCREENS = " UNION ALL ".join([screen_sql("tree_summary", f"mean_{_NM}", f"mean_{_BM}", "tree_mean_across_years", "tree_error_type"), screen_sql("tree_summary", f"min_{_NM}", f"max_{_BM}", "tree_min_ndvi_max_brightness_across_years", "tree_error_type"), screen_sql("tree_year", _NM, _BM, "tree_year", "row_error_type")])


def screens(s, d):
    return screening.all_screens(tree_years(s, d))


@query("A14_threshold_screens", W("SELECT * EXCLUDE (pct_removed), " + rs("pct_removed") + " FROM sc", "tree_year", "tree_summary", sc=_SCREENS))
def a14(s, d):
    return screens(s, d)


_KIND = {"conifer_false_negative": ("conifer", "conifer_false_negative"), "correct_conifer": ("conifer", "correct"), "correct_broadleaf": ("broadleaf", "correct"), "broadleaf_false_positive": ("broadleaf", "broadleaf_false_positive")}
_SEL = "SELECT " + ", ".join(screening.SCREEN_KEYS) + ", " + ", ".join(f"max(pct_removed) FILTER (y_true_name = '{a}' AND error_type = '{b}') AS pct_removed_{k}" for k, (a, b) in _KIND.items()) + ", " + ", ".join(f"CAST(coalesce(max(n_removed) FILTER (y_true_name = '{a}' AND error_type = '{b}'), 0) AS BIGINT) AS n_removed_{k}" for k, (a, b) in list(_KIND.items())[:3]) + " FROM sc GROUP BY ALL"
_SELECT = "SELECT * EXCLUDE (" + ", ".join(f"pct_removed_{k}" for k in _KIND) + "), " + rs(*[f"pct_removed_{k}" for k in _KIND]) + ", " + R("pct_removed_conifer_false_negative - pct_removed_correct_broadleaf") + " AS selectivity_vs_correct_broadleaf, " + R("pct_removed_conifer_false_negative - pct_removed_correct_conifer") + " AS selectivity_vs_correct_conifer FROM se"


@query("A15_selectivity", W(_SELECT, "tree_year", "tree_summary", sc=_SCREENS, se=_SEL))
def a15(s, d):
    return screening.selectivity(screens(s, d))


_NB = "uniqueID, split, train_status, genus, " + big("true_label", "pred_label", "n_neighbors_within_radius", "n_true_opposite_neighbors_within_radius", "n_pred_disagree_neighbors_within_radius") + ", " + rs("true_opposite_neighbor_rate", "neighbor_prediction_disagreement_rate")


@query("A16_neighbor_counts", W(f"SELECT {_NB} FROM neighbours", "neighbours"))
def a16(s, d):
    return neighbours(s, d)


@query("A17_qa_summary", W("SELECT train_status, split, count(*) AS n_total, count(*) FILTER (remove_by_mixed_QA) AS n_removed_by_mixed_QA, count(*) FILTER (true_mixed_QA_flag) AS n_true_mixed_QA, count(*) FILTER (predicted_mixed_QA_flag) AS n_predicted_mixed_QA, " + R("avg(n_neighbors_within_radius)") + " AS mean_neighbors, " + R("avg(n_true_opposite_neighbors_within_radius)") + " AS mean_true_opposite_neighbors, " + R("avg(true_opposite_neighbor_rate)") + " AS mean_true_opposite_rate, " + R("avg(n_pred_disagree_neighbors_within_radius)") + " AS mean_pred_disagree_neighbors, " + R("avg(neighbor_prediction_disagreement_rate)") + " AS mean_pred_disagreement_rate, " + R("CAST(count(*) FILTER (remove_by_mixed_QA) AS DOUBLE) / count(*)") + " AS pct_removed_by_mixed_QA FROM f GROUP BY ALL", "neighbours", f=_FLAGS))
def a17(s, d):
    return qa.qa_summary(qa_flags(s, d))


@query("A18_value_counts", W("SELECT error_type, count(*) AS count FROM tree_flagged GROUP BY error_type", "tree_flagged"))
def a18(s, d):
    return reports.value_counts(tree_flagged(s, d), "error_type")


@query("A19_cross_tab", W("SELECT y_true_name, count(*) FILTER (error_type = 'correct') AS correct, count(*) FILTER (error_type = 'conifer_as_broadleaf') AS conifer_as_broadleaf, count(*) FILTER (error_type = 'broadleaf_as_conifer') AS broadleaf_as_conifer FROM tree_flagged GROUP BY y_true_name", "tree_flagged"))
def a19(s, d):
    return reports.cross_tab(tree_flagged(s, d), "y_true_name", "error_type", ["correct", "conifer_as_broadleaf", "broadleaf_as_conifer"])


@query("A20_describe", W("SELECT count(v) AS count, " + ", ".join(f"{R(x)} AS {n}" for n, x in (("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("p25", "quantile_cont(v, 0.25)"), ("p50", "quantile_cont(v, 0.5)"), ("p75", "quantile_cont(v, 0.75)"), ("max", "max(v)"))) + " FROM (SELECT prob_conifer AS v FROM row_pred)", "row_pred"))
def a20(s, d):
    return reports.describe(A.row_pred(s, d), "prob_conifer")


@query("A21_distinct_ids", W("SELECT split, count(DISTINCT uniqueID) AS n_trees FROM row_pred GROUP BY split", "row_pred"))
def a21(s, d):
    return A.row_pred(s, d).groupBy("split").agg(F.count_distinct("uniqueID").alias("n_trees"))


@query("A22_fusion_sums", W("SELECT uniqueID, " + R("sum(w)") + " AS total_weight, " + R("sum(w * la)") + " AS log_conifer FROM logs GROUP BY uniqueID", "logs"))
def a22(s, d):
    w = F.col("valid_measurements").cast("double")
    return A.row_pred(s, d).groupBy("uniqueID").agg(F.sum(w).alias("total_weight"), F.sum(w * F.ln(F.least(F.greatest("prob_conifer", F.lit(1e-8)), F.lit(1.0)))).alias("log_conifer"))


_STD = ("NDVI", "CIre", "temp_mean_7d_c")


@query("A23_standard_moments", W("SELECT " + ", ".join(f"{R(f'avg({c})')} AS {c}_mu, {R(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END')} AS {c}_sd" for c in _STD) + " FROM met WHERE uniqueID % 10 < 8", "met"))
def a23(s, d):
    return treeyear.moments(met(s, d).where("uniqueID % 10 < 8"), _STD)


@query("A24_imputation", W("SELECT uniqueID, date, ord1, CAST(ord2 AS BIGINT) AS ord2, " + ", ".join(f"{R(f'coalesce({c}, (SELECT avg({c}) FROM obs WHERE uniqueID % 10 < 8))')} AS {c}" for c in ("B2", "B8")) + " FROM obs", "obs"))
def a24(s, d):
    o = A.obs(s, d).select("uniqueID", "date", "ord1", "ord2", "B2", "B8")
    return split.impute(o, o.where("uniqueID % 10 < 8"), ("B2", "B8"))


_WEIGHTS = "SELECT class, n, w / sum(w) OVER () * count(*) OVER () AS weight FROM (SELECT class, n, (1 / sqrt(n)) / sum(1 / sqrt(n)) OVER () * count(*) OVER () * CASE WHEN class = 0 THEN 1.5 ELSE 1 END AS w FROM (SELECT y_true AS class, count(*) AS n FROM row_pred WHERE split = 'train' GROUP BY y_true))"


@query("A25_class_weights", W("SELECT CAST(class AS BIGINT) AS class, n, " + rs("weight") + " FROM cw", "row_pred", cw=_WEIGHTS))
def a25(s, d):
    return split.class_weights(A.row_pred(s, d).where("split = 'train'"), "y_true")


# ---------------------------------------------------------------- ordered series


@query("W1_trailing_windows", W("SELECT uniqueID, date, " + rs(*_TRAILED) + " FROM t", "daily", t=_TRAIL))
def w1(s, d):
    return weather.trailing(daily(s, d)).select("uniqueID", "date", *_TRAILED)


@query("W2_growing_degrees", W("SELECT uniqueID, date, " + R("sum(gdd_day) OVER (PARTITION BY uniqueID, year(date) ORDER BY date)") + " AS gdd_cum_ytd_base10_c FROM daily WHERE date >= DATE '2024-01-05'", "daily"))
def w2(s, d):
    return weather.growing_degrees(daily(s, d), "2024-01-05").select("uniqueID", "date", "gdd_cum_ytd_base10_c")


@query("W3_first_extremes", W("SELECT uniqueID, year, variable, " + R("sin(" + _ANGLE.format("dmax") + ")") + " AS doy_max_sin, " + R("cos(" + _ANGLE.format("dmin") + ")") + " AS doy_min_cos FROM p", "idx", longs=_LONG, steps=_STEPS, p=_PHENO))
def w3(s, d):
    return phenology.features(stepped(s, d)).select("uniqueID", "year", "variable", "doy_max_sin", "doy_min_cos")


@query("W4_slopes", W("SELECT uniqueID, date, ord1, CAST(ord2 AS BIGINT) AS ord2, variable, " + rs("slope") + " FROM steps", "idx", longs=_LONG, steps=_STEPS))
def w4(s, d):
    return stepped(s, d).select("uniqueID", "date", "ord1", "ord2", "variable", "slope")


@query("W5_time_shares", W("SELECT uniqueID, year, variable, " + rs("frac_time_above_yearly_mean", "frac_time_above_80pct_max") + " FROM p", "idx", longs=_LONG, steps=_STEPS, p=_PHENO))
def w5(s, d):
    return phenology.features(stepped(s, d)).select("uniqueID", "year", "variable", "frac_time_above_yearly_mean", "frac_time_above_80pct_max")


@query("W6_delta_days", W("SELECT uniqueID, date, ord1, CAST(ord2 AS BIGINT) AS ord2, " + R("coalesce(date - lag(date) OVER (PARTITION BY uniqueID, year(date) ORDER BY date, ord1, ord2), 0) / 30.0::DOUBLE") + " AS delta_days FROM obs", "obs"))
def w6(s, d):
    return treeyear.with_gaps(A.obs(s, d)).select("uniqueID", "date", "ord1", "ord2", "delta_days")


@query("W7_share_above_mean", W("SELECT uniqueID, year, " + R("coalesce(above, 0)") + " AS share FROM x", "idx", x=_SEASONAL))
def w7(s, d):
    return treeyear.seasonal_ndvi(idx(s, d)).select("uniqueID", "year", F.col("NDVI_share_above_mean").alias("share"))


@query("W8_normalised_weights", W("SELECT uniqueID, year, " + R("CASE WHEN sum(w) OVER p <= 0 THEN 1.0 / count(*) OVER p ELSE w / sum(w) OVER p END") + " AS weight FROM logs WINDOW p AS (PARTITION BY uniqueID)", "logs"))
def w8(s, d):
    return fusion.normalised_weights(A.row_pred(s, d)).select("uniqueID", "year", "weight")


@query("W9_sequences", W("SELECT uniqueID, year(date) AS year, count(*) AS length, array_to_string(list(CAST(CAST(round(coalesce(B3, 0) * 1000) AS BIGINT) AS VARCHAR) ORDER BY date, ord1, ord2), ',') AS seq FROM obs GROUP BY ALL", "obs"))
def w9(s, d):
    o = A.obs(s, d).withColumn("year", F.year("date")).withColumn("B3", F.coalesce("B3", F.lit(0.0)))
    q = treeyear.sequences(o, ("B3",))
    return q.select("uniqueID", "year", "length", F.array_join(F.transform("seq", lambda x: F.round(x[0] * 1000).cast("long").cast("string")), ",").alias("seq"))


_STEP = {
    "NDVI": "coalesce(NDVI, 0)", "precip_sum_7d_mm": "ln(1 + greatest(coalesce(precip_sum_7d_mm, 0), 0))", "temp_mean_7d_c": "coalesce(temp_mean_7d_c, 0)",
    "delta_days": "coalesce(date - lag(date) OVER (PARTITION BY uniqueID, year(date) ORDER BY date, ord1, ord2), 0) / 30.0::DOUBLE",
    "doy_sin": "sin(2 * pi() * dayofyear(date) / 365.25::DOUBLE)", "doy_cos": "cos(2 * pi() * dayofyear(date) / 365.25::DOUBLE)",
}


@query("W9_timesteps", W("SELECT " + _OBS_KEY + "year(date) AS year, CAST(B2 IS NOT NULL AS BIGINT) AS B2_mask, 59 AS n_inputs, " + ", ".join(f"{R(v)} AS {k}" for k, v in _STEP.items()) + " FROM met", "met"))
def w9s(s, d):
    """The inputs of a step of the sequence branch: all 59 are made, some are shown."""
    steps = treeyear.timesteps(met(s, d))
    keys = ["uniqueID", "year", "date", "ord1", "ord2"]
    return steps.select(*keys, "B2_mask", F.lit(len(steps.columns) - len(keys)).alias("n_inputs"), *_STEP)


@query("D1d_first_row", W("SELECT uniqueID, date, ord1, CAST(ord2 AS BIGINT) AS ord2 FROM obs QUALIFY row_number() OVER (PARTITION BY uniqueID, date ORDER BY ord1, ord2) = 1", "obs"))
def d1d(s, d):
    return dedup.keep_first(A.obs(s, d), ["uniqueID", "date"], ["ord1", "ord2"]).select("uniqueID", "date", "ord1", "ord2")


@query("D2d_duplicate_keys", W("SELECT uniqueID, date, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 1", "obs"))
def d2d(s, d):
    return dedup.duplicate_keys(A.obs(s, d), ["uniqueID", "date"])


# ---------------------------------------------------------------- sorts and sets

_SWEEP_GRID = """SELECT CAST(row_number() OVER (ORDER BY a, b, c, u, coalesce(e, 0), coalesce(f, 0), coalesce(g, 0)) - 1 AS INTEGER) AS grid_ordinal, a AS min_total, b AS min_opposite, c AS min_rate, u AS use_predicted, e AS min_pred_total, f AS min_disagree, g AS min_pred_rate
FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([1, 2, 3]) AS b), (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4])::DOUBLE AS c),
  (SELECT false AS u, NULL::INTEGER AS e, NULL::INTEGER AS f, NULL::DOUBLE AS g UNION ALL SELECT true, e, f, g FROM (SELECT unnest([1, 2, 3]) AS e), (SELECT unnest([1, 2, 3]) AS f), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS g))"""
_CELLS = """SELECT grid_ordinal, min_total, min_opposite, min_rate, use_predicted, min_pred_total, min_disagree, min_pred_rate, train_status, count(*) AS n_total,
  count(*) FILTER (kept AND true_label = 0 AND pred_label = 0) AS n00, count(*) FILTER (kept AND true_label = 0 AND pred_label = 1) AS n01, count(*) FILTER (kept AND true_label = 1 AND pred_label = 0) AS n10, count(*) FILTER (kept AND true_label = 1 AND pred_label = 1) AS n11
FROM (SELECT *, NOT ((n_neighbors_within_radius >= min_total AND n_true_opposite_neighbors_within_radius >= min_opposite AND coalesce(true_opposite_neighbor_rate, 0) >= min_rate)
  OR (use_predicted AND n_neighbors_within_radius >= coalesce(min_pred_total, 999999) AND (n_pred_disagree_neighbors_within_radius >= coalesce(min_disagree, 999999) OR coalesce(neighbor_prediction_disagreement_rate, 0) >= coalesce(min_pred_rate, 999999)))) AS kept FROM neighbours, grid) GROUP BY ALL"""


def scores_sql(table: str) -> str:
    z = lambda a, b: f"coalesce({V.ratio(a, b)}, 0)"
    p, r = (z("n00", "n00 + n10"), z("n11", "n11 + n01")), (z("n00", "n00 + n01"), z("n11", "n10 + n11"))
    f = (z("2 * n00", "2 * n00 + n10 + n01"), z("2 * n11", "2 * n11 + n01 + n10"))
    s0, s1, n = "(n00 + n01)", "(n10 + n11)", "(n00 + n01 + n10 + n11)"
    out = {"accuracy": z("n00 + n11", n)}
    for k, x in (("precision", p), ("recall", r), ("f1", f)):
        out |= {f"macro_{k}": f"({x[0]} + {x[1]}) / 2.0::DOUBLE", f"weighted_{k}": z(f"{x[0]} * {s0} + {x[1]} * {s1}", n), f"conifer_{k}": x[0], f"broadleaf_{k}": x[1]}
    return f"SELECT *, {n} AS n_evaluated, {s0} AS conifer_support, {s1} AS broadleaf_support, " + ", ".join(f"{v} AS {k}" for k, v in out.items()) + f" FROM {table}"


_SWEEP = "SELECT grid_ordinal, min_total, min_opposite, min_rate, use_predicted, min_pred_total, min_disagree, min_pred_rate, train_status, n_total AS n_total_before_QA, n_evaluated AS n_evaluated_after_QA, n_total - n_evaluated AS n_removed_by_QA, CAST(n_total - n_evaluated AS DOUBLE) / n_total AS removed_fraction, " + ", ".join(f"CASE WHEN n_evaluated > 0 THEN {m} END AS {m}" for m in qa.SCORES) + " FROM sc"
_SWEEP_OUT = big("grid_ordinal", "min_total", "min_opposite") + ", " + rs("min_rate") + ", use_predicted, " + big("min_pred_total", "min_disagree") + ", " + rs("min_pred_rate") + ", train_status, " + big("n_total_before_QA", "n_evaluated_after_QA", "n_removed_by_QA") + ", " + rs("removed_fraction", *qa.SCORES)
_SWEEP_CTES = {"grid": _SWEEP_GRID, "cl": _CELLS, "sc": scores_sql("cl"), "sw": _SWEEP}


def swept(s, d):
    return qa.sweep(neighbours(s, d))


@query("E9_sweep_grid", "SELECT " + big("grid_ordinal", "min_total", "min_opposite") + ", " + rs("min_rate") + ", use_predicted, " + big("min_pred_total", "min_disagree") + ", " + rs("min_pred_rate") + f" FROM ({_SWEEP_GRID})")
def e9(s, d):
    return qa.grid(s)


@query("E8_sweep_metrics", W(f"SELECT {_SWEEP_OUT} FROM sw", "neighbours", **_SWEEP_CTES))
def e8(s, d):
    return swept(s, d)


_CAND = "train_status = 'non_training' AND removed_fraction <= 0.5 AND n_evaluated_after_QA >= 100"


@query("F8_sweep_candidates", W(f"SELECT {_SWEEP_OUT} FROM sw WHERE {_CAND}", "neighbours", **_SWEEP_CTES))
def f8(s, d):
    return qa.candidates(swept(s, d))


@query("O1_best_setting", W(f"SELECT {_SWEEP_OUT} FROM sw WHERE {_CAND} ORDER BY round(sw.macro_f1, 9) DESC NULLS LAST, round(sw.conifer_f1, 9) DESC NULLS LAST, round(sw.accuracy, 9) DESC NULLS LAST, sw.removed_fraction, sw.grid_ordinal LIMIT 1", "neighbours", **_SWEEP_CTES))
def o1(s, d):
    return qa.best(qa.candidates(swept(s, d)))


@query("O2_by_selectivity", W(_SELECT, "tree_year", "tree_summary", sc=_SCREENS, se=_SEL))
def o2(s, d):
    return screening.by_selectivity(screening.selectivity(screens(s, d)))


@query("O3_single_key_sort", W("SELECT genus_name, error_type, count(*) AS n_errors FROM flagged WHERE NOT correct GROUP BY ALL", "flagged"))
def o3(s, d):
    return reports.error_counts(flagged(s, d)).orderBy(F.desc_nulls_last("n_errors"), "genus_name", "error_type")


@query("O4_two_key_sort", W("SELECT genus_name, count(*) AS n_trees, " + R("avg(CAST(correct AS INT))") + " AS tree_accuracy, count(*) FILTER (NOT correct) AS n_errors FROM tree_flagged JOIN g USING (uniqueID) GROUP BY genus_name", "tree_flagged", g=_GENUS))
def o4(s, d):
    return reports.tree_accuracy_by_genus(reports.with_genus(tree_flagged(s, d), A.row_pred(s, d))).orderBy(F.asc_nulls_last("tree_accuracy"), F.asc_nulls_last("n_trees"))


@query("O5_top_errors", W("SELECT uniqueID, CAST(year AS BIGINT) AS year, " + rs("max_prob") + " FROM flagged WHERE NOT correct AND max_prob >= 0.9 ORDER BY max_prob DESC, uniqueID, year LIMIT 30", "flagged"))
def o5(s, d):
    return reports.confident_errors(flagged(s, d)).limit(30).select("uniqueID", "year", "max_prob")


@query("O6_first_in_group", W("SELECT uniqueID, arg_min(y_true, year) AS y_true FROM row_pred GROUP BY uniqueID", "row_pred"))
def o6(s, d):
    return A.row_pred(s, d).groupBy("uniqueID").agg(F.min_by("y_true", "year").alias("y_true"))


_SIMPLE = "SELECT uniqueID, max(y_true) AS y_true, CASE WHEN sum(w) = 0 THEN avg(la) ELSE sum(w * la) / sum(w) END AS a, CASE WHEN sum(w) = 0 THEN avg(lb) ELSE sum(w * lb) / sum(w) END AS b, sum(w) AS total_weight FROM {} GROUP BY uniqueID"


@query("U1_union_splits", W("SELECT uniqueID, 'train' AS split, CAST(NULL AS BIGINT) AS n_years, CAST(CASE WHEN round(exp(a) / (exp(a) + exp(b)), 12) >= 0.5 THEN 0 ELSE 1 END AS BIGINT) AS y_pred_fused FROM si UNION ALL SELECT uniqueID, 'rest', n_years, CAST(y_pred_fused AS BIGINT) FROM fused WHERE uniqueID % 10 >= 8", "logs", "fused", tr="SELECT * FROM logs WHERE split = 'train'", si=_SIMPLE.format("tr")))
def u1(s, d):
    rows = A.row_pred(s, d)
    a = fusion.simple(rows.where("split = 'train'")).withColumn("split", F.lit("train"))
    b = fusion.temporal(rows.where("split <> 'train'")).withColumn("split", F.lit("rest"))
    return a.unionByName(b, allowMissingColumns=True).select("uniqueID", "split", "n_years", "y_pred_fused")


@query("U2_flatten", W("SELECT uniqueID, year(date) AS year, round(B3, 6) + 0.0 AS b FROM obs", "obs"))
def u2(s, d):
    q = treeyear.sequences(A.obs(s, d).withColumn("year", F.year("date")), ("B3",))
    return q.select("uniqueID", "year", F.explode(F.flatten("seq")).alias("b"))


@query("U3_distinct_genera", W("SELECT DISTINCT BOTANICALG FROM trees", "trees"))
def u3(s, d):
    return A.trees(s, d).select("BOTANICALG").distinct()


@query("U4_membership", W("SELECT uniqueID, BOTANICALG IN ('Picea', 'Pinus') AS is_conifer FROM trees", "trees"))
def u4(s, d):
    return A.trees(s, d).select("uniqueID", F.col("BOTANICALG").isin(*L.CONIFERS).alias("is_conifer"))


# ---------------------------------------------------------------- scalar functions


def one_index(name: str):
    return lambda s, d: A.obs(s, d).select("uniqueID", "date", "ord1", "ord2", I.indices()[name].alias(name))


for _i, _n in enumerate(I.INDEX_NAMES, 1):
    query(f"M{_i}_{_n}", W(f"SELECT {_OBS_KEY}{R(V.INDEX[_n])} AS {_n} FROM obs", "obs"))(one_index(_n))


@query("M14_raw_ndvi", W("SELECT " + _OBS_KEY + rs("raw_NDVI") + " FROM raw", "raw"))
def m14(s, d):
    return raw(s, d).select("uniqueID", "date", "ord1", "ord2", "raw_NDVI")


@query("M15_visible_brightness", W("SELECT " + _OBS_KEY + rs("raw_visible_brightness", "raw_red_brightness", "raw_green_brightness", "raw_blue_brightness") + " FROM raw", "raw"))
def m15(s, d):
    return raw(s, d).select("uniqueID", "date", "ord1", "ord2", "raw_visible_brightness", "raw_red_brightness", "raw_green_brightness", "raw_blue_brightness")


@query("M16_row_max", W("SELECT uniqueID, year, " + rs("max_prob") + " FROM flagged", "flagged"))
def m16(s, d):
    return flagged(s, d).select("uniqueID", "year", "max_prob")


@query("M17_clip", W("SELECT " + _OBS_KEY + R("CASE WHEN B8 IS NOT NULL THEN least(greatest(B8, 0.1), 0.4) END") + " AS both, " + R("CASE WHEN B8 IS NOT NULL THEN greatest(B8, 0.2) END") + " AS low FROM obs", "obs"))
def m17(s, d):
    return A.obs(s, d).select("uniqueID", "date", "ord1", "ord2", X.clip("B8", 0.1, 0.4).alias("both"), X.clip("B8", 0.2).alias("low"))


@query("M18_log_sums", W("SELECT uniqueID, date, " + ", ".join(f"{R(f'ln(1 + greatest(coalesce({c}, 0), 0))')} AS {c}" for c in treeyear.SUMS) + " FROM weather_features", "weather_features"))
def m18(s, d):
    return A.weather_features(s, d).select("uniqueID", "date", *[X.log_sum(c).alias(c) for c in treeyear.SUMS])


@query("M19_cyclic_day", W("SELECT DISTINCT date, " + ", ".join(f"{R(f'{fn}(2 * pi() * dayofyear(date) / {p}::DOUBLE)')} AS {fn}_{n}" for n, p in (("seq", 365.25), ("phen", 365.0)) for fn in ("sin", "cos")) + " FROM obs", "obs"))
def m19(s, d):
    a, b = X.cyclic("date", 365.25), X.cyclic("date", 365.0)
    return A.obs(s, d).select("date").distinct().select("date", a[0].alias("sin_seq"), a[1].alias("cos_seq"), b[0].alias("sin_phen"), b[1].alias("cos_phen"))


@query("M20_date_parts", W("SELECT DISTINCT date, year(date) AS year, month(date) AS month, dayofyear(date) AS doy, strftime(date, '%Y-%m-%d') AS text, CAST(date + INTERVAL 7 DAY AS DATE) AS next FROM obs", "obs"))
def m20(s, d):
    return A.obs(s, d).select("date").distinct().select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofyear("date").alias("doy"), F.date_format("date", "yyyy-MM-dd").alias("text"), F.date_add("date", 7).alias("next"))


@query("M21_season", W(f"SELECT DISTINCT date, {V.season('date')} AS season FROM obs", "obs"))
def m21(s, d):
    return A.obs(s, d).select("date").distinct().withColumn("season", X.season("date"))


@query("M22_two_class", W(f"SELECT uniqueID, {V.two_class('BOTANICALG')} AS label FROM trees", "trees"))
def m22(s, d):
    return A.trees(s, d).select("uniqueID", L.two_class(F.col("BOTANICALG")).alias("label"))


@query("M23_catch_all_classes", W(f"SELECT uniqueID, {V.three_class('g')} AS three, {V.catch_all('g')} AS two FROM (SELECT uniqueID, CASE WHEN uniqueID % 9 <> 0 THEN BOTANICALG END AS g FROM trees)", "trees"))
def m23(s, d):
    g = F.when(F.col("uniqueID") % 9 != 0, F.col("BOTANICALG"))
    return A.trees(s, d).select("uniqueID", L.three_class(g).alias("three"), L.catch_all_two_class(g).alias("two"))


@query("M24_strings", W("SELECT uniqueID, year, trim(' ' || genus_name || ' ') AS genus, y_true_name || '_as_' || y_pred_name AS pair, genus_name || '_masked' AS masked FROM row_pred", "row_pred"))
def m24(s, d):
    return A.row_pred(s, d).select("uniqueID", "year", F.trim(F.concat(F.lit(" "), "genus_name", F.lit(" "))).alias("genus"), F.concat("y_true_name", F.lit("_as_"), "y_pred_name").alias("pair"), F.concat("genus_name", F.lit("_masked")).alias("masked"))


@query("M25_error_labels", W("SELECT uniqueID, year, row_error_type, tree_error_type FROM tree_year", "tree_year"))
def m25(s, d):
    return tree_years(s, d).select("uniqueID", "year", "row_error_type", "tree_error_type")


@query("M26_true_class_probability", W("SELECT uniqueID, year, " + rs("prob_true_class") + " FROM flagged", "flagged"))
def m26(s, d):
    return flagged(s, d).select("uniqueID", "year", "prob_true_class")


@query("M27_equality_flags", W("SELECT uniqueID, year, correct, coalesce(CASE WHEN uniqueID % 5 <> 0 THEN y_true_name END = y_pred_name, false) AS guarded FROM flagged", "flagged"))
def m27(s, d):
    return flagged(s, d).select("uniqueID", "year", "correct", X.same(F.when(F.col("uniqueID") % 5 != 0, F.col("y_true_name")), "y_pred_name").alias("guarded"))


@query("M28_null_handling", W("SELECT " + _OBS_KEY + R("coalesce(B2, 0)") + " AS filled, B8 IS NULL AS missing FROM obs", "obs"))
def m28(s, d):
    return A.obs(s, d).select("uniqueID", "date", "ord1", "ord2", F.coalesce("B2", F.lit(0.0)).alias("filled"), F.col("B8").isNull().alias("missing"))


@query("M29_units", W("SELECT uniqueID, ts, " + R("temperature_2m - 273.15::DOUBLE") + " AS celsius, " + R("total_precipitation_hourly * 1000.0::DOUBLE") + " AS mm, " + R("20 * 3.280833333::DOUBLE") + " AS feet FROM weather_hourly", "weather_hourly"))
def m29(s, d):
    return A.weather_hourly(s, d).select("uniqueID", "ts", weather.celsius(F.col("temperature_2m")).alias("celsius"), weather.millimetres(F.col("total_precipitation_hourly")).alias("mm"), F.lit(weather.feet(20)).alias("feet"))


@query("M30_softmax_argmax", W("SELECT uniqueID, year, CAST(CASE WHEN prob_conifer >= prob_broadleaf THEN 0 ELSE 1 END AS BIGINT) AS best, " + R("exp(prob_conifer) / (exp(prob_conifer) + exp(prob_broadleaf))") + " AS soft, " + R("sqrt(prob_conifer)") + " AS root FROM row_pred", "row_pred"))
def m30(s, d):
    a, b = F.exp("prob_conifer"), F.exp("prob_broadleaf")
    return A.row_pred(s, d).select("uniqueID", "year", L.argmax2(F.col("prob_conifer"), F.col("prob_broadleaf")).alias("best"), (a / (a + b)).alias("soft"), F.sqrt("prob_conifer").alias("root"))


@query("M31_band_masks", W("SELECT " + _OBS_KEY + ", ".join(f"CAST({c} IS NOT NULL AS BIGINT) AS {c}_mask" for c in ("B2", "B8", "NDVI", "LAI_ndvi")) + " FROM idx", "idx"))
def m31(s, d):
    return idx(s, d).select("uniqueID", "date", "ord1", "ord2", *[F.col(c).isNotNull().cast("int").alias(f"{c}_mask") for c in ("B2", "B8", "NDVI", "LAI_ndvi")])


@query("M32_padded_arrays", W("SELECT uniqueID, year, n AS steps, least(n, 4) AS valid, 4 AS length FROM (SELECT uniqueID, year(date) AS year, count(*) AS n FROM obs GROUP BY ALL)", "obs"))
def m32(s, d):
    q = treeyear.sequences(A.obs(s, d).withColumn("year", F.year("date")), ("B3", "B4"))
    p = treeyear.padded(q, 4, 2)
    return q.select("uniqueID", "year", F.col("length").alias("steps")).join(p, ["uniqueID", "year"]).select("uniqueID", "year", "steps", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("valid"), F.size("seq").alias("length"))


@query("M33_standardise", W("SELECT uniqueID, date, ord1, CAST(ord2 AS BIGINT) AS ord2, " + R("(B8A - (SELECT avg(B8A) FROM obs WHERE uniqueID % 10 < 8)) / (SELECT stddev_pop(B8A) FROM obs WHERE uniqueID % 10 < 8)") + " AS B8A FROM obs", "obs"))
def m33(s, d):
    o = A.obs(s, d).select("uniqueID", "date", "ord1", "ord2", "B8A")
    return treeyear.standardise(o, treeyear.moments(o.where("uniqueID % 10 < 8"), ("B8A",)), ("B8A",))


# ---------------------------------------------------------------- statistics and evaluation

_SHUF = "(uniqueID * 48271 + 42 * 7919) % 2147483647"
_SPLIT = f"SELECT uniqueID, label, CASE WHEN k <= floor(n * 0.1::DOUBLE) THEN 'test' WHEN k <= floor(n * 0.1::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SHUF}, uniqueID) AS k, count(*) OVER (PARTITION BY label) AS n FROM l)"


@query("L1_stratified_split", W("SELECT * FROM sp", "trees", l=_LABELS, sp=_SPLIT))
def l1(s, d):
    return split.stratified(label_rows(s, d), "uniqueID", "label")


@query("L2_down_sampling", W(f"SELECT uniqueID, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SHUF}, uniqueID) AS k FROM l) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY label))", "trees", l=_LABELS))
def l2(s, d):
    return split.balanced(label_rows(s, d), "label", "uniqueID")


def labelled(s, d, table):
    """Rows of labelled trees with their split, and y (0 is conifer)."""
    trees = split.stratified(label_rows(s, d), "uniqueID", "label")
    return table.join(trees, "uniqueID").withColumn("y", (F.col("label") == "broadleaf").cast("int"))


def forest_run(s, d, held: bool):
    """(rows scored by the forest of balanced training rows, importances, names
    of the features). Rows are those of other splits if ``held``, else the
    training rows. Observations without a date have no year and are left out."""
    key = ["uniqueID", "year"]
    # rows are chosen on the narrow side and met before features are made
    narrow = labelled(s, d, A.obs(s, d).select("uniqueID", F.year("date").alias("year")).distinct()).withColumn("row_id", F.col("uniqueID") * 10000 + F.col("year"))
    kept = split.balanced(narrow.where("split = 'train'"), "label", "row_id").select(narrow.columns).union(narrow.where("split <> 'train'"))
    obs = idx(s, d).select("uniqueID", F.year("date").alias("year"), "date", "ord1", "ord2", "NDVI", "CIre").repartition(*key)
    wide = phenology.flat(obs.join(kept, key).sortWithinPartitions(*key), ("split", "y", "row_id"))
    names = [c for c in wide.columns if c not in (*key, "split", "y", "row_id")]
    path = config.scratch(s, "phenology")  # features are read several times
    files.write_table(wide, f"{path}/rows")
    rows = s.read.parquet(f"{path}/rows")
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    filled = lambda df: split.impute(df, train, tuple(names))
    scored, weights = forest.fit_score(filled(train), filled(rest) if held else None, names, "y", "row_id", path)
    return rows.select(*key, "split", "y", "row_id").join(scored, "row_id"), weights, names


@query("L3_random_forest")
def l3(s, d):
    return forest_run(s, d, True)[0].select("uniqueID", "year", "split", "prob_conifer", "y_pred")


@query("L3_forest_scores", "SELECT 500 AS n_trees, 40 AS n_features, true AS sums_to_one, true AS learns")
def l3s(s, d):
    """The forest at the reference's setting knows nearly all rows that it was fitted on."""
    scored, weights, names = forest_run(s, d, False)
    found = scored.agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("a"), F.max(F.abs(F.col("prob_conifer") + F.col("prob_broadleaf") - 1)).alias("e"), F.min("trees").cast("int").alias("n_trees"))
    share = [r.importance for r in weights.collect()]  # a row a feature
    whole = F.lit(abs(sum(share) - 1) < 1e-6 and len(share) == len(names))
    return found.select("n_trees", F.lit(len(names)).alias("n_features"), ((F.col("e") < 1e-9) & whole).alias("sums_to_one"), (F.col("a") > 0.9).alias("learns"))


ANNUAL = tuple(f"{c}_{k}" for c in treeyear.COLUMNS for k in ("mean", "min", "max", "range", "std")) + tuple(f"NDVI_{x}_mean" for x in treeyear.SEASONS) + ("NDVI_spring_minus_winter", "NDVI_fall_minus_summer", "NDVI_share_above_mean")


def annual_run(s, d, settings=network.Settings()):
    """(network, history, held rows): the annual branch at the reference's setting."""
    key = ["uniqueID", "year"]
    # bands and weather are shuffled, indices are not; labels come by the narrow side and before the metrics, which stay where they are made
    seen = I.with_indices(treeyear.dealt(A.obs(s, d).join(A.weather_features(s, d), ["uniqueID", "date"])))
    narrow = labelled(s, d, treeyear.coverage(A.obs(s, d), I.BANDS)).withColumn("worker", network.worker(settings)).join(treeyear.seasonal_ndvi(idx(s, d)), key)
    table = treeyear.flat_metrics(seen.join(narrow, key).sortWithinPartitions(*key), [c for c in narrow.columns if c not in key])
    folder = config.scratch(s, "annual")
    files.write_table(table.sortWithinPartitions("split", "worker", *key), f"{folder}/rows", by=("split", "worker"))
    rows = s.read.parquet(f"{folder}/rows")
    net, history = network.train(s, rows.where("split = 'train'"), rows.where("split = 'val'"), ANNUAL, "y", folder, settings)
    return net, history, rows


@query("L4_annual_network")
def l4(s, d):
    net, _, rows = annual_run(s, d)
    return network.predict(net, rows.where("split <> 'train'")).select("uniqueID", "year", "split", "prob_conifer", "y_pred")


@query("L5_fusion_simple", W("SELECT uniqueID, CAST(y_true AS BIGINT) AS y_true, CAST(CASE WHEN round(p, 12) >= round(1 - p, 12) THEN 0 ELSE 1 END AS BIGINT) AS y_pred_fused, " + R("p") + " AS prob_conifer, " + rs("total_weight") + " FROM (SELECT *, exp(a) / (exp(a) + exp(b)) AS p FROM si)", "logs", si=_SIMPLE.format("logs")))
def l5(s, d):
    return fusion.simple(A.row_pred(s, d))


@query("L6_fusion_temporal", W("SELECT uniqueID, n_years, " + rs("total_weight") + ", " + big("y_true", "y_pred_fused") + ", y_true_name, y_pred_fused_name, " + rs("prob_conifer") + " FROM fused", "fused"))
def l6(s, d):
    return fusion.temporal(A.row_pred(s, d))


_BLEND = "SELECT uniqueID, 0.75::DOUBLE * (CASE WHEN sum(w) <= 0 THEN avg(la) ELSE sum(w * la) / sum(w) END) + 0.25::DOUBLE * max(la) + 0.05::DOUBLE AS a, CASE WHEN sum(w) <= 0 THEN avg(lb) ELSE sum(w * lb) / sum(w) END AS b FROM logs GROUP BY uniqueID"


@query("L6_fusion_conifer_max", W("SELECT uniqueID, CAST(CASE WHEN round(a, 12) >= round(b, 12) THEN 0 ELSE 1 END AS BIGINT) AS y_pred_fused, " + R("exp(a) / (exp(a) + exp(b))") + " AS prob_conifer FROM bl", "logs", bl=_BLEND))
def l6max(s, d):
    return fusion.temporal(A.row_pred(s, d), conifer_max=0.25).select("uniqueID", "y_pred_fused", "prob_conifer")


@query("L7_fusion_mean_log", W("SELECT uniqueID, CAST(y_true AS BIGINT) AS y_true, CAST(CASE WHEN round(a, 12) >= round(b, 12) THEN 0 ELSE 1 END AS BIGINT) AS y_pred, " + R("a") + " AS log_conifer, " + R("b") + " AS log_broadleaf FROM (SELECT uniqueID, max(y_true) AS y_true, avg(ln(prob_conifer + 0.000000000001::DOUBLE)) AS a, avg(ln(prob_broadleaf + 0.000000000001::DOUBLE)) AS b FROM row_pred GROUP BY uniqueID)", "row_pred"))
def l7(s, d):
    return fusion.mean_log(A.row_pred(s, d))


@query("L8_decide", W("SELECT uniqueID, year, CAST(CASE WHEN prob_conifer >= 0.6::DOUBLE THEN 0 ELSE 1 END AS BIGINT) AS strict, CAST(CASE WHEN prob_conifer >= 0.5 THEN 0 ELSE 1 END AS BIGINT) AS larger FROM row_pred", "row_pred"))
def l8(s, d):
    p = F.col("prob_conifer")
    return A.row_pred(s, d).select("uniqueID", "year", fusion.decide(p, 0.6).alias("strict"), fusion.decide(p).alias("larger"))


@query("L9_penalised_loss", W("SELECT " + R("ce") + " AS cross_entropy, " + R("sh") + " AS shortfall, " + R("ce + 0.5 * sh") + " AS loss FROM (SELECT sum(-weight * ln(greatest(CASE WHEN y_true = 0 THEN prob_conifer ELSE prob_broadleaf END, 1e-12::DOUBLE))) / sum(weight) AS ce, avg(1 - prob_conifer) FILTER (y_true = 0) AS sh FROM row_pred JOIN cw ON y_true = class)", "row_pred", cw=_WEIGHTS))
def l9(s, d):
    rows = A.row_pred(s, d)
    return split.penalised_loss(rows, split.class_weights(rows.where("split = 'train'"), "y_true"))


HISTORY = "epoch long, lr double, train_loss double, train_acc_row double, val_loss double, val_acc_row double, val_acc_tree_fused double, val_conifer_f1 double"


@query("L10_training_history")
def l10(s, d):
    """A row for each epoch of the run that L4 takes its network from."""
    return s.createDataFrame(annual_run(s, d)[1], HISTORY)


@query("L11_mean_loss", W("SELECT " + R("avg(-ln(greatest(CASE WHEN y_true = 0 THEN prob_conifer ELSE prob_broadleaf END, 1e-12::DOUBLE)))") + " AS loss, " + R("avg(CAST(y_true = y_pred AS INT))") + " AS accuracy, count(*) AS n FROM row_pred", "row_pred"))
def l11(s, d):
    return ml.mean_loss(A.row_pred(s, d), "y_true")


@query("L12_radius_index", W("SELECT p.uniqueID AS a, count(*) AS n FROM trees p JOIN trees q ON abs(p.X_COORD - q.X_COORD) <= 50 AND p.uniqueID <> q.uniqueID AND (p.X_COORD - q.X_COORD) * (p.X_COORD - q.X_COORD) + (p.Y_COORD - q.Y_COORD) * (p.Y_COORD - q.Y_COORD) <= 2500 GROUP BY p.uniqueID", "trees"))
def l12(s, d):
    return spatial.radius_counts(A.trees(s, d), 50.0)


_CELL = "SELECT {by}count(*) FILTER (y_true = 0 AND y_pred = 0) AS n00, count(*) FILTER (y_true = 0 AND y_pred = 1) AS n01, count(*) FILTER (y_true = 1 AND y_pred = 0) AS n10, count(*) FILTER (y_true = 1 AND y_pred = 1) AS n11 FROM row_pred{group}"
_ALL, _BY = _CELL.format(by="", group=""), _CELL.format(by="split, ", group=" GROUP BY split")
_CM = " UNION ALL ".join(f"SELECT split, 'true_{a}' AS true_class, 'pred_{b}' AS predicted_class, {{}} AS n FROM cl".format(f"{{n{i}{j}}}") for i, a in enumerate(L.CLASSES) for j, b in enumerate(L.CLASSES))
_PLAIN = {f"n{i}{j}": f"n{i}{j}" for i in (0, 1) for j in (0, 1)}
_NORM = {f"n{i}{j}": R(f"n{i}{j} / (n{i}0 + n{i}1 + 0.0000000001::DOUBLE)") for i in (0, 1) for j in (0, 1)}


@query("E1_confusion_matrix", W(_CM.format(**_PLAIN), "row_pred", cl=_BY))
def e1(s, d):
    return evaluate.confusion(A.row_pred(s, d), ["split"])


@query("E1_confusion_normalised", W(_CM.format(**_NORM), "row_pred", cl=_BY))
def e1n(s, d):
    return evaluate.confusion(A.row_pred(s, d), ["split"], normalise=True)


@query("E2_melt", W(" UNION ALL ".join(f"SELECT split, 'n{i}{j}' AS cell, n{i}{j} AS n FROM cl" for i in (0, 1) for j in (0, 1)), "row_pred", cl=_BY))
def e2(s, d):
    return evaluate.melt(evaluate.cells(A.row_pred(s, d), ["split"]), ["split"], ["n00", "n01", "n10", "n11"], "cell", "n")


_NULL = "CAST(NULL AS DOUBLE)"
_REPORT = " UNION ALL ".join(
    [f"SELECT split, '{c}' AS class_or_average, {R(f'{c}_precision')} AS precision, {R(f'{c}_recall')} AS recall, {R(f'{c}_f1')} AS f1_score, {R(f'{c}_support')} AS support FROM sc" for c in L.CLASSES]
    + [f"SELECT split, 'accuracy', {_NULL}, {_NULL}, {R('accuracy')}, {_NULL} FROM sc"]
    + [f"SELECT split, '{a} avg', {R(f'{a}_precision')}, {R(f'{a}_recall')}, {R(f'{a}_f1')}, {R('n_evaluated')} FROM sc" for a in ("macro", "weighted")]
)


@query("E3_classification_report", W(_REPORT, "row_pred", cl=_BY, sc=scores_sql("cl")))
def e3(s, d):
    return evaluate.report(A.row_pred(s, d), ["split"])


_METRIC_COLS = [m for m in evaluate.METRICS if not m.endswith("support")]


@query("E4_group_evaluation", W("SELECT split, n_evaluated, conifer_support, broadleaf_support, " + rs(*_METRIC_COLS) + " FROM sc", "row_pred", cl=_BY, sc=scores_sql("cl")))
def e4(s, d):
    return evaluate.summary(A.row_pred(s, d), ["split"])


@query("E5_class_scores", W("SELECT conifer_support, broadleaf_support, " + rs(*[m for m in _METRIC_COLS if "conifer" in m or "broadleaf" in m]) + " FROM sc", "row_pred", cl=_ALL, sc=scores_sql("cl")))
def e5(s, d):
    return evaluate.summary(A.row_pred(s, d)).select("conifer_support", "broadleaf_support", *[m for m in _METRIC_COLS if "conifer" in m or "broadleaf" in m])


@query("E6_run_summary", W("SELECT 'seq0_ann1' AS run, 42 AS seed, n_evaluated, " + rs("accuracy", "macro_f1", "conifer_f1") + ", (SELECT count(DISTINCT uniqueID) FROM row_pred) AS n_trees FROM sc", "row_pred", cl=_ALL, sc=scores_sql("cl")))
def e6(s, d):
    rows = A.row_pred(s, d)
    trees = rows.agg(F.count_distinct("uniqueID").alias("n_trees"))
    return evaluate.summary(rows).select(F.lit("seq0_ann1").alias("run"), F.lit(42).alias("seed"), "n_evaluated", "accuracy", "macro_f1", "conifer_f1").crossJoin(F.broadcast(trees))  # one row


@query("E7_qa_flags", W("SELECT uniqueID, true_mixed_QA_flag, predicted_mixed_QA_flag, remove_by_mixed_QA FROM f", "neighbours", f=_FLAGS))
def e7(s, d):
    return qa_flags(s, d).select("uniqueID", "true_mixed_QA_flag", "predicted_mixed_QA_flag", "remove_by_mixed_QA")
