"""DuckDB text of the logical tables, for the oracle statements."""

from __future__ import annotations

from ..functions.labels import ALL_CONIFERS, BROADLEAVES, CONIFERS, ORNAMENTALS
from ..sources.adapters import WEATHER


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def r(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({v}) >= 1e8 THEN round({v}, -3) WHEN abs({v}) >= 1e6 THEN round({v}, 0) ELSE round({v}, 6) END + 0.0"


def season(d: str) -> str:
    return f"CASE WHEN month({d}) IN (12, 1, 2) THEN 'winter' WHEN month({d}) IN (3, 4, 5) THEN 'spring' WHEN month({d}) IN (6, 7, 8) THEN 'summer' WHEN month({d}) IS NOT NULL THEN 'fall' END"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) END)"


_E = "0.0000000001::DOUBLE"
NDVI, CIRE = f"((B8 - B4) / (B8 + B4 + {_E}))", f"(B8A / (B5 + {_E}) - 1)"
_GAP = f"((0.69::DOUBLE - {NDVI}) / 0.59::DOUBLE + {_E})"
_MS = "((2 * B8 + 1) * (2 * B8 + 1) - 8 * (B8 - B4))"
INDEX = {
    "NDVI": NDVI,
    "GNDVI": f"(B8 - B3) / (B8 + B3 + {_E})",
    "CIg": f"B8 / (B3 + {_E}) - 1",
    "CIre": CIRE,
    "MTCI": f"(B6 - B5) / (B5 - B4 + {_E})",
    "MCARI": f"((B5 - B4) - 0.2::DOUBLE * (B5 - B3)) * (B5 / (B4 + {_E}))",
    "NDVIre1": f"(B8 - B5) / (B8 + B5 + {_E})",
    "NDVIre2": f"(B8 - B6) / (B8 + B6 + {_E})",
    "REPI": f"700 + 40 * (((B4 + B7) / 2.0::DOUBLE - B5) / (B6 - B5 + {_E}))",
    "NDII": f"(B8 - B11) / (B8 + B11 + {_E})",
    "MSAVI": f"CASE WHEN {_MS} >= 0 THEN 0.5::DOUBLE * (2 * B8 + 1 - sqrt({_MS})) END",
    "LAI_ndvi": f"CASE WHEN {_GAP} > 0 THEN least(greatest(-ln({_GAP}), 0), 6) / 6.0::DOUBLE END",
    "LAI_re": f"least(greatest(CASE WHEN {CIRE} IS NOT NULL THEN 3.618::DOUBLE * {CIRE} - 0.118::DOUBLE END, 0), 6) / 6.0::DOUBLE",
}
INDEX["LAI_re"] = f"CASE WHEN {CIRE} IS NOT NULL THEN {INDEX['LAI_re']} END"


def two_class(g: str) -> str:
    return f"CASE WHEN trim({g}) IN ({names(CONIFERS)}) THEN 'conifer' WHEN trim({g}) IN ({names(BROADLEAVES)}) THEN 'broadleaf' END"


def three_class(g: str) -> str:
    return f"CASE WHEN trim({g}) IN ({names(ALL_CONIFERS)}) THEN 'conifer' WHEN trim({g}) IN ({names(ORNAMENTALS)}) THEN 'urban_ornamental' ELSE 'deciduous' END"


def catch_all(g: str) -> str:
    return f"CASE WHEN trim({g}) IN ({names(ALL_CONIFERS)}) THEN 'conifer' ELSE 'broadleaf' END"


def name(c: str) -> str:
    return f"CASE {c} WHEN 0 THEN 'conifer' WHEN 1 THEN 'broadleaf' END"


_K = "(uniqueID * 3 + dayofyear(date))"
VIEWS = {
    "obs": """SELECT l_partkey AS uniqueID, CAST(l_shipdate AS DATE) AS date, l_orderkey AS ord1, l_linenumber AS ord2,
  CASE WHEN l_linenumber <> 7 THEN l_tax + 0.01::DOUBLE END AS B2, l_tax + 0.02::DOUBLE AS B3, l_discount + 0.01::DOUBLE AS B4,
  0.05::DOUBLE + l_discount * 0.5::DOUBLE + l_tax * 0.5::DOUBLE AS B5, 0.10::DOUBLE + l_quantity / 200.0::DOUBLE AS B6, 0.12::DOUBLE + l_quantity / 150.0::DOUBLE AS B7,
  CASE WHEN l_linenumber <> 6 THEN 0.05::DOUBLE + l_quantity / 100.0::DOUBLE END AS B8, 0.06::DOUBLE + l_quantity / 100.0::DOUBLE AS B8A, 0.05::DOUBLE + l_discount AS B11, 0.04::DOUBLE + l_tax AS B12
FROM lineitem""",
    "trees": """SELECT p_partkey AS uniqueID, CAST(p_size AS DOUBLE) * 20 AS X_COORD, CAST((p_partkey * 7) % 400 AS DOUBLE) * 25 AS Y_COORD,
  CASE p_type WHEN 'PROMO' THEN 'Picea' WHEN 'SMALL' THEN 'Pinus' WHEN 'ECONOMY' THEN 'Acer' WHEN 'LARGE' THEN 'Quercus' WHEN 'MEDIUM' THEN 'Ginkgo' ELSE 'Salix' END AS BOTANICALG
FROM part""",
    "weather_hourly": """SELECT user_id AS uniqueID, ts, 263.15::DOUBLE + value / 10.0::DOUBLE AS temperature_2m,
  CAST(event_id % 7 AS DOUBLE) / 1000 AS total_precipitation_hourly, value * 1000.0::DOUBLE AS surface_solar_radiation_downwards_hourly
FROM events""",
    "weather_features": "SELECT uniqueID, date, " + ", ".join(f"CAST(({_K} * {i + 2}) % {29 + 2 * i} AS DOUBLE) AS {c}" for i, c in enumerate(WEATHER)) + " FROM (SELECT DISTINCT uniqueID, date FROM obs) WHERE (uniqueID + dayofyear(date)) % 5 <> 0",
    "scenes": "SELECT CAST(o_orderkey AS VARCHAR) AS scene_id, o_orderdate AS ts, CAST(o_orderkey * 7 % 101 AS DOUBLE) AS cloud_pct FROM orders",
    "clouds": "SELECT CAST(o_orderkey AS VARCHAR) AS scene_id, o_orderdate AS ts, o_orderkey * 2 AS image FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderdate, o_orderkey * 2 + 1 FROM orders WHERE o_orderkey % 6 = 1",
    "pixels": """SELECT CAST(l_orderkey AS VARCHAR) AS scene_id, l_partkey AS uniqueID, l_linenumber AS line, l_discount + 0.01::DOUBLE AS B4, 0.05::DOUBLE + l_quantity / 100.0::DOUBLE AS B8,
  (l_orderkey + l_linenumber) % 12 AS scl, CAST((l_orderkey * 13 + l_linenumber * 7) % 100 AS DOUBLE) AS probability FROM lineitem""",
    "row_pred": f"""SELECT *, {name("y_true")} AS y_true_name, {name("y_pred")} AS y_pred_name FROM (
  SELECT *, CASE WHEN prob_conifer >= prob_broadleaf THEN 0 ELSE 1 END AS y_pred FROM (
  SELECT o.uniqueID, o.year, t.BOTANICALG AS genus_name, o.valid_measurements, CASE WHEN t.BOTANICALG IN ('Picea', 'Pinus') THEN 0 ELSE 1 END AS y_true,
    CAST((o.uniqueID * 37 + o.year * 11) % 101 AS DOUBLE) / 100 AS prob_conifer, 1.0::DOUBLE - CAST((o.uniqueID * 37 + o.year * 11) % 101 AS DOUBLE) / 100 AS prob_broadleaf,
    CASE WHEN o.uniqueID % 10 < 8 THEN 'train' WHEN o.uniqueID % 10 = 8 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT uniqueID, year(date) AS year, count(B2) + count(B8) + 8 * count(*) AS valid_measurements FROM obs GROUP BY ALL) o
  JOIN trees t ON o.uniqueID = t.uniqueID AND t.BOTANICALG <> 'Salix'))""",
    "idx": "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in INDEX.items()) + " FROM obs",
    "raw": f"""SELECT *, year(date) AS year, {NDVI} AS raw_NDVI, (coalesce(B2, 0) + coalesce(B3, 0) + coalesce(B4, 0)) / (CAST(B2 IS NOT NULL AS INT) + CAST(B3 IS NOT NULL AS INT) + CAST(B4 IS NOT NULL AS INT)) AS raw_visible_brightness,
  B4 AS raw_red_brightness, B3 AS raw_green_brightness, B2 AS raw_blue_brightness FROM obs""",
    "daily": """SELECT *, greatest(tmean_c - 10.0::DOUBLE, 0) AS gdd_day FROM (SELECT uniqueID, CAST(ts AS DATE) AS date, avg(temperature_2m) - 273.15::DOUBLE AS tmean_c,
  sum(total_precipitation_hourly) * 1000.0::DOUBLE AS precip_mm, sum(surface_solar_radiation_downwards_hourly) AS srad_j FROM weather_hourly GROUP BY ALL)""",
    "met": "SELECT i.*, w.* EXCLUDE (uniqueID, date) FROM idx i JOIN weather_features w USING (uniqueID, date)",
    "summer": """SELECT uniqueID, year, avg(raw_NDVI) AS raw_NDVI_summer_mean, min(raw_NDVI) AS raw_NDVI_summer_min, max(raw_NDVI) AS raw_NDVI_summer_max, stddev_samp(raw_NDVI) AS raw_NDVI_summer_std,
  avg(raw_visible_brightness) AS raw_visible_brightness_summer_mean, max(raw_visible_brightness) AS raw_visible_brightness_summer_max, avg(raw_red_brightness) AS raw_red_brightness_summer_mean,
  avg(raw_green_brightness) AS raw_green_brightness_summer_mean, avg(raw_blue_brightness) AS raw_blue_brightness_summer_mean, count(raw_NDVI) AS n_summer_obs
FROM raw WHERE month(date) IN (6, 7, 8) GROUP BY ALL""",
    "annual": "SELECT uniqueID, year, avg(raw_NDVI) AS raw_NDVI_annual_mean, min(raw_NDVI) AS raw_NDVI_annual_min, max(raw_NDVI) AS raw_NDVI_annual_max, avg(raw_visible_brightness) AS raw_visible_brightness_annual_mean, count(raw_NDVI) AS n_annual_obs FROM raw GROUP BY ALL",
    "logs": "SELECT *, ln(least(greatest(prob_conifer, 0.00000001::DOUBLE), 1.0)) AS la, ln(least(greatest(prob_broadleaf, 0.00000001::DOUBLE), 1.0)) AS lb, CAST(valid_measurements AS DOUBLE) AS w FROM row_pred",
    "fused": f"""SELECT uniqueID, n_years, total_weight, y_true, CASE WHEN round(a, 12) >= round(b, 12) THEN 0 ELSE 1 END AS y_pred_fused, {name("y_true")} AS y_true_name,
  CASE WHEN round(a, 12) >= round(b, 12) THEN 'conifer' ELSE 'broadleaf' END AS y_pred_fused_name, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS prob_conifer
FROM (SELECT uniqueID, count(*) AS n_years, sum(w) AS total_weight, max(y_true) AS y_true,
  CASE WHEN sum(w) <= 0 THEN avg(la) ELSE sum(w * la) / sum(w) END + 0.05::DOUBLE AS a, CASE WHEN sum(w) <= 0 THEN avg(lb) ELSE sum(w * lb) / sum(w) END AS b FROM logs GROUP BY uniqueID)""",
    "tree_year": f"""SELECT *, y_true_name = y_pred_name AS row_correct, coalesce(y_true_name = y_pred_fused_name, false) AS tree_correct,
  CASE WHEN y_true_name = y_pred_name THEN 'correct' WHEN y_true_name = 'conifer' THEN 'conifer_false_negative' ELSE 'broadleaf_false_positive' END AS row_error_type,
  CASE WHEN y_true_name = y_pred_fused_name THEN 'correct' WHEN y_true_name = 'conifer' THEN 'conifer_false_negative' ELSE 'broadleaf_false_positive' END AS tree_error_type
FROM (SELECT a.*, s.* EXCLUDE (uniqueID, year), p.genus_name, p.y_true_name, p.y_pred_name, p.prob_conifer, p.prob_broadleaf, p.valid_measurements, f.y_pred_fused_name
  FROM annual a LEFT JOIN summer s USING (uniqueID, year) JOIN row_pred p USING (uniqueID, year) LEFT JOIN fused f ON f.uniqueID = a.uniqueID)""",
    "tree_summary": """SELECT uniqueID, genus_name, y_true_name, y_pred_fused_name, tree_correct, tree_error_type, avg(prob_conifer) AS mean_prob_conifer, max(prob_conifer) AS max_prob_conifer, min(prob_conifer) AS min_prob_conifer,
  avg(prob_broadleaf) AS mean_prob_broadleaf, avg(raw_NDVI_summer_mean) AS mean_raw_NDVI_summer_mean, min(raw_NDVI_summer_mean) AS min_raw_NDVI_summer_mean, max(raw_NDVI_summer_mean) AS max_raw_NDVI_summer_mean,
  avg(raw_NDVI_summer_std) AS mean_raw_NDVI_summer_std, avg(raw_visible_brightness_summer_mean) AS mean_raw_visible_brightness_summer_mean, max(raw_visible_brightness_summer_mean) AS max_raw_visible_brightness_summer_mean,
  avg(raw_visible_brightness_summer_max) AS mean_raw_visible_brightness_summer_max, avg(raw_red_brightness_summer_mean) AS mean_raw_red_brightness_summer_mean, avg(raw_green_brightness_summer_mean) AS mean_raw_green_brightness_summer_mean,
  avg(raw_blue_brightness_summer_mean) AS mean_raw_blue_brightness_summer_mean, avg(raw_NDVI_annual_mean) AS mean_raw_NDVI_annual_mean, avg(raw_visible_brightness_annual_mean) AS mean_raw_visible_brightness_annual_mean,
  count(DISTINCT year) AS n_years, count(raw_NDVI_summer_mean) AS n_years_with_summer_obs, CAST(coalesce(sum(valid_measurements), 0) AS BIGINT) AS total_valid_measurements
FROM tree_year WHERE y_pred_fused_name IS NOT NULL GROUP BY ALL""",
    "flagged": "SELECT *, y_true_name = y_pred_name AS correct, CASE WHEN y_true_name = y_pred_name THEN 'correct' ELSE y_true_name || '_as_' || y_pred_name END AS error_type, greatest(prob_conifer, prob_broadleaf) AS max_prob, CASE WHEN y_true_name = 'conifer' THEN prob_conifer ELSE prob_broadleaf END AS prob_true_class FROM row_pred",
    "tree_flagged": "SELECT *, y_true_name = y_pred_fused_name AS correct, CASE WHEN y_true_name = y_pred_fused_name THEN 'correct' ELSE y_true_name || '_as_' || y_pred_fused_name END AS error_type FROM fused",
    "base": f"""SELECT f.uniqueID, CASE WHEN f.uniqueID % 10 < 8 THEN 'train' WHEN f.uniqueID % 10 = 8 THEN 'val' ELSE 'test' END AS split, CASE WHEN f.uniqueID % 10 < 8 THEN 'training' ELSE 'non_training' END AS train_status,
  t.BOTANICALG AS genus, t.X_COORD, t.Y_COORD, f.y_true AS true_label, f.y_pred_fused AS pred_label FROM fused f JOIN trees t USING (uniqueID) WHERE {two_class("t.BOTANICALG")} IS NOT NULL""",
    "neighbours": f"""SELECT b.uniqueID, b.split, b.train_status, b.genus, b.true_label, b.pred_label, CAST(coalesce(n, 0) AS BIGINT) AS n_neighbors_within_radius, CAST(coalesce(o, 0) AS BIGINT) AS n_true_opposite_neighbors_within_radius,
  {ratio("o", "n")} AS true_opposite_neighbor_rate, CAST(coalesce(d, 0) AS BIGINT) AS n_pred_disagree_neighbors_within_radius, {ratio("d", "n")} AS neighbor_prediction_disagreement_rate
FROM base b LEFT JOIN (SELECT p.uniqueID, count(*) AS n, count(*) FILTER (p.true_label <> q.true_label) AS o, count(*) FILTER (p.pred_label <> q.pred_label) AS d
  FROM base p JOIN base q ON abs(p.X_COORD - q.X_COORD) <= 65.61666666 AND p.uniqueID <> q.uniqueID AND (p.X_COORD - q.X_COORD) * (p.X_COORD - q.X_COORD) + (p.Y_COORD - q.Y_COORD) * (p.Y_COORD - q.Y_COORD) <= 65.61666666::DOUBLE * 65.61666666::DOUBLE
  GROUP BY p.uniqueID) x USING (uniqueID)""",
}
NEEDS = {
    "row_pred": ["obs", "trees"], "weather_features": ["obs"], "idx": ["obs"], "raw": ["obs"], "daily": ["weather_hourly"], "met": ["idx", "weather_features"], "summer": ["raw"], "annual": ["raw"], "logs": ["row_pred"], "fused": ["logs"],
    "tree_year": ["annual", "summer", "fused"], "tree_summary": ["tree_year"], "flagged": ["row_pred"], "tree_flagged": ["fused"], "base": ["fused"], "neighbours": ["base"],
}


def with_views(body: str, *needed: str, **more: str) -> str:
    """``body`` after the views that it needs and CTEs of its own."""
    order: list[str] = []

    def add(v: str) -> None:
        if v not in order:
            for x in NEEDS.get(v, []):
                add(x)
            order.append(v)

    for v in needed:
        add(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
