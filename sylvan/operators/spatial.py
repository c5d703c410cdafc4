"""Neighbours within a radius."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .weather import feet

RADIUS = feet(20)


#: Rows of one place that are held as one list at most.
BLOCK = 512


def _near(points: DataFrame, radius: float, x: str, y: str, carry: dict[str, Column]) -> DataFrame:
    """ax, ay, bx, by and ``carry`` as a_ and b_ of all rows at most ``radius``
    apart, each row with itself too.

    Cells are as wide as the radius, so partners lie in the 3 x 3 cells
    around a point: one side is repeated nine times and the join is by cell.
    No side is broadcast: the size that Spark expects of the repeated one,
    and of lists, is far too small.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    side = lambda s: [F.col(x).alias(f"{s}x"), F.col(y).alias(f"{s}y"), *[c.alias(f"{s}_{n}") for n, c in carry.items()]]
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = points.select(*side("b"), cell(x).alias("cx"), cell(y).alias("cy"))
    q = points.select(*side("a"), cell(x).alias("x0"), cell(y).alias("y0"), F.explode(off).alias("o"))
    q = q.withColumn("cx", F.col("x0") + F.col("o.i")).withColumn("cy", F.col("y0") + F.col("o.j")).drop("x0", "y0", "o")
    return q.hint("merge").join(p, ["cx", "cy"]).where(_apart() <= F.lit(radius * radius)).drop("cx", "cy")


def _apart() -> Column:
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return dx * dx + dy * dy


def radius_pairs(points: DataFrame, radius: float = RADIUS, key: str = "uniqueID", x: str = "X_COORD", y: str = "Y_COORD", carry: tuple[str, ...] = (), shown: Callable[[Column], Column] = lambda d: d) -> DataFrame:
    """Directed pairs (a, b) at most ``radius`` apart, a and b of distinct
    keys, with columns to ``carry`` of both sides as a_ and b_, and
    ``distance`` as ``shown``. Null keys and coordinates have no pairs.

    Rows of one place (and carried columns) meet as lists of up to about
    ``BLOCK`` keys, so candidates and distances are made for places, and rows
    only for pairs.
    """
    rows = points.dropna(subset=[key, x, y])
    place = [x, y, *carry]
    size = rows.groupBy(*place).agg(F.count("*").alias("_m")).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(place)], "_m")
    met = rows.join(size, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(place)])
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("_m") / BLOCK))
    blocks = met.groupBy(*place, part.alias("_part")).agg(F.collect_list(key).alias("_keys"))
    near = _near(blocks, radius, x, y, {"keys": F.col("_keys")} | {c: F.col(c) for c in carry})
    both = [f"{s}_{c}" for c in carry for s in "ab"]
    lists = near.select("a_keys", "b_keys", shown(F.sqrt(_apart())).alias("distance"), *both)
    return lists.select(F.explode("a_keys").alias("a"), "b_keys", "distance", *both).select("a", F.explode("b_keys").alias("b"), "distance", *both).where(F.col("a") != F.col("b"))


def radius_counts(points: DataFrame, radius: float = RADIUS, key: str = "uniqueID", x: str = "X_COORD", y: str = "Y_COORD") -> DataFrame:
    """(a, n): how many pairs ``radius_pairs`` has of each key that has any,
    from counts of places instead of pairs."""
    own = points.dropna(subset=[key, x, y]).groupBy(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay")).agg(F.count("*").alias("own"))
    places = own.groupBy("ax", "ay").agg(F.sum("own").alias("m"))
    around = _near(places, radius, "ax", "ay", {"m": F.col("m")}).groupBy("ax", "ay").agg(F.sum("b_m").alias("k"))
    met = own.join(around, ["ax", "ay"]).groupBy("a").agg(F.sum(F.col("own") * F.col("k")).alias("k"), F.collect_list(F.struct("ax", "ay", "own")).alias("at"))
    # rows of one key are not each other's neighbours
    apart = lambda p, q: (p["ax"] - q["ax"]) * (p["ax"] - q["ax"]) + (p["ay"] - q["ay"]) * (p["ay"] - q["ay"])
    within = lambda p: F.aggregate("at", F.lit(0).cast("long"), lambda n, q: n + F.when(apart(p, q) <= F.lit(radius * radius), p["own"] * q["own"]).otherwise(0))
    same = F.aggregate("at", F.lit(0).cast("long"), lambda n, p: n + within(p))
    return met.select("a", (F.col("k") - same).alias("n")).where("n > 0")


def neighbour_counts(base: DataFrame, radius: float = RADIUS) -> DataFrame:
    """``base`` with its neighbours, those of the other true class, those of
    another predicted class, and the rates (NULL without neighbours)."""
    own = ("X_COORD", "Y_COORD", "true_label", "pred_label")
    # rows of one place and labels stand for each other: repeated places make no pairs
    kinds = base.dropna(subset=list(own[:2])).groupBy(*own).agg(F.count("*").alias("m")).withColumn("kind", F.struct(*own))
    carry = {c: F.col(c) for c in ("kind", "true_label", "pred_label", "m")}
    edges = _near(kinds, radius, *own[:2], carry).where(F.col("a_kind") != F.col("b_kind"))
    differ = lambda c: F.sum(F.when(F.col(f"a_{c}") != F.col(f"b_{c}"), F.col("b_m")).otherwise(0))
    others = edges.groupBy(F.col("a_kind").alias("kind")).agg(F.sum("b_m").alias("k"), differ("true_label").alias("o"), differ("pred_label").alias("d"))
    n = kinds.select("kind", "m").join(others, "kind", "left").select(
        *[F.col(f"kind.{c}").alias(f"of_{c}") for c in own], F.nullif(F.coalesce("k", F.lit(0)) + F.col("m") - 1, F.lit(0)).alias("n"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("d", F.lit(0)).alias("d")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    same = [F.col(f"of_{c}").eqNullSafe(F.col(c)) for c in own[2:]] + [F.col(f"of_{c}") == F.col(c) for c in own[:2]]
    return base.join(n, same, "left").select(
        *base.columns, zero("n").alias("n_neighbors_within_radius"), zero("o").alias("n_true_opposite_neighbors_within_radius"), ratio("o", "n").alias("true_opposite_neighbor_rate"),
        zero("d").alias("n_pred_disagree_neighbors_within_radius"), ratio("d", "n").alias("neighbor_prediction_disagreement_rate"),
    )
