"""Vegetation indices of the ten optical bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import clip, nullify, row_mean

BANDS = ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12")
EPS = 1e-10  # added to denominators


def _band(name: str) -> Column:
    return F.col(name).cast("double")


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a, b + F.lit(EPS))


def _normal(a: str, b: str) -> Column:
    return _over(_band(a) - _band(b), _band(a) + _band(b))


def ndvi() -> Column:
    return _normal("B8", "B4")


def cire() -> Column:
    return _over(_band("B8A"), _band("B5")) - 1


def indices() -> dict[str, Column]:
    b3, b4, b5, b6, b7, b8 = map(_band, ("B3", "B4", "B5", "B6", "B7", "B8"))
    twice = 2 * b8 + 1
    gap = F.try_divide(F.lit(0.69) - ndvi(), F.lit(0.59)) + F.lit(EPS)
    out = {
        "NDVI": ndvi(),
        "GNDVI": _normal("B8", "B3"),
        "CIg": _over(b8, b3) - 1,
        "CIre": cire(),
        "MTCI": _over(b6 - b5, b5 - b4),
        "MCARI": ((b5 - b4) - F.lit(0.2) * (b5 - b3)) * _over(b5, b4),
        "NDVIre1": _normal("B8", "B5"),
        "NDVIre2": _normal("B8", "B6"),
        "REPI": 700 + 40 * _over((b4 + b7) / F.lit(2.0) - b5, b6 - b5),
        "NDII": _normal("B8", "B11"),
        "MSAVI": F.lit(0.5) * (twice - F.sqrt(twice * twice - 8 * (b8 - b4))),
        "LAI_ndvi": clip(-F.ln(gap), 0, 6) / F.lit(6.0),
        "LAI_re": clip(F.lit(3.618) * cire() - F.lit(0.118), 0, 6) / F.lit(6.0),
    }
    return {k: nullify(v) for k, v in out.items()}


INDEX_NAMES = ("NDVI", "GNDVI", "CIg", "CIre", "MTCI", "MCARI", "NDVIre1", "NDVIre2", "REPI", "NDII", "MSAVI", "LAI_ndvi", "LAI_re")


def with_indices(obs: DataFrame) -> DataFrame:
    """All thirteen indices, NULL where a band is missing or a value is not finite."""
    return obs.withColumns(indices())


def with_raw(obs: DataFrame) -> DataFrame:
    """NDVI of coerced bands, and brightness over the visible bands present."""
    b = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("B2", "B3", "B4", "B8")}
    return obs.withColumns(
        {
            "raw_NDVI": nullify(F.try_divide(b["B8"] - b["B4"], b["B8"] + b["B4"] + F.lit(EPS))),
            "raw_visible_brightness": row_mean(b["B2"], b["B3"], b["B4"]),
            "raw_red_brightness": b["B4"],
            "raw_green_brightness": b["B3"],
            "raw_blue_brightness": b["B2"],
        }
    )
