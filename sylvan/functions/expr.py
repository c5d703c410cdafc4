"""Null-safe column expressions: a missing number is NULL, never NaN or infinite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nullify(x: Col) -> Column:
    """NULL for NaN and the infinities."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(x: Col, low: float | None = None, high: float | None = None) -> Column:
    """Bounded x; NULL stays NULL (least and greatest would skip it)."""
    x = y = _c(x)
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def ratio(a: Col, b: Col) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def row_mean(*cols: Col) -> Column:
    """Mean of a row's values that are not NULL; NULL if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0.0)) for c in cols])
    return ratio(total, n_valid(*cols))


def n_valid(*cols: Col) -> Column:
    return reduce(lambda a, b: a + b, [_c(c).isNotNull().cast("int") for c in cols])


def same(a: Col, b: Col) -> Column:
    """Equality that is false for NULL."""
    return F.coalesce(_c(a) == _c(b), F.lit(False))


def season(date: Col) -> Column:
    """DJF is winter (December of its own year), MAM spring, JJA summer."""
    m = F.month(_c(date))
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "fall")


def cyclic(date: Col, period: float) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = 2 * F.pi() * F.dayofyear(_c(date)) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def log_sum(x: Col) -> Column:
    """log1p of a sum that may be missing or, by rounding, negative."""
    return F.log1p(F.greatest(F.coalesce(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0)))


def rounded(x: Col, large: bool = True) -> Column:
    """To six places, without a negative zero; ``large`` values to fewer
    (engines sum in other orders)."""
    x = _c(x).cast("double")
    if not large:
        return F.round(x, 6) + F.lit(0.0)
    size = F.abs(x)
    return F.when(size >= 1e8, F.round(x, -3)).when(size >= 1e6, F.round(x, 0)).otherwise(F.round(x, 6)) + F.lit(0.0)


def steady(x: Col) -> Column:
    """To twelve places: comparisons that sums in another order don't turn."""
    return F.round(_c(x), 12)
