from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half up, also for negative ties, as ``floor(x * 10^d + 0.5) / 10^d``."""
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """``num / den`` with ``empty`` where the denominator is zero."""
    value = F.try_divide(num.cast("double"), den.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
