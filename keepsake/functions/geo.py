"""Time and place proximity."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import let, micros

EARTH_RADIUS_KM = 6371.0

# Score below each limit.
TIME_TIERS_MINUTES = [(1, 0.98), (5, 0.95), (15, 0.85), (60, 0.6), (240, 0.3), (1440, 0.1)]
TIME_BEYOND = 0.05
SPACE_TIERS_KM = [(0.01, 0.98), (0.05, 0.92), (0.1, 0.6), (0.5, 0.4), (1.0, 0.2)]


def _tiers(value: Column, exact: Column, tiers, beyond: float) -> Column:
    out = F.when(exact, F.lit(1.0))
    for limit, score in tiers:
        out = out.when(value < F.lit(float(limit)), F.lit(score))
    return out.otherwise(F.lit(beyond))


def minutes_apart(t1: Column, t2: Column) -> Column:
    return F.abs(micros(t1) - micros(t2)) / F.lit(6e7)


def temporal_proximity(t1: Column, t2: Column) -> Column:
    gap = minutes_apart(t1, t2)
    return F.when(gap.isNull(), F.lit(0.0)).otherwise(
        _tiers(gap, gap == 0, TIME_TIERS_MINUTES, TIME_BEYOND))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = F.pow(half_lat, F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half_lon, F.lit(2.0))
    # asin(sqrt(h)) is atan2(sqrt(h), sqrt(1 - h)) with h used once
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def spatial_proximity(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    same = (lat1 == lat2) & (lon1 == lon2)
    missing = lat1.isNull() | lon1.isNull() | lat2.isNull() | lon2.isNull()
    km = F.when(same, F.lit(-1.0)).otherwise(haversine_km(lat1, lon1, lat2, lon2))
    return F.when(missing, F.lit(0.0)).otherwise(let(km, lambda d: _tiers(d, d < 0, SPACE_TIERS_KM, 0.0)))


def relative_time(ts: Column, now: Column) -> Column:
    """How long before ``now``, in words; the date itself after a week."""
    minutes = F.floor((micros(now) - micros(ts)) / F.lit(6e7))
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (F.when(minutes <= 1, F.lit("just now"))
            .when(minutes < 60, F.concat(minutes, F.lit(" minutes ago")))
            .when(hours == 1, F.lit("1 hour ago"))
            .when(hours < 24, F.concat(hours, F.lit(" hours ago")))
            .when(days == 1, F.lit("1 day ago"))
            .when(days < 7, F.concat(days, F.lit(" days ago")))
            .otherwise(F.date_format(ts, "yyyy-MM-dd")))
