"""Vectors are array columns; arithmetic is done in double."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import ratio

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, variant: str = "guarded", strict: bool = True) -> Column:
    """Cosine similarity.

    ``guarded``: zero vectors score 0. ``epsilon``: 1e-8 is added to each squared norm and the result
    is held in [-1, 1]. ``plain``: no guard, NaN for a zero vector. Vectors of unequal length are an
    error when ``strict``, else null.
    """
    d, na, nb = dot(a, b), dot(a, a), dot(b, b)
    if variant == "guarded":
        value = F.when(a.isNotNull() & b.isNotNull(),
                       F.coalesce(F.try_divide(d, F.sqrt(na) * F.sqrt(nb)), F.lit(0.0)))
    elif variant == "epsilon":
        raw = d / (F.sqrt(na + F.lit(EPSILON)) * F.sqrt(nb + F.lit(EPSILON)))
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    elif variant == "plain":
        value = F.coalesce(F.try_divide(d, F.sqrt(na) * F.sqrt(nb)), F.lit(float("nan")))
    else:
        raise ValueError(f"unknown cosine variant: {variant}")
    fail = F.raise_error(F.lit("vectors must have the same length")).cast("double")
    return F.when(F.size(a) == F.size(b), value).otherwise(fail if strict else F.lit(None))


def l2_normalise(v: Column) -> Column:
    n = norm(v)
    scaled = F.transform(v, lambda x: x.cast("double") / n)
    return F.when(n == 0, v.cast("array<double>")).otherwise(scaled)


def vector_stats(v: Column) -> Column:
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    mean = ratio(total, n)
    spread = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(x.cast("double") - mean, F.lit(2.0)))
    return F.struct(mean.alias("mean"), ratio(spread, n).alias("variance"),
                    F.array_min(v).cast("double").alias("min"),
                    F.array_max(v).cast("double").alias("max"), norm(v).alias("norm"))


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor(r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114) + F.lit(0.5))


def rgb_histogram(r: Column, g: Column, b: Column, bins: int = 16) -> Column:
    """Per-channel histogram of 0-255 values, each channel summing to one."""
    width = 256 / bins

    def channel(values: Column) -> Column:
        slots = F.transform(values, lambda x: F.floor(x / F.lit(width)))
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                           lambda k: ratio(F.size(F.filter(slots, lambda s: s == k)), F.size(values)))

    return F.concat(channel(r), channel(g), channel(b))


def chi_squared(h1: Column, h2: Column) -> Column:
    terms = F.zip_with(h1, h2, lambda x, y: F.when(
        x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2


def combined_similarity(visual: tuple, colour: tuple, edge: tuple,
                        weights=(0.3, 0.4, 0.3)) -> Column:
    """Weighted mean over the feature pairs that both sides have; 0 when there are none."""
    parts = [cosine(*visual, variant="plain"), F.lit(1.0) - chi_squared(*colour),
             cosine(*edge, variant="plain")]
    total, weight = F.lit(0.0), F.lit(0.0)
    for (left, right), score, w in zip((visual, colour, edge), parts, weights):
        here = left.isNotNull() & right.isNotNull()
        total = total + F.when(here, score * F.lit(w)).otherwise(F.lit(0.0))
        weight = weight + F.when(here, F.lit(w)).otherwise(F.lit(0.0))
    return ratio(total, weight, empty=0.0)
