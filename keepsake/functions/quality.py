"""Quality, size and decision columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .numbers import half_up

BASE_QUALITY = 0.6
KEEP_SHARE = {"exact_duplicates": None, "retry_shots": 0.3, "angle_variations": 0.4,
              "incremental_progress": 0.6, "redundant_documentation": 0.5}
TECHNICAL_TERMS = ["function", "api", "endpoint", "component", "hook", "implementation",
                   ".ts", ".tsx", "code", "file"]


def _flag(cond: Column, weight: float) -> Column:
    return F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))


def information_content(description: Column, tags: Column) -> Column:
    # an empty description still counts as one word
    words = F.size(F.split(F.coalesce(description, F.lit("")), " "))
    n_tags = F.coalesce(F.size(tags), F.lit(0))
    return F.least(F.lit(1.0), (words * F.lit(0.05) + n_tags * F.lit(0.1)) / 2 + F.lit(0.3))


def documentation_value(information: Column, description: Column, tags: Column,
                        has_coordinates: Column) -> Column:
    score = (information * F.lit(0.7) + _flag(has_coordinates, 0.1)
             + _flag(F.coalesce(F.length(description), F.lit(0)) > 10, 0.1)
             + _flag(F.coalesce(F.size(tags), F.lit(0)) > 0, 0.1))
    return F.least(F.lit(1.0), score)


def quality(description: Column, tags: Column, has_coordinates: Column,
            sharpness: Column | None = None, lighting: Column | None = None,
            composition: Column | None = None) -> Column:
    base = F.lit(BASE_QUALITY)
    info = information_content(description, tags)
    return F.struct((sharpness if sharpness is not None else base).alias("sharpness"),
                    (lighting if lighting is not None else base).alias("lighting"),
                    (composition if composition is not None else base).alias("composition"),
                    info.alias("information"),
                    documentation_value(info, description, tags, has_coordinates).alias("documentation"))


def fallback_quality(hash_: Column, has_coordinates: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(BASE_QUALITY)
                   + _flag(F.coalesce(F.length(hash_), F.lit(0)) > 20, 0.05)
                   + _flag(F.coalesce(has_coordinates, F.lit(False)), 0.05))


def estimated_mb(width: Column, height: Column) -> Column:
    """Ten-to-one compressed RGB size; missing or zero sides count as 1920 by 1080."""
    w = F.coalesce(F.nullif(width, F.lit(0)), F.lit(1920)).cast("double")
    h = F.coalesce(F.nullif(height, F.lit(0)), F.lit(1080)).cast("double")
    return half_up(w * h * 3 / 10 / F.lit(float(1 << 20)), 2)


def time_saved_minutes(total: Column, kept: Column) -> Column:
    saved = half_up((total - kept) * F.lit(0.5), 1)
    return F.when((kept >= total) | (total == 0), F.lit(0.0)).otherwise(saved)


def group_type(temporal: Column, spatial: Column, content: Column, visual: Column) -> Column:
    return (F.when((temporal > 0.98) & (visual > 0.8) & (content > 0.8), F.lit("retry_shots"))
            .when((temporal > 0.8) & (spatial > 0.8), F.lit("retry_shots"))
            .when((spatial > 0.7) & (temporal > 0.5), F.lit("angle_variations"))
            .when((content > 0.8) & (temporal > 0.3), F.lit("incremental_progress"))
            .otherwise(F.lit("redundant_documentation")))


def confidence_level(score: Column, high: float = 0.85, medium: float = 0.7) -> Column:
    return (F.when(score > high, F.lit("high")).when(score > medium, F.lit("medium"))
            .otherwise(F.lit("low")))


def keep_count(type_: Column, n: Column) -> Column:
    """How many of ``n`` to keep, by group type."""
    def share(x, least):
        return F.greatest(F.lit(least), F.ceil(n * F.lit(x)))
    out = F.when(type_ == "exact_duplicates", F.lit(1).cast("bigint"))
    for name, x in KEEP_SHARE.items():
        if x is not None:
            out = out.when(type_ == name, share(x, 2 if name == "incremental_progress" else 1))
    return out.otherwise(share(0.4, 1)).cast("bigint")


def audience(is_local: Column, dev_tools: Column, path: Column, queries: Column) -> Column:
    """``struct(user_type, confidence)`` from weighted signals."""
    technical = F.exists(queries, lambda q: reduce(
        lambda x, y: x | y, [F.lower(q).contains(t) for t in TECHNICAL_TERMS]))
    score = (_flag(is_local, 0.4) + _flag(dev_tools, 0.2) + _flag(path.contains("/test"), 0.3)
             + _flag(path.contains("api") | path.contains("debug"), 0.2)
             + _flag(F.coalesce(technical, F.lit(False)), 0.2))
    dev = score >= 0.6
    return F.struct(F.when(dev, F.lit("developer")).otherwise(F.lit("endUser")).alias("user_type"),
                    F.when(dev, F.least(score, F.lit(1.0))).otherwise(F.lit(1.0) - score)
                    .alias("confidence"))
