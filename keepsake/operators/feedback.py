"""Feedback metrics, edit patterns, trends, recommendations and retention."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import ratio
from ..functions.text import contains_all_boundaries, edit_patterns, labels, prohibited_terms

GRAINS = ("hour", "day", "week", "month")
# Fixed values.
TTL_DAYS = {"hour": 7, "day": 30, "week": 90, "month": 365}
MIN_INTERACTIONS = 50
SUCCESS_MIN = 0.7
EDIT_MAX = 0.3
METRICS = ("positive", "negative", "edits", "total")


def period_start(ts: Column, grain: str) -> Column:
    """Start of the hour, day, Sunday-based week or month."""
    if grain in ("hour", "day", "month"):
        return F.date_trunc(grain, ts)
    if grain == "week":
        day = F.to_date(ts)
        return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp")
    raise ValueError(f"unknown grain: {grain}")


def period_end(start: Column, grain: str) -> Column:
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY",
            "month": "INTERVAL 1 MONTH"}[grain]
    return start + F.expr(step)


def metric_counts(kind: str = "feedback") -> list[Column]:
    k = F.col(kind)
    return [F.count_if(k == "positive").alias("positive"), F.count_if(k == "negative").alias("negative"),
            F.count_if(k == "edit").alias("edits"), F.count(F.lit(1)).alias("total")]


def _sums() -> list[Column]:
    return [F.sum(m).alias(m) for m in METRICS]


def feedback_metrics(events: DataFrame, keys=("prompt_id",), grain: str = "hour", ts: str = "ts",
                     kind: str = "feedback") -> DataFrame:
    """Counts per key and half-open period."""
    return (events.withColumn("period_start", period_start(F.col(ts), grain))
            .groupBy(*keys, "period_start").agg(*metric_counts(kind)))


def prompt_scopes(user_type: Column, user_id: Column) -> Column:
    """The prompts an event counts for: its user's own and the global one of its user type."""
    own = F.concat_ws(":", F.lit("prompt"), user_type, user_id.cast("string"))
    return F.array_compact(F.array(F.when(user_id.isNotNull(), own),
                                   F.concat_ws(":", F.lit("prompt"), user_type, F.lit("global"))))


def aggregate_prompts(events: DataFrame, grains=GRAINS, ts: str = "ts", kind: str = "feedback") -> DataFrame:
    """All prompts and grains in one job: ``(prompt_id, grain, period_start, counts)``.

    Events shrink to counts per user and hour first; scopes and grains multiply only those.
    """
    hourly = (events.withColumn("hour", F.date_trunc("hour", F.col(ts)))
              .groupBy("user_type", "user_id", "hour").agg(*metric_counts(kind)))
    periods = F.array(*[F.struct(F.lit(g).alias("grain"), period_start(F.col("hour"), g).alias("period_start"))
                        for g in grains])
    spread = (hourly.withColumn("p", F.explode(periods))
              .withColumn("prompt_id", F.explode(prompt_scopes(F.col("user_type"), F.col("user_id")))))
    return spread.groupBy("prompt_id", "p.grain", "p.period_start").agg(*_sums())


def mine_edit_patterns(edits: DataFrame, keys=(), order=("ts",), original="original", edited="edited",
                       top: int = 10, examples: int = 3) -> DataFrame:
    """Frequency of each edit pattern per key with its last examples; the ``top`` most frequent, the
    first seen of equals first."""
    keys, order = list(keys), list(order)
    usable = edits.filter((F.length(original) > 0) & (F.length(edited) > 0))
    found = usable.withColumn("pattern", F.explode(edit_patterns(F.col(original), F.col(edited))))
    by = keys + ["pattern"]
    counts = found.groupBy(*by).agg(F.count(F.lit(1)).alias("frequency"), F.min(F.struct(*order)).alias("seen"))
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    last = (found.select(*by, *order, F.col(edited).alias("example"))
            .withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= examples)
            .groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "example"))),
                                          lambda x: x["example"]).alias("examples")))
    best = Window.partitionBy(*keys).orderBy(F.desc("frequency"), "seen", "pattern")
    return (counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .join(last, by).drop("seen"))


def newest_periods(aggregates: DataFrame, n: int, key: str = "prompt_id", start: str = "period_start") -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(start))
    return aggregates.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumn("success_rate", ratio(F.col("positive"), F.col("positive") + F.col("negative"), 0.5)) \
             .withColumn("edit_rate", ratio(F.col("edits"), F.col("total"), 0.0))


def prompt_performance(hourly: DataFrame, n: int = 24, key: str = "prompt_id") -> DataFrame:
    """Success and edit rate over the newest ``n`` periods of each prompt."""
    return _rates(newest_periods(hourly, n, key).groupBy(key).agg(*_sums()))


def recommendation(success: Column, edits: Column, total: Column) -> Column:
    """``review`` comes after a condition that it implies, so it is never given; the order is kept."""
    return (F.when(total < MIN_INTERACTIONS, F.lit("maintain"))
            .when((success < SUCCESS_MIN) | (edits > EDIT_MAX), F.lit("evolve"))
            .when((success < 0.5) | (edits > 0.5), F.lit("review"))
            .otherwise(F.lit("maintain")))


def is_open_prompt(prompt_id: Column) -> Column:
    """Not a stored proposal or version of a prompt."""
    return ~prompt_id.contains(":proposed:") & ~prompt_id.contains(":v")


def weekly_summary(daily: DataFrame, patterns: DataFrame | None = None, locked: DataFrame | None = None,
                   n: int = 7, top: int = 5, key: str = "prompt_id") -> DataFrame:
    """Newest ``n`` daily rows per prompt with rates, advice and the most frequent edit patterns.

    ``patterns(prompt_id, period_start, pattern, frequency)``; prompts in ``locked`` are skipped.
    """
    days = newest_periods(daily.filter(is_open_prompt(F.col(key))), n, key)
    if locked is not None:
        days = days.join(locked.select(key), key, "left_anti")
    out = _rates(days.groupBy(key).agg(*_sums())).withColumn(
        "recommendation", recommendation(F.col("success_rate"), F.col("edit_rate"), F.col("total")))
    if patterns is None:
        return out
    merged = (patterns.join(days.select(key, "period_start"), [key, "period_start"], "left_semi")
              .groupBy(key, "pattern").agg(F.sum("frequency").alias("frequency")))
    best = Window.partitionBy(key).orderBy(F.desc("frequency"), "pattern")
    short = (merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top)
             .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "pattern", "frequency"))).alias("top_patterns")))
    return out.join(short, key, "left")


def preference_profiles(feedback: DataFrame, user="user_id", order=("ts",), kind="feedback",
                        original="original", edited="edited") -> DataFrame:
    """Per user: positive share, and style and detail level from the last edit that says so."""
    found = F.when((F.col(kind) == "edit") & (F.length(original) > 0) & (F.length(edited) > 0),
                   edit_patterns(F.col(original), F.col(edited)))
    has = lambda p: F.array_contains(F.col("_p"), p)
    # within one edit the later rule overrides the earlier
    style = F.when(has("made more formal"), "technical").when(has("removed technical jargon"), "conversational")
    detail = F.when(has("expanded response"), "detailed").when(has("shortened response"), "concise")
    at = F.struct(*order)
    rows = feedback.withColumn("_p", found).withColumn("_s", style).withColumn("_d", detail)
    pos, neg = F.count_if(F.col(kind) == "positive"), F.count_if(F.col(kind) == "negative")
    return rows.groupBy(user).agg(
        F.coalesce(F.max_by("_s", F.when(F.col("_s").isNotNull(), at)), F.lit("balanced")).alias("response_style"),
        F.coalesce(F.max_by("_d", F.when(F.col("_d").isNotNull(), at)), F.lit("concise")).alias("detail_level"),
        F.count(F.lit(1)).alias("total_feedback"), ratio(pos, pos + neg, 0.5).alias("positive_ratio"))


def trends(series: DataFrame, values: dict[str, Column], key: str = "prompt_id", order: str = "period_start",
           margin: float = 0.1) -> DataFrame:
    """Direction of each value per key: mean of the newer half against the older half.

    Fewer than two points, or an undefined value in either half, is ``stable``. Series are aggregates
    per period, so a key has as many rows as periods, not events.
    """
    w = Window.partitionBy(key)
    rows = series.select(key, *[v.cast("double").alias(n) for n, v in values.items()],
                         F.row_number().over(w.orderBy(order)).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    older = F.col("_i") <= F.floor(F.col("_n") / 2)
    aggs = []
    for name in values:
        v = F.col(name)
        old, new = F.avg(F.when(older, v)), F.avg(F.when(~older, v))
        undefined = F.count_if(v.isNull() | F.isnan(v)) > 0
        aggs.append(F.when((F.max("_n") < 2) | undefined, "stable")
                    .when(new > old * (1 + margin), "improving")
                    .when(new < old * (1 - margin), "declining").otherwise("stable").alias(f"{name}_trend"))
    return rows.groupBy(key).agg(*aggs)


def performance_report(hourly: DataFrame, hours: int = 24, key: str = "prompt_id") -> DataFrame:
    """Current rates, three trends and advice per prompt, over the newest ``hours`` hourly rows."""
    recent = newest_periods(hourly, hours, key)
    current = _rates(recent.groupBy(key).agg(*_sums()))
    directions = trends(recent, {
        "success": ratio(F.col("positive"), F.col("positive") + F.col("negative")),
        "edit": ratio(F.col("edits"), F.col("total")), "volume": F.col("total")}, key)
    advice = labels((F.col("success_rate") < 0.6, "Consider reviewing negative feedback patterns"),
                    (F.col("edit_rate") > 0.3, "High edit rate detected - analyze common edit patterns"),
                    (F.col("success_trend") == "declining", "Success rate declining - consider prompt adjustment"))
    return current.join(directions, key).withColumn("recommendations", advice)


def keep_recent(df: DataFrame, now: datetime, days: int = 30, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(now - timedelta(days=days)).cast("timestamp"))


def expire_aggregates(df: DataFrame, now: datetime, grain: str = "grain", start: str = "period_start") -> DataFrame:
    """Aggregates that are still within the time to live of their grain."""
    cut = F.lit(None).cast("timestamp")
    for g, days in TTL_DAYS.items():
        cut = F.when(F.col(grain) == g, F.lit(now - timedelta(days=days)).cast("timestamp")).otherwise(cut)
    return df.filter(F.col(start) >= cut)


def deleted_count(df: DataFrame, now: datetime, days: int = 30, ts: str = "ts") -> DataFrame:
    old = F.col(ts) < F.lit(now - timedelta(days=days)).cast("timestamp")
    return df.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def acceptance_log(feedback: DataFrame, user="user_id", item="item_id", order=("ts",), kind="feedback") -> DataFrame:
    """Last verdict per user and item, in long form."""
    return feedback.groupBy(user, item).agg(F.max_by(kind, F.struct(*order)).alias("verdict"))


def acceptance_counts(log: DataFrame, user="user_id") -> DataFrame:
    return log.groupBy(user).agg(F.count_if(F.col("verdict") == "positive").alias("accepted"),
                                 F.count_if(F.col("verdict") == "negative").alias("rejected"))


def check_proposals(df: DataFrame, now: datetime, text="proposed", boundaries="boundaries", version="version",
                    regression="regression_ok", days: int = 30) -> DataFrame:
    """Validity of proposed prompt texts: boundaries kept, no prohibited term, regression result given."""
    bound = contains_all_boundaries(F.col(text), F.col(boundaries))
    safe = F.size(prohibited_terms(F.col(text))) == 0
    regression_ok = F.coalesce(F.col(regression), F.lit(False))
    return (df.withColumn("boundary_check", bound).withColumn("safety_check", safe)
            .withColumn("passed", F.col("boundary_check") & F.col("safety_check") & regression_ok)
            .withColumn("details", labels((~F.col("boundary_check"), "Missing required boundaries"),
                                          (~regression_ok, "Failed regression tests"),
                                          (~F.col("safety_check"), "Failed safety check")))
            .withColumn("new_version", F.col(version) + 1)
            .withColumn("expires_at", F.lit(now + timedelta(days=days)).cast("timestamp")))
