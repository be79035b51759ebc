"""Analysis statistics, versions, locks, tasks and activity."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geo import relative_time
from ..functions.numbers import half_up, micros, ratio
from .filters import needs_analysis

DAY_US = 86_400 * 1_000_000
PRIORITIES = ("low", "medium", "high", "urgent")
STATUSES = ("pending", "in-progress", "completed", "cancelled")


def _now(now: datetime):
    return F.lit(now).cast("timestamp")


def analysis_stats(df: DataFrame, now: datetime, days: int = 7, captured="captured_at", analyzed="analyzed_at") -> DataFrame:
    """Totals, new and never analysed rows, last analysis, and a status message, in one pass."""
    fresh = needs_analysis(F.col(captured), F.col(analyzed), _now(now - timedelta(days=days)))
    stats = df.agg(F.count(F.lit(1)).alias("total"), F.count(analyzed).alias("analysed"),
                   F.count_if(fresh).alias("new"), F.count_if(F.col(analyzed).isNull()).alias("never"),
                   F.max(analyzed).alias("last_analysis"))
    last = F.coalesce(relative_time(F.col("last_analysis"), _now(now)), F.lit("unknown time"))
    text = (F.when(F.col("total") == 0, "No photos to analyze")
            .when(F.col("never") == F.col("total"), F.concat("total", F.lit(" photos have never been analyzed")))
            .when(F.col("new") == 0, F.concat(F.lit("All photos analyzed (last analysis: "), last, F.lit(")")))
            .otherwise(F.concat("new", F.lit(" new photos since last analysis"))))
    return stats.withColumn("message", text)


def decision_counts(df: DataFrame, key: str | None = None, decision="decision") -> DataFrame:
    """Burst, duplicate and similar counts; unique is the total minus duplicates and bursts."""
    d = F.col(decision)
    burst, dup = F.count_if(d == "burst_shot"), F.count_if(d == "duplicate")
    aggs = [F.count(F.lit(1)).alias("total"), burst.alias("burst"), dup.alias("duplicate"),
            F.count_if(d == "similar").alias("similar"), (F.count(F.lit(1)) - dup - burst).alias("unique")]
    return df.groupBy(key).agg(*aggs) if key else df.agg(*aggs)


def layer_metrics(df: DataFrame, layer="layer", n_in="n_in", n_out="n_out") -> DataFrame:
    """Share of rows each layer filtered, in whole percent."""
    part = F.when(F.col(n_in) > 0, half_up((F.lit(1.0) - F.col(n_out) / F.col(n_in)) * 100).cast("bigint"))
    return df.select(layer, n_in, n_out, F.coalesce(part, F.lit(0).cast("bigint")).alias("filtered_pct"))


def pair_savings(df: DataFrame, n="total", compared="compared") -> DataFrame:
    """All pairs of ``n`` rows against those compared."""
    pairs = (F.col(n).cast("double") * (F.col(n) - 1) / 2).cast("bigint")
    saved = F.when(pairs > 0, half_up((F.lit(1.0) - F.col(compared) / pairs) * 100).cast("bigint"))
    return df.withColumn("all_pairs", pairs).withColumn("saved_pct", F.coalesce(saved, F.lit(0).cast("bigint")))


def versions(log: DataFrame, key: str, order, keep: int = 10, rollback: str | None = None) -> DataFrame:
    """The newest ``keep`` versions per key of an ordered change log, numbered from 1.

    The number of a version follows from the count per key and its rank from the newest, so no task
    walks a whole log. ``rollback`` names a column with a target version: that change takes the content
    of the target instead (``source_version`` says which).
    """
    order = list(order)
    counts = log.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = log.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= keep).join(counts, key)
    out = last.withColumn("version", F.col("_n") - F.col("_r") + 1).drop("_n", "_r")
    if rollback:
        out = out.withColumn("source_version", F.coalesce(F.col(rollback).cast("bigint"), F.col("version")))
    return out


def rollback(history: DataFrame, targets: DataFrame, key: str, content, now: datetime) -> tuple[DataFrame, DataFrame]:
    """New version per key that copies the content of a target version in its history, and the requests
    whose version is not there. ``targets(key, target_version)``."""
    content = [content] if isinstance(content, str) else list(content)
    top = history.groupBy(key).agg(F.max("version").alias("_top"))
    old = history.select(key, F.col("version").alias("target_version"), *content)
    found = targets.join(old, [key, "target_version"]).join(top, key).select(
        key, (F.col("_top") + 1).alias("version"), *content,
        F.concat(F.lit("Rolled back to version "), F.col("target_version")).alias("reason"), _now(now).alias("updated_at"))
    missing = targets.join(old.select(key, "target_version"), [key, "target_version"], "left_anti")
    return found, missing


def lock_state(locks: DataFrame, key: str, now: datetime, order, until="locked_until") -> DataFrame:
    """The latest lock per key and whether it still holds."""
    last = locks.groupBy(key).agg(F.max_by(until, F.struct(*order)).alias(until))
    return last.withColumn("locked", F.coalesce(F.col(until) > _now(now), F.lit(False)))


def recent_per_key(df: DataFrame, key: str, order, k: int = 5) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= k)


def task_metrics(tasks: DataFrame, now: datetime) -> DataFrame:
    done = F.col("status") == "completed"
    recent = done & (F.col("updated_at") >= _now(now - timedelta(days=30)))
    days = (micros(F.col("updated_at")) - micros(F.col("created_at"))) / F.lit(float(DAY_US))
    late = (F.col("due_at") < _now(now)) & ~done
    n = F.count(F.lit(1))
    return tasks.agg(n.alias("total"), F.count_if(done).alias("completed"),
                     (ratio(F.count_if(done), n, 0.0) * 100).alias("completion_rate"),
                     F.coalesce(F.avg(F.when(recent, days)), F.lit(0.0)).alias("mean_completion_days"),
                     F.count_if(F.coalesce(late, F.lit(False))).alias("overdue"))


def task_counts(tasks: DataFrame) -> DataFrame:
    """Counts by priority and by status, zeros included: ``(dimension, value, n)``."""
    pairs = F.array(F.struct(F.lit("priority").alias("dimension"), F.col("priority").alias("value")),
                    F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")))
    found = tasks.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    domain = tasks.sparkSession.createDataFrame(
        [("priority", v) for v in PRIORITIES] + [("status", v) for v in STATUSES], "dimension string, value string")
    return (domain.join(found, ["dimension", "value"], "left")
            .select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n")))


def daily_trend(tasks: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Created and completed per day for the last ``days`` days, days without tasks included."""
    first, last = (now - timedelta(days=days - 1)).date(), now.date()
    made = F.struct(F.to_date("created_at").alias("day"), F.lit("created").alias("what"))
    done = F.when(F.col("status") == "completed", F.struct(F.to_date("updated_at").alias("day"), F.lit("completed").alias("what")))
    events = tasks.select(F.explode(F.array_compact(F.array(made, done))).alias("e")).select("e.*")
    counts = events.filter(F.col("day").between(F.lit(first), F.lit(last))).groupBy("day").agg(
        F.count_if(F.col("what") == "created").alias("created"), F.count_if(F.col("what") == "completed").alias("completed"))
    calendar = tasks.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return (calendar.join(counts, "day", "left")
            .select("day", F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("completed", F.lit(0)).alias("completed")))


def activity_feed(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """Newest created and completed events."""
    made = F.struct(F.lit("task_created").alias("type"), F.col("created_at").alias("at"),
                    F.concat(F.lit('created task "'), F.col("title"), F.lit('"')).alias("message"))
    done = F.when(F.col("status") == "completed", F.struct(
        F.lit("task_completed").alias("type"), F.col("updated_at").alias("at"),
        F.concat(F.lit('completed task "'), F.col("title"), F.lit('"')).alias("message")))
    events = tasks.select(F.col("id").alias("task_id"), F.explode(F.array_compact(F.array(made, done))).alias("e"))
    return events.select("task_id", "e.*").orderBy(F.desc("at"), "task_id", "type").limit(limit)


def due_notifications(tasks: DataFrame, now: datetime, limit: int = 15) -> DataFrame:
    """Tasks due today or tomorrow, or overdue by whole days; the most recently due first."""
    left = F.ceil((micros(F.col("due_at")) - micros(_now(now))) / F.lit(float(DAY_US)))
    open_ = tasks.filter(F.col("due_at").isNotNull() & (F.col("status") != "completed")).withColumn("days", left)
    soon = F.col("days").between(0, 1)
    when = F.when(F.col("days") == 0, "today").otherwise("tomorrow")
    text = F.when(soon, F.concat(F.lit('Task "'), F.col("title"), F.lit('" is due '), when)).otherwise(
        F.concat(F.lit('Task "'), F.col("title"), F.lit('" is '), F.abs("days"), F.lit(" days overdue")))
    kind = F.when(soon, "due_date_approaching").otherwise("task_overdue")
    return (open_.filter(F.col("days") <= 1)
            .select(F.col("id").alias("task_id"), kind.alias("type"), text.alias("message"), "days", "due_at")
            .orderBy(F.desc("due_at"), "task_id").limit(limit))


def sort_tasks(tasks: DataFrame, by: str, ascending: bool = True, id_col="id", limit: int | None = None) -> DataFrame:
    if by not in tasks.columns:
        raise ValueError(f"unknown sort column: {by}")
    out = tasks.orderBy(F.asc(by) if ascending else F.desc(by), id_col)
    return out if limit is None else out.limit(limit)


def newest_posts(posts: DataFrame, date="date", id_col="id", limit: int | None = None) -> DataFrame:
    """Newest first; a missing or unreadable date counts as 1970."""
    text = F.col(date)
    read = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("MMMM d, yyyy")), F.timestamp_seconds(F.lit(0)))
    out = posts.withColumn("sort_at", read).orderBy(F.desc("sort_at"), id_col)
    return out if limit is None else out.limit(limit)


def by_confidence(groups: DataFrame, confidence="confidence", id_col="group_id") -> DataFrame:
    return groups.orderBy(F.desc(confidence), id_col)


def first_rows(df: DataFrame, order, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
