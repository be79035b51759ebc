"""Streams over the event and document tables, run to the end of the available input."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from keepsake import streaming as S
from keepsake.session import fresh_path
from keepsake.sources.snapshots import KeyedTable, Snapshots

from .feedback import SUMS, SUNDAY
from .registry import query

us = F.unix_micros
WATERMARK = "(SELECT epoch_ms(CAST(max(epoch_ms(ts)) AS BIGINT)) FROM events)"


SLICES, FILES = 3, 2
FILE_ROWS = 250_000
START = 1_704_067_200_000_000  # 2024-01-01
SLOW = f"SELECT *, make_timestamp({START} + (epoch_us(ts) - {START}) * 12) AS moment FROM v_feedback"
SLOW_MARK = f"(SELECT make_timestamp(epoch_ms(max(moment)) * 1000) - INTERVAL 1 HOUR FROM slow)"
SLICE_SQL = f"""(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {SLICES} // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) + 1)"""


def _stream(t, table: str):
    # a pattern stands for a table that is one file as well as for one that is a folder of files
    schema = t.spark.read.parquet(f"{t.dir}/{table}.parquet").schema
    return S.read_stream(t.spark, f"{t.dir}/{table}.parque[t]", schema)


def _events(t, delayed=None, slices=SLICES, slower=1):
    """The events as they would arrive: slices of time one after the other, each a batch; rows that
    ``delayed`` names leave the first slice and arrive after the last. ``slower`` stretches the time from
    the start of 2024, a month to so many months."""
    rows = t.table("events")
    if slower > 1:
        rows = rows.withColumn("ts", F.timestamp_micros(F.lit(START) + (us(F.col("ts").cast("timestamp")) - START) * slower))
    low, high, n = rows.agg(F.min(us("ts")), F.max(us("ts")), F.count(F.lit(1))).first()
    at = F.floor((us("ts") - low) * slices / (high - low + 1)) if low is not None else F.lit(0)
    if delayed is not None:
        at = F.when((at == 0) & delayed, slices).otherwise(at)
    path = fresh_path(t.spark, "arrivals")
    files = max(FILES, n // FILE_ROWS)  # of a slice, so that a batch has work for all tasks
    for k in range(slices + (delayed is not None)):
        part = rows.filter(at == k)
        (part.coalesce(FILES) if files == FILES else part.repartition(files)).write.parquet(f"{path}/{k}")
    kind = F.col("event_type")
    return S.read_stream(t.spark, f"{path}/*", rows.schema, files_per_batch=files).select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % 20).alias("project_id"),
        F.concat(F.lit("i"), F.col("event_id") % 500).alias("item_id"), F.when(F.col("user_id") % 2 == 0, "developer").otherwise("endUser").alias("user_type"),
        F.when(kind.isin("click", "purchase"), "positive").when(kind == "error", "negative").when(kind == "view", "edit").otherwise("other").alias("feedback"))


def _run(t, stream, name):
    """What the stream has written when it has read all its input; its errors are raised."""
    path = fresh_path(t.spark, name)
    S.write_stream(stream, path, fresh_path(t.spark, f"{name}-checkpoint")).awaitTermination()
    return t.spark.read.parquet(path)


def _closed(start: str, days: float) -> str:
    return f"SELECT user_type, epoch_us({start}) AS start, {SUMS} FROM v_feedback GROUP BY 1, 2 HAVING any_value({start}) + INTERVAL {int(days * 24)} HOUR <= {WATERMARK} - INTERVAL 1 HOUR"


@query("s1_feedback_hours", _closed("date_trunc('hour', ts)", 1 / 24))
def _(t):
    out = _run(t, S.feedback_windows(_events(t), "hour"), "s1-hour")
    return out.select("user_type", us("period_start").alias("start"), "positive", "negative", "edits", "total")


@query("s1_feedback_days", _closed("date_trunc('day', ts)", 1))
def _(t):
    out = _run(t, S.feedback_windows(_events(t), "day"), "s1-day")
    return out.select("user_type", us("period_start").alias("start"), "positive", "negative", "edits", "total")


@query("s1_feedback_weeks", _closed(SUNDAY, 7))
def _(t):
    out = _run(t, S.feedback_windows(_events(t), "week"), "s1-week")
    return out.select("user_type", us("period_start").alias("start"), "positive", "negative", "edits", "total")


@query("s2_feedback_months", f"SELECT user_type, epoch_us(date_trunc('month', ts)) AS start, {SUMS} FROM v_feedback GROUP BY 1, 2")
def _(t):
    store = KeyedTable(t.spark, fresh_path(t.spark, "s2"), ["user_type", "period_start"])
    S.upsert_stream(S.month_counts(_events(t)), store, "total", fresh_path(t.spark, "s2-checkpoint"), "update").awaitTermination()
    return store.current().select("user_type", us("period_start").alias("start"), "positive", "negative", "edits", "total")


@query("s2_month_rollup", f"""SELECT user_type, epoch_us(date_trunc('month', ts)) AS start, {SUMS} FROM v_feedback
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {WATERMARK} - INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(t):
    days = _run(t, S.feedback_windows(_events(t), "day"), "s2-day")
    return S.month_rollup(days).select("user_type", us("period_start").alias("start"), "positive", "negative", "edits", "total")


@query("s3_burst_sessions", f"""WITH a AS (SELECT *, epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY project_id ORDER BY captured_at) AS gap FROM v_photo),
    b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY captured_at, id) AS g FROM a)
    SELECT project_id, epoch_us(min(captured_at)) AS first, epoch_us(max(captured_at)) AS last, count(*) AS size FROM b GROUP BY project_id, g
    HAVING count(*) > 1 AND max(captured_at) + INTERVAL 10 MINUTE <= {WATERMARK} - INTERVAL 1 MINUTE""")
def _(t):
    photos = _events(t).withColumnRenamed("ts", "captured_at")
    out = _run(t, S.burst_sessions(photos, "10 minutes"), "s3")
    return out.select("project_id", us("first").alias("first"), us("last").alias("last"), "size")


@query("s4_interaction_sessions", f"""WITH a AS (SELECT user_id AS session_id, ts, id, feedback, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM v_feedback),
    b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM a)
    SELECT session_id, count(*) AS interactions, arg_max(feedback, ts) AS last_context, epoch_us(max(ts)) AS last FROM b GROUP BY session_id, g HAVING max(ts) + INTERVAL 1 DAY <= {WATERMARK} - INTERVAL 1 HOUR""")
def _(t):
    s = _events(t).withColumnRenamed("user_id", "session_id")
    out = _run(t, S.interaction_sessions(s, context="feedback", idle="1 day"), "s4")
    return out.select("session_id", "interactions", "last_context", us("last_updated").alias("last"))


@query("s2_closed_months", f"""WITH slow AS MATERIALIZED ({SLOW}) SELECT user_type, epoch_us(date_trunc('month', moment)) AS start, {SUMS} FROM slow GROUP BY 1, 2
    HAVING any_value(date_trunc('month', moment)) + INTERVAL 1 MONTH <= {SLOW_MARK}""")
def _(t):
    out = _run(t, S.closed_months(_events(t, slices=4, slower=12)), "s2-closed")
    return out.select("user_type", us("period_start").alias("start"), "positive", "negative", "edits", "total")


@query("s4_interaction_log", f"""WITH slow AS MATERIALIZED ({SLOW}),
    a AS (SELECT user_id AS session_id, moment, id, feedback, epoch_us(moment) - lag(epoch_us(moment)) OVER (PARTITION BY user_id ORDER BY moment) AS gap FROM slow),
    b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 604800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY moment, id) AS g FROM a)
    SELECT session_id, count(*) AS interactions, arg_max(feedback, (moment, id)) AS last_context, epoch_us(max(moment)) AS last FROM b GROUP BY session_id, g
    HAVING max(moment) + INTERVAL 7 DAY <= {SLOW_MARK}""")
def _(t):
    s = _events(t, slices=4, slower=12).withColumnRenamed("user_id", "session_id")
    out = _run(t, S.interaction_log(s, context="feedback"), "s4-log")
    return out.select("session_id", "interactions", "last_context", us("last_updated").alias("last"))


@query("s5_feedback_upsert", "SELECT user_id, item_id, arg_max(feedback, (ts, id)) AS feedback FROM v_feedback GROUP BY 1, 2")
def _(t):
    store = KeyedTable(t.spark, fresh_path(t.spark, "s5"), ["user_id", "item_id"])
    s = _events(t).select("user_id", "item_id", "feedback", "ts", "id")
    S.upsert_stream(s, store, ["ts", "id"], fresh_path(t.spark, "s5-checkpoint")).awaitTermination()
    return store.current().select("user_id", "item_id", "feedback")


@query("s6_first_arrivals", "SELECT content_hash, count(*) AS n FROM (SELECT DISTINCT content_hash FROM v_doc) GROUP BY 1")
def _(t):
    # all documents arrive at one time, so each content passes once; which copy is free
    s = _stream(t, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("captured_at"))
    return _run(t, S.first_arrivals(s), "s6").groupBy(F.col("hash").alias("content_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("s7_late_rows", f"SELECT event_id AS id, CASE WHEN event_id % 50 = 0 AND {SLICE_SQL} = 0 THEN 'late' ELSE 'on time' END AS route FROM events")
def _(t):
    # every fiftieth row of the first slice arrives after the last one, when it is long past the watermark
    base = fresh_path(t.spark, "s7")
    S.route_late(_events(t, F.col("event_id") % 50 == 0), f"{base}/on_time", f"{base}/late", Snapshots(t.spark, f"{base}/marks"), timedelta(hours=1), f"{base}/checkpoint").awaitTermination()
    both = t.spark.read.parquet(f"{base}/on_time").select("id", F.lit("on time").alias("route"))
    return both.unionByName(t.spark.read.parquet(f"{base}/late").select("id", F.lit("late").alias("route")))
