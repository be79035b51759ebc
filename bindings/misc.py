"""Versions, locks, tasks and change logs."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from keepsake.operators import activity, changes

from .registry import ORDERS_NOW, joined, q4, query, r4
from .scalars import FILES

us = F.unix_micros
NOW = "TIMESTAMP '2001-08-02'"


@query("w6_versions", """SELECT assignee, id, n - r + 1 AS version FROM (SELECT assignee, id, row_number() OVER (PARTITION BY assignee ORDER BY created_at DESC, id DESC) AS r, count(*) OVER (PARTITION BY assignee) AS n FROM v_task) WHERE r <= 10""")
def _(t):
    return activity.versions(t.task, "assignee", ["created_at", "id"]).select("assignee", "id", "version")


@query("w6_rollback", """WITH v AS (SELECT assignee, title, n, n - r + 1 AS version FROM (SELECT *, row_number() OVER (PARTITION BY assignee ORDER BY created_at DESC, id DESC) AS r, count(*) OVER (PARTITION BY assignee) AS n FROM v_task) WHERE r <= 10)
    SELECT assignee, n + 1 AS version, title, 'Rolled back to version 2' AS reason FROM v WHERE version = 2""")
def _(t):
    history = activity.versions(t.task, "assignee", ["created_at", "id"])
    targets = t.task.select("assignee", F.lit(2).cast("bigint").alias("target_version")).distinct()
    return activity.rollback(history, targets, "assignee", "title", ORDERS_NOW)[0].select("assignee", "version", "title", "reason")


@query("w7_lock_state", f"SELECT assignee, arg_max(due_at, (created_at, id)) > {NOW} AS locked FROM v_task GROUP BY 1")
def _(t):
    return activity.lock_state(t.task, "assignee", ORDERS_NOW, ["created_at", "id"], "due_at").select("assignee", "locked")


@query("w8_recent_per_user", "SELECT creator_id, id, r AS recency FROM (SELECT creator_id, id, row_number() OVER (PARTITION BY creator_id ORDER BY captured_at DESC, id DESC) AS r FROM v_photo) WHERE r <= 5")
def _(t):
    return activity.recent_per_key(t.photo, "creator_id", ["captured_at", "id"]).select("creator_id", "id", F.col("recency").cast("bigint").alias("recency"))


@query("w10_activity_feed", """SELECT * FROM (SELECT id AS task_id, 'task_created' AS type, epoch_us(created_at) AS "at", 'created task "' || title || '"' AS message FROM v_task
    UNION ALL SELECT id, 'task_completed', epoch_us(updated_at), 'completed task "' || title || '"' FROM v_task WHERE status = 'completed') ORDER BY "at" DESC, task_id, type LIMIT 20""")
def _(t):
    return activity.activity_feed(t.task).withColumn("at", us("at"))


@query("w10_due_notifications", f"""SELECT id AS task_id, CASE WHEN d >= 0 THEN 'due_date_approaching' ELSE 'task_overdue' END AS type,
    'Task "' || title || '" is ' || CASE WHEN d = 0 THEN 'due today' WHEN d = 1 THEN 'due tomorrow' ELSE abs(d) || ' days overdue' END AS message, d AS days
    FROM (SELECT *, CAST(ceil((epoch_us(due_at) - epoch_us({NOW})) / 86400000000.0) AS BIGINT) AS d FROM v_task WHERE status <> 'completed') WHERE d <= 1 ORDER BY due_at DESC, id LIMIT 15""")
def _(t):
    return activity.due_notifications(t.task, ORDERS_NOW).select("task_id", "type", "message", "days")


@query("a17_task_metrics", f"""SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, {q4("count(*) FILTER (status = 'completed') / CAST(count(*) AS DOUBLE) * 100")} AS completion_rate,
    {q4(f"coalesce(avg((epoch_us(updated_at) - epoch_us(created_at)) / 86400000000.0) FILTER (status = 'completed' AND updated_at >= {NOW} - INTERVAL 30 DAY), 0)")} AS mean_completion_days,
    count(*) FILTER (due_at < {NOW} AND status <> 'completed') AS overdue FROM v_task""")
def _(t):
    return activity.task_metrics(t.task, ORDERS_NOW).withColumns({c: r4(F.col(c)) for c in ("completion_rate", "mean_completion_days")})


@query("a17_task_counts", """SELECT d.dimension, d.value, coalesce(c.n, 0) AS n FROM (SELECT 'priority' AS dimension, unnest(['low', 'medium', 'high', 'urgent']) AS value
    UNION ALL SELECT 'status', unnest(['pending', 'in-progress', 'completed', 'cancelled'])) d
    LEFT JOIN (SELECT 'priority' AS dimension, priority AS value, count(*) AS n FROM v_task GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM v_task GROUP BY 2) c USING (dimension, value)""")
def _(t):
    return activity.task_counts(t.task)


@query("a18_daily_trend", f"""SELECT strftime(d, '%Y-%m-%d') AS day, (SELECT count(*) FROM v_task WHERE CAST(created_at AS DATE) = d) AS created,
    (SELECT count(*) FROM v_task WHERE status = 'completed' AND CAST(updated_at AS DATE) = d) AS completed
    FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-07-04', {NOW}, INTERVAL 1 DAY)) AS DATE) AS d)""")
def _(t):
    return activity.daily_trend(t.task, ORDERS_NOW).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- change log --------------------------------------------------------------------------------

SUMMARY = """count(*) AS files, count(*) FILTER (is_new) AS new_files, count(*) FILTER (NOT is_new AND status = 'modified') AS modified_files, count(*) FILTER (status = 'deleted') AS deleted_files,
    CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) FILTER (category = 'test') AS test_files,
    array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, bool_or(category = 'component' AND is_new) AS has_new_components, bool_or(category = 'test' AND is_new) AS has_new_tests,
    bool_or(category = 'api') AS has_api_changes, bool_or(category IN ('component', 'style')) AS has_ui_changes"""
FIRST3 = "(SELECT string_agg(language, ',' ORDER BY f, language) FROM (SELECT language, min(path) AS f FROM files WHERE language <> '' GROUP BY 1 ORDER BY f, language LIMIT 3))"
SIGNALS = """concat_ws(',', CASE WHEN bool_or(contains(lower(message), 'refactor')) THEN 'Code refactoring' END, CASE WHEN bool_or(contains(lower(message), 'performance') OR contains(lower(message), 'optimize')) THEN 'Performance optimization' END,
    CASE WHEN bool_or(contains(lower(message), 'test') OR contains(lower(message), 'tdd')) THEN 'Test-driven development' END, CASE WHEN bool_or(contains(path, 'api/')) THEN 'API development' END,
    CASE WHEN bool_or(category = 'component' AND is_new) THEN 'New component architecture' END, CASE WHEN bool_or(contains(path, 'util') AND is_new) THEN 'New utility functions' END)"""
# the paths of the test pages say little, so folders are added that the rules know
PATHS = """v_paths AS MATERIALIZED (SELECT * REPLACE (CASE id % 9 WHEN 0 THEN 'src/components/' || path || '.tsx' WHEN 1 THEN 'api/' || path || '.ts' WHEN 2 THEN 'test/' || path || '.js' WHEN 3 THEN 'src/util/' || path || '.ts' WHEN 4 THEN path || '.css' ELSE path END AS path,
    CASE WHEN id % 10 = 0 THEN 'Refactor ' || message WHEN id % 10 = 1 THEN 'Optimize' ELSE message END AS message) FROM v_change)"""
TREE = f"{PATHS}, {FILES.replace('FROM v_change', 'FROM v_paths')}"


def _files(t):
    i, p = F.col("id") % 9, F.col("path")
    path = (F.when(i == 0, F.concat(F.lit("src/components/"), p, F.lit(".tsx"))).when(i == 1, F.concat(F.lit("api/"), p, F.lit(".ts")))
            .when(i == 2, F.concat(F.lit("test/"), p, F.lit(".js"))).when(i == 3, F.concat(F.lit("src/util/"), p, F.lit(".ts"))).when(i == 4, F.concat(p, F.lit(".css"))).otherwise(p))
    said = F.when(F.col("id") % 10 == 0, F.concat(F.lit("Refactor "), "message")).when(F.col("id") % 10 == 1, "Optimize").otherwise(F.col("message"))
    return changes.describe_files(t.change.withColumn("path", path).withColumn("message", said))


@query("a15_change_summary", f"WITH {TREE} SELECT {SUMMARY}, {FIRST3} AS languages FROM files")
def _(t):
    return changes.change_summary(_files(t)).withColumns({c: joined(F.col(c)) for c in ("categories", "languages")})


@query("a15_change_summary_by_status", f"WITH {TREE} SELECT status, {SUMMARY} FROM files GROUP BY 1")
def _(t):
    return changes.change_summary(_files(t), keys=["status"]).withColumn("categories", joined(F.col("categories"))).drop("languages")


@query("a16_architecture_signals", f"WITH {TREE} SELECT {SIGNALS} AS signals FROM files")
def _(t):
    f = _files(t)
    return changes.architecture_signals(f, f.select("message")).select(joined(F.col("signals")).alias("signals"))


def _summary(t):
    f = _files(t)
    s = changes.change_summary(f).withColumn("k", F.lit(1)).join(changes.architecture_signals(f, f).withColumn("k", F.lit(1)), "k")
    return s, {c: F.col(c) for c in s.columns}


@query("c15_derived_tags", f"""WITH {TREE}, s AS (SELECT {SUMMARY}, {SIGNALS} AS signals, {FIRST3} AS languages FROM files)
    SELECT array_to_string(list_slice(list_filter(['mine', CASE WHEN has_new_components THEN 'React Components' END, CASE WHEN has_new_tests THEN 'Testing' END, CASE WHEN has_api_changes THEN 'API Development' END,
        CASE WHEN has_ui_changes THEN 'UI/UX' END, CASE WHEN contains(languages, 'typescript') THEN 'TypeScript' END, CASE WHEN contains(languages, 'css') THEN 'CSS' END,
        CASE WHEN contains(categories, 'util') THEN 'Utilities' END, CASE WHEN contains(signals, 'Performance') THEN 'Performance' END, CASE WHEN contains(signals, 'Test-driven') THEN 'TDD' END, 'Development', 'Technical Documentation'],
        lambda x: x IS NOT NULL), 1, 6), ',') AS tags FROM s""")
def _(t):
    s, cols = _summary(t)
    return s.select(joined(changes.derived_tags(F.array(F.lit("mine")), cols)).alias("tags"))


@query("c16_summary_sentence", f"""WITH {TREE}, s AS (SELECT {SUMMARY}, {SIGNALS} AS signals FROM files),
    p AS (SELECT *, list_filter([CASE WHEN has_new_components THEN 'new React components' END, CASE WHEN has_api_changes THEN 'API enhancements' END, CASE WHEN has_new_tests THEN 'comprehensive testing' END,
        CASE WHEN insertions > 500 THEN 'extensive code additions' END, nullif(lower(string_split(signals, ',')[1]), '')], lambda x: x IS NOT NULL) AS f FROM s)
    SELECT 'Implementation of Search featuring ' || array_to_string(list_slice(f, 1, 3), ', ') || CASE WHEN len(f) > 3 THEN ', and ' || (len(f) - 3) || ' other improvements' ELSE '' END
        || '. Includes ' || insertions || ' lines of new code across ' || files || ' files.' AS sentence FROM p""")
def _(t):
    s, cols = _summary(t)
    return s.select(changes.summary_sentence(F.lit("Search"), cols).alias("sentence"))


@query("a21_session_progress", """WITH c AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(id AS INTEGER)) AS ts FROM v_change)
    SELECT count(*) AS commits, CAST(sum(CASE WHEN id % 7 = 0 THEN 0 ELSE insertions END) AS BIGINT) AS lines_added, CAST(sum(deletions) AS BIGINT) AS lines_removed,
    (SELECT string_agg(message, '|' ORDER BY ts DESC) FROM (SELECT message, ts FROM c WHERE ts > TIMESTAMP '2024-01-03' ORDER BY ts DESC LIMIT 3)) AS recent FROM c WHERE ts > TIMESTAMP '2024-01-03'""")
def _(t):
    log = t.change.select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("ts"), "message",
                          F.when(F.col("id") % 7 == 0, "-").otherwise(F.col("insertions").cast("string")).alias("added"), F.col("deletions").cast("string").alias("removed"))
    return changes.session_progress(log, datetime(2024, 1, 3)).withColumn("recent", F.array_join("recent", "|"))
