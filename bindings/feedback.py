"""Feedback metrics, patterns, trends, preferences, retention."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import feedback as fb

from .registry import EVENTS_NOW, joined, q4, query, r4
from .scalars import EDITS, PROHIBITED

us = F.unix_micros
SUMS = "count(*) FILTER (feedback = 'positive') AS positive, count(*) FILTER (feedback = 'negative') AS negative, count(*) FILTER (feedback = 'edit') AS edits, count(*) AS total"
SUNDAY = "date_trunc('day', ts) - to_days(CAST(dayofweek(ts) AS INTEGER))"
SCOPES = """scoped AS (SELECT *, 'prompt:' || user_type || ':' || user_id AS prompt_id FROM v_feedback UNION ALL SELECT *, 'prompt:' || user_type || ':global' FROM v_feedback)"""
START = f"CASE grain WHEN 'week' THEN {SUNDAY} WHEN 'hour' THEN date_trunc('hour', ts) WHEN 'day' THEN date_trunc('day', ts) ELSE date_trunc('month', ts) END"
AGGS = f"""{SCOPES}, aggs AS MATERIALIZED (SELECT prompt_id, grain, {START} AS period_start, {SUMS} FROM scoped, (SELECT unnest(['hour','day','week','month']) AS grain) GROUP BY 1, 2, 3)"""
SUCCESS = "CASE WHEN positive + negative = 0 THEN 0.5 ELSE positive / CAST(positive + negative AS DOUBLE) END"
EDIT = "CASE WHEN total = 0 THEN 0.0 ELSE edits / CAST(total AS DOUBLE) END"
TOTALS = "CAST(sum(positive) AS BIGINT) AS positive, CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(total) AS BIGINT) AS total"


def newest(grain: str, n: int) -> str:
    return f"rec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY period_start DESC) AS recency FROM aggs WHERE grain = '{grain}' QUALIFY recency <= {n})"


@query("a2_feedback_metrics", f"SELECT user_type, epoch_us({SUNDAY}) AS start, {SUMS} FROM v_feedback GROUP BY 1, 2")
def _(t):
    return fb.feedback_metrics(t.feedback, ["user_type"], "week").select("user_type", us("period_start").alias("start"), *fb.METRICS)


@query("a3_aggregate_prompts", f"WITH {AGGS} SELECT prompt_id, grain, epoch_us(period_start) AS start, positive, negative, edits, total FROM aggs")
def _(t):
    return fb.aggregate_prompts(t.feedback).select("prompt_id", "grain", us("period_start").alias("start"), *fb.METRICS)


@query("a4_edit_patterns", f"""WITH {EDITS}, p AS (SELECT role, conv_id, turn, edited, unnest(patterns) AS pattern FROM ep WHERE length(original) > 0 AND length(edited) > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY role, pattern ORDER BY conv_id DESC, turn DESC) AS r, min((conv_id, turn)) OVER (PARTITION BY role, pattern) AS seen, count(*) OVER (PARTITION BY role, pattern) AS frequency FROM p)
    SELECT role, pattern, frequency, string_agg(edited, '|' ORDER BY conv_id, turn) FILTER (r <= 3) AS examples, row_number() OVER (PARTITION BY role ORDER BY frequency DESC, any_value(seen)) AS rank FROM n GROUP BY role, pattern, frequency""")
def _(t):
    out = fb.mine_edit_patterns(t.edit, ["role"], ["conv_id", "turn"])
    return out.select("role", "pattern", "frequency", F.array_join("examples", "|").alias("examples"), F.col("rank").cast("bigint").alias("rank"))


@query("a5_prompt_performance", f"WITH {AGGS}, {newest('hour', 24)} SELECT *, {q4(SUCCESS)} AS success_rate, {q4(EDIT)} AS edit_rate FROM (SELECT prompt_id, {TOTALS} FROM rec GROUP BY 1)")
def _(t):
    hourly = fb.aggregate_prompts(t.feedback, ["hour"])
    return fb.prompt_performance(hourly, 24).withColumns({c: r4(F.col(c)) for c in ("success_rate", "edit_rate")})


@query("a6_weekly_summary", f"""WITH {AGGS}, {newest('day', 7)}, s AS (SELECT prompt_id, {TOTALS} FROM rec WHERE prompt_id NOT LIKE '%:1_' GROUP BY 1)
    SELECT *, {q4(SUCCESS)} AS success_rate, {q4(EDIT)} AS edit_rate, CASE WHEN total < 50 THEN 'maintain' WHEN {SUCCESS} < 0.7 OR {EDIT} > 0.3 THEN 'evolve' ELSE 'maintain' END AS recommendation FROM s""")
def _(t):
    daily = fb.aggregate_prompts(t.feedback, ["day"])
    locked = daily.filter(F.col("prompt_id").rlike(r":1.$")).select("prompt_id").distinct()
    return fb.weekly_summary(daily, locked=locked).withColumns({c: r4(F.col(c)) for c in ("success_rate", "edit_rate")})


@query("a6_top_patterns", f"""WITH {EDITS}, p AS (SELECT 'prompt:' || role AS prompt_id, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 20 AS INTEGER)) AS period_start, unnest(patterns) AS pattern FROM ep),
    days AS (SELECT prompt_id, period_start FROM (SELECT DISTINCT 'prompt:' || role AS prompt_id, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 20 AS INTEGER)) AS period_start FROM ep)
        QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY period_start DESC) <= 7),
    c AS (SELECT prompt_id, pattern, count(*) AS n FROM p JOIN days USING (prompt_id, period_start) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY count(*) DESC, pattern) <= 5)
    SELECT prompt_id, string_agg(pattern || ':' || n, ',' ORDER BY n DESC, pattern) AS top_patterns FROM c GROUP BY 1""")
def _(t):
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") % 20 * 86_400)
    e = t.edit.select(F.concat(F.lit("prompt:"), "role").alias("prompt_id"), day.alias("period_start"), "original", "edited", "conv_id", "turn")
    daily = e.groupBy("prompt_id", "period_start").agg(*[F.count(F.lit(1)).alias(m) for m in fb.METRICS])
    patterns = fb.mine_edit_patterns(e, ["prompt_id", "period_start"], ["conv_id", "turn"])
    out = fb.weekly_summary(daily, patterns)
    return out.filter("top_patterns IS NOT NULL").select("prompt_id", joined(F.transform("top_patterns", lambda p: F.concat(p["pattern"], F.lit(":"), p["frequency"]))).alias("top_patterns"))


def _last(cases: str) -> str:
    return f"arg_max({cases}, (conv_id, turn)) FILTER (({cases}) IS NOT NULL)"


STYLE = "CASE WHEN k = 'edit' AND list_contains(patterns, 'made more formal') THEN 'technical' WHEN k = 'edit' AND list_contains(patterns, 'removed technical jargon') THEN 'conversational' END"
DETAIL = "CASE WHEN k = 'edit' AND list_contains(patterns, 'expanded response') THEN 'detailed' WHEN k = 'edit' AND list_contains(patterns, 'shortened response') THEN 'concise' END"


@query("a7_preference_profiles", f"""WITH {EDITS}, f AS (SELECT *, conv_id % 25 AS user_id, CASE turn % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'edit' END AS k FROM ep)
    SELECT user_id, coalesce({_last(STYLE)}, 'balanced') AS response_style, coalesce({_last(DETAIL)}, 'concise') AS detail_level, count(*) AS total_feedback,
    {q4("CASE WHEN count(*) FILTER (k <> 'edit') = 0 THEN 0.5 ELSE count(*) FILTER (k = 'positive') / CAST(count(*) FILTER (k <> 'edit') AS DOUBLE) END")} AS positive_ratio FROM f GROUP BY 1""")
def _(t):
    n = F.col("turn") % 5
    f = t.edit.withColumn("user_id", F.col("conv_id") % 25).withColumn("feedback", F.when(n == 0, "positive").when(n == 1, "negative").otherwise("edit"))
    return fb.preference_profiles(f, "user_id", ["conv_id", "turn"]).withColumn("positive_ratio", r4(F.col("positive_ratio")))


def trend(v: str) -> str:
    old, new = f"avg({v}) FILTER (i <= n // 2)", f"avg({v}) FILTER (i > n // 2)"
    return f"CASE WHEN max(n) < 2 OR count(*) FILTER ({v} IS NULL) > 0 THEN 'stable' WHEN {new} > ({old}) * 1.1 THEN 'improving' WHEN {new} < ({old}) * 0.9 THEN 'declining' ELSE 'stable' END"


SERIES = "ser AS (SELECT *, positive / CAST(nullif(positive + negative, 0) AS DOUBLE) AS sr, edits / CAST(nullif(total, 0) AS DOUBLE) AS er, CAST(total AS DOUBLE) AS vol, row_number() OVER w AS i, count(*) OVER (PARTITION BY prompt_id) AS n FROM {0} WINDOW w AS (PARTITION BY prompt_id ORDER BY period_start))"


@query("w5_trends", f"WITH {AGGS}, d AS (SELECT * FROM aggs WHERE grain = 'day'), {SERIES.format('d')} SELECT prompt_id, {trend('sr')} AS success_trend, {trend('er')} AS edit_trend, {trend('vol')} AS volume_trend FROM ser GROUP BY 1")
def _(t):
    daily = fb.aggregate_prompts(t.feedback, ["day"])
    div = lambda a, b: F.try_divide(a, b)
    return fb.trends(daily, {"success": div(F.col("positive"), F.col("positive") + F.col("negative")), "edit": div(F.col("edits"), F.col("total")), "volume": F.col("total")})


@query("t3_newest_periods", f"WITH {AGGS}, {newest('day', 3)} SELECT prompt_id, epoch_us(period_start) AS start, total, recency FROM rec")
def _(t):
    return fb.newest_periods(fb.aggregate_prompts(t.feedback, ["day"]), 3).select("prompt_id", us("period_start").alias("start"), "total", F.col("recency").cast("bigint").alias("recency"))


@query("c13_performance_report", f"""WITH {AGGS}, {newest('hour', 24)}, {SERIES.format('rec')}, r AS (SELECT prompt_id, {TOTALS}, {trend('sr')} AS success_trend, {trend('er')} AS edit_trend, {trend('vol')} AS volume_trend FROM ser GROUP BY 1)
    SELECT prompt_id, {q4(SUCCESS)} AS success_rate, {q4(EDIT)} AS edit_rate, success_trend, edit_trend, volume_trend,
    concat_ws('|', CASE WHEN {SUCCESS} < 0.6 THEN 'Consider reviewing negative feedback patterns' END, CASE WHEN {EDIT} > 0.3 THEN 'High edit rate detected - analyze common edit patterns' END,
        CASE WHEN success_trend = 'declining' THEN 'Success rate declining - consider prompt adjustment' END) AS recommendations FROM r""")
def _(t):
    r = fb.performance_report(fb.aggregate_prompts(t.feedback, ["hour"]), 24)
    return r.select("prompt_id", r4(F.col("success_rate")).alias("success_rate"), r4(F.col("edit_rate")).alias("edit_rate"), "success_trend", "edit_trend", "volume_trend",
                    F.array_join("recommendations", "|").alias("recommendations"))


@query("c11_retention", """SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-11') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-11') AS kept FROM v_feedback""")
def _(t):
    return fb.deleted_count(t.feedback, EVENTS_NOW, 20)


@query("c11_keep_recent", "SELECT id, user_id FROM v_feedback WHERE ts >= TIMESTAMP '2024-01-11'")
def _(t):
    return fb.keep_recent(t.feedback, EVENTS_NOW, 20).select("id", "user_id")


@query("c11_expire_aggregates", f"""WITH {AGGS} SELECT prompt_id, grain, epoch_us(period_start) AS start FROM aggs WHERE period_start >= TIMESTAMP '2024-01-31' - to_days(CASE grain WHEN 'hour' THEN 7 WHEN 'day' THEN 30 WHEN 'week' THEN 90 ELSE 365 END)""")
def _(t):
    return fb.expire_aggregates(fb.aggregate_prompts(t.feedback), EVENTS_NOW).select("prompt_id", "grain", us("period_start").alias("start"))


@query("a19_acceptance_log", "SELECT user_id, item_id, arg_max(feedback, (ts, id)) AS verdict FROM v_feedback GROUP BY 1, 2")
def _(t):
    return fb.acceptance_log(t.feedback, order=("ts", "id"))


@query("a19_acceptance_counts", """SELECT user_id, count(*) FILTER (v = 'positive') AS accepted, count(*) FILTER (v = 'negative') AS rejected
    FROM (SELECT user_id, item_id, arg_max(feedback, (ts, id)) AS v FROM v_feedback GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return fb.acceptance_counts(fb.acceptance_log(t.feedback, order=("ts", "id")))


@query("c14_check_proposals", f"""SELECT id, b AS boundary_check, s AS safety_check, b AND s AND id % 6 <> 0 AS passed, concat_ws(',', CASE WHEN NOT b THEN 'Missing required boundaries' END,
    CASE WHEN id % 6 = 0 THEN 'Failed regression tests' END, CASE WHEN NOT s THEN 'Failed safety check' END) AS details, id % 4 + 1 AS new_version
    FROM (SELECT id, contains(lower(description), 'the') AND contains(lower(description), 'on') AS b, len(list_filter({PROHIBITED}, lambda p: contains(lower(description || CASE WHEN id % 9 = 0 THEN ' Bypass it' ELSE '' END), p))) = 0 AS s FROM v_doc)""")
def _(t):
    i = F.col("id")
    df = t.doc.select("id", F.concat("description", F.when(i % 9 == 0, " Bypass it").otherwise("")).alias("proposed"), F.array(F.lit("The"), F.lit("ON")).alias("boundaries"),
                      (i % 4).alias("version"), (i % 6 != 0).alias("regression_ok"))
    return fb.check_proposals(df, EVENTS_NOW).select("id", "boundary_check", "safety_check", "passed", joined(F.col("details")).alias("details"), "new_version")
