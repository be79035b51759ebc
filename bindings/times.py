"""Nearness in time and place: candidates, neighbours, sessions, bursts, decisions, quotas."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import activity, curation, filters, grouping, neighbors

from .registry import EVENTS_NOW, joined, query, r4
from .scalars import H, SAME

DT = "abs(epoch_us(a.captured_at) - epoch_us(b.captured_at))"


def _near_spot() -> str:
    h = f"({H})"
    km = f"2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h}))"
    return f"({SAME} OR {km} < 0.05)"


STRICT = f"a.project_id = b.project_id AND ({DT} < 60000000 OR ({DT} < 300000000 AND {_near_spot()}))"
PERMISSIVE = (f"((a.project_id = b.project_id AND {DT} < 300000000) OR (a.creator_id = b.creator_id AND {DT} < 900000000) "
              f"OR {DT} < 60000000 OR {_near_spot()})")


def _candidates_sql(rule: str) -> str:
    # pairs by time are looked for within 15 minutes, pairs by place within equal bands of 0.001 degrees
    return f"""WITH hits AS (SELECT a.id AS x, b.id AS y FROM v_photo a JOIN v_photo b ON a.id < b.id AND b.captured_at < a.captured_at + INTERVAL 15 MINUTE
            AND b.captured_at > a.captured_at - INTERVAL 15 MINUTE WHERE {rule}
        UNION SELECT a.id, b.id FROM v_photo a JOIN v_photo b ON a.id < b.id AND abs(a.latitude - b.latitude) < 0.001
            AND abs(a.longitude - b.longitude) < 0.001 WHERE {rule})
        SELECT id, project_id FROM v_photo WHERE id IN (SELECT x FROM hits UNION SELECT y FROM hits)"""


@query("j4_candidates_strict", _candidates_sql(STRICT))
def _(t):
    return neighbors.candidate_rows(t.photo, "strict").select("id", "project_id")


@query("j4_candidates_permissive", _candidates_sql(PERMISSIVE))
def _(t):
    return neighbors.candidate_rows(t.photo, "permissive").select("id", "project_id")


def _pairs_sql(mode: str, rule: str) -> str:
    return f"""SELECT '{mode}' AS mode, (SELECT count(*) FROM v_photo) AS total, count(*) AS compared FROM (
        SELECT a.id AS x, b.id AS y FROM v_photo a JOIN v_photo b ON a.id < b.id AND b.captured_at < a.captured_at + INTERVAL 15 MINUTE
            AND b.captured_at > a.captured_at - INTERVAL 15 MINUTE WHERE {rule}
        UNION SELECT a.id, b.id FROM v_photo a JOIN v_photo b ON a.id < b.id AND abs(a.latitude - b.latitude) < 0.001
            AND abs(a.longitude - b.longitude) < 0.001 WHERE {rule})"""


@query("a14_candidate_savings", f"""WITH c AS ({_pairs_sql('strict', STRICT)} UNION ALL {_pairs_sql('permissive', PERMISSIVE)})
    SELECT *, total * (total - 1) // 2 AS all_pairs, CAST(floor((1.0 - compared / CAST(total * (total - 1) // 2 AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS saved_pct FROM c""")
def _(t):
    counts = [neighbors.candidate_pairs(t.photo, mode).withColumn("mode", F.lit(mode)) for mode in ("strict", "permissive")]
    return activity.pair_savings(counts[0].unionByName(counts[1]))


NEAR = """near AS MATERIALIZED (SELECT a.id, b.id AS other, abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) AS gap,
    a.latitude AS lat, a.longitude AS lon, b.latitude AS blat, b.longitude AS blon,
    row_number() OVER (PARTITION BY a.id ORDER BY abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)), b.id) AS r
    FROM v_photo a JOIN v_photo b ON a.id <> b.id AND b.captured_at > a.captured_at - INTERVAL 30 SECOND AND b.captured_at < a.captured_at + INTERVAL 30 SECOND
    QUALIFY r <= 4)"""


@query("j5_nearest_in_time", f"WITH {NEAR} SELECT id, other, gap, r AS rank FROM near")
def _(t):
    near = neighbors.nearest_in_time(t.photo.select("id", "captured_at"))
    return near.select("id", F.posexplode("near").alias("p", "n")).select(
        "id", F.col("n.id").alias("other"), F.col("n.gap").alias("gap"), (F.col("p") + 1).cast("bigint").alias("rank"))


DECISIONS = f"""{NEAR}, agg AS (SELECT id, count(*) AS n, count(*) FILTER (gap <= 10000000) AS n_burst,
    count(*) FILTER (abs(lat - blat) < 1e-5 AND abs(lon - blon) < 1e-5) AS n_spot,
    list(other ORDER BY r) FILTER (gap <= 10000000) AS burst,
    list(other ORDER BY r) FILTER (abs(lat - blat) < 1e-5 AND abs(lon - blon) < 1e-5) AS spot,
    list(other ORDER BY r) FILTER (r <= 2) AS two FROM near GROUP BY id),
    dec AS MATERIALIZED (SELECT p.id, CASE WHEN n IS NULL THEN 'unique' WHEN n_burst > 0 THEN 'burst_shot' WHEN n_spot > 0 THEN 'duplicate'
        WHEN n >= 2 THEN 'similar' ELSE 'unique' END AS decision,
        CASE WHEN n IS NULL THEN 0.9 WHEN n_burst > 0 THEN 0.8 WHEN n_spot > 0 THEN 0.9 WHEN n >= 2 THEN 0.6 ELSE 0.8 END AS confidence,
        CASE WHEN n IS NULL THEN [] WHEN n_burst > 0 THEN burst WHEN n_spot > 0 THEN spot WHEN n >= 2 THEN two ELSE [] END AS related
        FROM v_photo p LEFT JOIN agg USING (id))"""


@query("g6_time_decisions", f"""WITH {DECISIONS} SELECT id, decision, CAST(confidence AS DOUBLE) AS confidence, array_to_string(related, ',') AS related,
    CASE decision WHEN 'burst_shot' THEN 'rapid_sequence,burst_mode' WHEN 'duplicate' THEN 'same_location,duplicate' WHEN 'similar' THEN 'sequential_shots' ELSE '' END AS patterns FROM dec""")
def _(t):
    d = neighbors.time_decisions(t.photo)
    return d.select("id", "decision", "confidence", joined(F.col("related")).alias("related"), joined(F.col("patterns")).alias("patterns"))


# brute force: walk the seeds in order with the list of rows that are taken
CLAIMS = f"""{DECISIONS}, seeds AS MATERIALIZED (SELECT id, decision, confidence, list_concat([id], related) AS claim, row_number() OVER (ORDER BY id) AS k
    FROM dec WHERE decision <> 'unique' AND len(related) > 0),
    walk(k, taken, grp, members) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST([] AS BIGINT[])
        UNION ALL SELECT w.k + 1,
            CASE WHEN f.ok THEN list_filter(list_concat(w.taken, f.free), lambda x: x > s.id - 40) ELSE w.taken END,
            CASE WHEN f.ok THEN s.id END, CASE WHEN f.ok THEN f.free ELSE [] END
        FROM walk w JOIN seeds s ON s.k = w.k + 1,
            LATERAL (SELECT list_filter(s.claim, lambda x: NOT list_contains(w.taken, x)) AS free,
                NOT list_contains(w.taken, s.id) AND len(list_filter(s.claim, lambda x: NOT list_contains(w.taken, x))) > 1 AS ok) f),
    won AS (SELECT grp AS group_id, unnest(members) AS member_id FROM walk WHERE grp IS NOT NULL)"""
KIND = "CASE d.decision WHEN 'duplicate' THEN 'exact_duplicate' WHEN 'burst_shot' THEN 'burst_sequence' ELSE 'similar_composition' END"


@query("g7_decision_groups", f"WITH RECURSIVE {CLAIMS} SELECT group_id, member_id, {KIND} AS type, CAST(d.confidence AS DOUBLE) AS confidence FROM won JOIN dec d ON d.id = won.group_id")
def _(t):
    return grouping.groups_from_decisions(neighbors.time_decisions(t.photo))


@query("w4_burst_ranking", f"""WITH RECURSIVE {CLAIMS} SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY s DESC, member_id) AS rank, s AS score
    FROM (SELECT won.*, CAST(CASE WHEN member_id % 3 = 0 THEN 0.5 ELSE (member_id % 10 + 1) / 10.0 END AS DOUBLE) AS s FROM won JOIN dec d ON d.id = won.group_id WHERE d.decision = 'burst_shot')""")
def _(t):
    groups = grouping.groups_from_decisions(neighbors.time_decisions(t.photo))
    scores = t.photo.filter("id % 3 <> 0").select(F.col("id").alias("member_id"), ((F.col("id") % 10 + 1) / 10.0).alias("score"))
    return curation.burst_ranking(groups, scores).select("group_id", "member_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query("a13_decision_counts", f"""WITH {DECISIONS} SELECT p.project_id, count(*) AS total, count(*) FILTER (decision = 'burst_shot') AS burst, count(*) FILTER (decision = 'duplicate') AS duplicate,
    count(*) FILTER (decision = 'similar') AS similar, count(*) - count(*) FILTER (decision IN ('duplicate', 'burst_shot')) AS unique FROM dec JOIN v_photo p USING (id) GROUP BY 1""")
def _(t):
    return activity.decision_counts(neighbors.time_decisions(t.photo), "project_id")


@query("f18_decision_filter", f"""WITH {DECISIONS} SELECT 'burst' AS which, id FROM dec WHERE decision = 'burst_shot' UNION ALL SELECT 'unique', id FROM dec WHERE decision = 'unique'
    UNION ALL SELECT 'tag', id FROM v_photo WHERE contains(lower(tags[1]), 'ur')""")
def _(t):
    d = neighbors.time_decisions(t.photo)
    a = filters.filter_decisions(d, "burst_shots").select(F.lit("burst").alias("which"), "id")
    b = filters.filter_decisions(d, "unique").select(F.lit("unique").alias("which"), "id")
    c = t.photo.filter(filters.tag_name_contains(F.col("tags")[0], "UR")).select(F.lit("tag").alias("which"), "id")
    return a.unionByName(b).unionByName(c)


SESSIONS = """s0 AS (SELECT *, epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (ORDER BY captured_at, id) AS gap FROM v_photo),
    s1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 120000000 THEN 1 ELSE 0 END) OVER (ORDER BY captured_at, id) AS g FROM s0),
    s2 AS MATERIALIZED (SELECT *, min(epoch_us(captured_at)) OVER (PARTITION BY g) AS session_start, count(*) OVER (PARTITION BY g) AS size FROM s1)"""


@query("w1_gap_sessions", f"WITH {SESSIONS} SELECT id, session_start, size FROM s2 WHERE size > 1")
def _(t):
    return neighbors.time_groups(t.photo, 120).select("id", "session_start", "size")


@query("w1_gap_sessions_keyed", """WITH s0 AS (SELECT *, epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY creator_id ORDER BY captured_at, id) AS gap FROM v_photo),
    s1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY creator_id ORDER BY captured_at, id) AS g FROM s0)
    SELECT id, min(epoch_us(captured_at)) OVER (PARTITION BY creator_id, g) AS session_start FROM s1""")
def _(t):
    return neighbors.gap_sessions(t.photo, 21600, ["creator_id"]).select("id", "session_start")


@query("w2_burst_test", f"""WITH {SESSIONS}, f AS (SELECT *, first_value(latitude) OVER w AS lat0, first_value(longitude) OVER w AS lon0 FROM s2 WHERE size > 1
        WINDOW w AS (PARTITION BY session_start ORDER BY captured_at, id)),
    g AS (SELECT session_start, count(*) AS size, (max(epoch_us(captured_at)) - min(epoch_us(captured_at))) / 1e6 AS spread,
        bool_and(abs(latitude - lat0) < 0.0001 AND abs(longitude - lon0) < 0.0001) AS same_place FROM f GROUP BY 1)
    SELECT session_start, size, floor(spread * 1e4 + 0.5) / 1e4 AS spread_s, floor(spread / (size - 1) * 1e4 + 0.5) / 1e4 AS mean_interval_s, same_place, spread <= 10 AND same_place AS is_burst FROM g""")
def _(t):
    b = neighbors.burst_test(neighbors.time_groups(t.photo, 120))
    return b.withColumns({c: r4(F.col(c)) for c in ("spread_s", "mean_interval_s")})


@query("w9_quota_flags", """SELECT id, count(*) OVER (PARTITION BY project_id ORDER BY epoch_us(captured_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent,
    count(*) OVER (PARTITION BY project_id ORDER BY epoch_us(captured_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 2 AS over_quota FROM v_photo""")
def _(t):
    return neighbors.quota_flags(t.photo, "project_id", "captured_at", 2, 3600).select("id", "recent", "over_quota")


@query("a8_analysis_stats", """SELECT total, analysed, new, never, epoch_us(last) AS last_analysis, new || ' new photos since last analysis' AS message
    FROM (SELECT count(*) AS total, count(analyzed_at) AS analysed, max(analyzed_at) AS last,
        count(*) FILTER (analyzed_at IS NULL OR captured_at > analyzed_at OR analyzed_at < TIMESTAMP '2024-01-24') AS new,
        count(*) FILTER (analyzed_at IS NULL) AS never FROM v_photo)""")
def _(t):
    return activity.analysis_stats(t.photo, EVENTS_NOW).withColumn("last_analysis", F.unix_micros("last_analysis"))
