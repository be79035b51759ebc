"""Ranking, recommendations and actions."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import keep_count, quality
from keepsake.operators import curation
from keepsake.plans import cascade

from .groups import VEC_EDGES
from .registry import EVENTS_NOW, leaders_sql, q4, query, r4
from .scalars import DOCUMENTATION, INFO

# Groups of equal documents, ranked by quality. Copies have equal texts, so coordinates decide, then ids.
RANKED = f"""grp AS (SELECT * FROM (SELECT *, min(id) OVER w AS group_id, count(*) OVER w AS n FROM v_doc WINDOW w AS (PARTITION BY content_hash)) WHERE n > 1),
    ranked AS MATERIALIZED (SELECT group_id, id AS member_id, n, row_number() OVER (PARTITION BY group_id ORDER BY {DOCUMENTATION} DESC, {INFO} DESC, id) AS rank FROM grp)"""
SHARE = """CASE t WHEN 0 THEN 1 WHEN 1 THEN greatest(1, ceil(n * 0.3)) WHEN 2 THEN greatest(1, ceil(n * 0.4)) WHEN 3 THEN greatest(2, ceil(n * 0.6))
    WHEN 4 THEN greatest(1, ceil(n * 0.5)) ELSE greatest(1, ceil(n * 0.4)) END"""
TYPES = ["exact_duplicates", "retry_shots", "angle_variations", "incremental_progress", "redundant_documentation", "other"]


def _exact(t):
    return cascade.exact_groups(t.doc)


def _recommended(t, type_=None):
    type_ = F.lit("exact_duplicates") if type_ is None else type_
    groups = _exact(t)
    heads = groups.filter("is_leader").select("group_id", type_.alias("type"), F.lit(1.0).alias("overall"), F.lit(1.0).alias("confidence"))
    return curation.recommend(groups, heads, t.doc)


@query("w3_best_in_group", f"WITH {RANKED} SELECT group_id, member_id, rank FROM ranked WHERE rank <= 2")
def _(t):
    return curation.best_in_group(_exact(t), t.doc, 2).select("group_id", "member_id", F.col("rank").cast("bigint").alias("rank"))


@query("w3_rank_members", f"WITH {RANKED} SELECT group_id, member_id, rank FROM ranked")
def _(t):
    return curation.rank_members(_exact(t), t.doc).select("group_id", "member_id", F.col("rank").cast("bigint").alias("rank"))


@query("c1_keep_count", f"SELECT content_hash, CAST({SHARE} AS BIGINT) AS keep FROM (SELECT content_hash, 7 * count(*) + min(id) % 9 AS n, min(id) % 6 AS t FROM v_doc GROUP BY 1)")
def _(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.min("id") % 6 + 1).cast("int"))
    g = t.doc.groupBy("content_hash").agg((F.count(F.lit(1)) * 7 + F.min("id") % 9).alias("n"), kind.alias("type"))
    return g.select("content_hash", keep_count(F.col("type"), F.col("n")).alias("keep"))


ONE = "I found ' || n || ' photos showing identical photos (exact duplicates). This photo captures everything you need with the best quality and most complete documentation."


@query("c2_recommendations", f"""WITH {RANKED} SELECT group_id, member_id, rank, CASE WHEN rank <= 1 THEN 'keep' ELSE 'archive' END AS action, n AS size,
    floor((n - 1) * 0.5 * 10 + 0.5) / 10 AS minutes_saved, CAST(0.95 AS DOUBLE) AS confidence, '{ONE}' AS rationale FROM ranked""")
def _(t):
    head, members = _recommended(t)
    return members.join(head, "group_id").select("group_id", "member_id", F.col("rank").cast("bigint").alias("rank"), "action", "size", "minutes_saved",
                                                 r4(F.col("confidence")).alias("confidence"), "rationale")


@query("c2_mixed_headers", f"""WITH {RANKED}, g AS (SELECT group_id, max(n) AS n, group_id % 6 AS t FROM ranked GROUP BY 1), k AS (SELECT *, CAST(least(n, {SHARE}) AS BIGINT) AS keep FROM g)
    SELECT group_id, n AS size, keep AS keep_count, CASE WHEN keep >= n THEN 0.0 ELSE floor((n - keep) * 0.5 * 10 + 0.5) / 10 END AS minutes_saved FROM k""")
def _(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("group_id") % 6 + 1).cast("int"))
    return _recommended(t, kind)[0].select("group_id", "size", "keep_count", "minutes_saved")


VEC_ROLL = f"""{VEC_EDGES}, {leaders_sql('ve', 'g')}, sz AS (SELECT leader, count(*) + 1 AS n, leader % 3 + 1 AS t FROM g GROUP BY leader),
    k AS (SELECT *, CAST(least(n, {SHARE}) AS BIGINT) AS keep FROM sz),
    roll AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS photos, CAST(sum(keep) AS BIGINT) AS keep, sum(CASE WHEN keep >= n THEN 0.0 ELSE floor((n - keep) * 0.5 * 10 + 0.5) / 10 END) AS minutes FROM k),
    top AS (SELECT t FROM k GROUP BY t ORDER BY count(*) DESC, min(leader) LIMIT 1)"""
NAME = "CASE t WHEN 1 THEN 'retry_shots' WHEN 2 THEN 'angle_variations' ELSE 'incremental_progress' END"


def _vector_rollup(t):
    from keepsake.operators import pairs
    g = pairs.vector_groups(t.vec, threshold=0.98, dim=64)
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("group_id") % 3 + 2).cast("int"))
    heads = g.filter("is_leader").select("group_id", kind.alias("type"), F.lit(0.99).alias("overall"), F.lit(0.99).alias("confidence"))
    photos = t.vec.select("id", F.lit("a photo").alias("description"), F.array(F.col("label").cast("string")).alias("tags"), F.lit(True).alias("has_coordinates"))
    return curation.rollup(curation.recommend(g, heads, photos)[0])


@query("a12_rollup", f"WITH RECURSIVE {VEC_ROLL} SELECT groups, photos, keep, CAST(minutes AS DOUBLE) AS minutes_saved, {NAME} AS primary_type FROM roll, top")
def _(t):
    return _vector_rollup(t)


@query("c3_summary_message", f"""WITH RECURSIVE {VEC_ROLL} SELECT groups, 'I found ' || groups || ' groups of similar photos (' || photos || ' total). I can help you streamline these to ' || keep ||
    ' photos that maintain all the important documentation.' || CASE WHEN minutes >= 1 THEN ' This could save you about ' || CAST(floor(minutes + 0.5) AS BIGINT) || ' minute' || CASE WHEN minutes > 1 THEN 's' ELSE '' END || ' during photo reviews.' ELSE '' END AS message FROM roll""")
def _(t):
    return curation.summary_message(_vector_rollup(t)).select("groups", "message")


@query("c4_actions", f"""WITH {RANKED} SELECT member_id AS photo_id, CASE WHEN rank = 1 THEN 'keep' ELSE 'archive' END AS type,
    CASE WHEN rank = 1 THEN 'Assistant recommended to keep - {ONE}' ELSE 'Assistant archived - similar to kept photo in same group' END AS reason, group_id FROM ranked""")
def _(t):
    return curation.actions_from(*_recommended(t)).select("photo_id", "type", "reason", "group_id")


def _stored(t):
    return t.doc.select("id", F.when(F.col("id") % 7 == 0, "archived").alias("archive_state"), F.when(F.col("id") % 7 == 0, F.lit(EVENTS_NOW).cast("timestamp")).alias("archived_at"),
                        F.when(F.col("id") % 7 == 0, "old").alias("archive_reason"))


STATE7 = "CASE WHEN id % 7 = 0 THEN 'archived' END"


@query("c5_apply_actions", f"""WITH {RANKED} SELECT id, CASE WHEN rank = 1 THEN 'active' WHEN rank > 1 THEN 'archived' ELSE {STATE7} END AS archive_state,
    CASE WHEN rank > 1 THEN 'Assistant archived - similar to kept photo in same group' WHEN id % 7 = 0 THEN 'old' END AS archive_reason, rank > 1 OR id % 7 = 0 AS has_time
    FROM v_doc LEFT JOIN ranked ON member_id = id""".replace("rank > 1 OR id % 7 = 0 AS has_time", "coalesce(rank > 1, false) OR id % 7 = 0 AS has_time"))
def _(t):
    out, _status = curation.apply_actions(_stored(t), curation.actions_from(*_recommended(t)), EVENTS_NOW)
    return out.select("id", "archive_state", "archive_reason", F.col("archived_at").isNotNull().alias("has_time"))


@query("j11_action_status", "SELECT id + 500 AS photo_id, CASE WHEN id + 500 IN (SELECT id FROM v_doc) AND id % 10 <> 9 THEN 'applied' ELSE 'failed' END AS status FROM v_doc")
def _(t):
    i = F.col("id")
    actions = t.doc.select((i + 500).alias("photo_id"), F.when(i % 10 == 9, "paint").when(i % 2 == 0, "archive").otherwise("delete").alias("type"), F.lit("r").alias("reason"), i.alias("seq"))
    return curation.apply_actions(_stored(t), actions, EVENTS_NOW)[1].select("photo_id", "status")


@query("c5_action_summary", """SELECT ok AS applied, n - ok AS failed, n = ok AS success, CASE WHEN n > ok THEN 'Some actions failed: ' || (n - ok) || ' of ' || n || ' actions failed to apply' END AS error
    FROM (SELECT count(*) AS n, count(*) FILTER (id + 500 IN (SELECT id FROM v_doc)) AS ok FROM v_doc)""")
def _(t):
    actions = t.doc.select((F.col("id") + 500).alias("photo_id"), F.lit("tag").alias("type"), F.lit("r").alias("reason"), F.col("id").alias("seq"))
    return curation.action_summary(curation.apply_actions(_stored(t), actions, EVENTS_NOW)[1])


@query("c6_archive_restore", f"""SELECT 'archive' AS op, id, CASE WHEN id % 5 = 0 THEN 'archived' ELSE {STATE7} END AS state, CASE WHEN id % 5 = 0 THEN 'bulk' WHEN id % 7 = 0 THEN 'old' END AS reason FROM v_doc
    UNION ALL SELECT 'restore', id, CASE WHEN id % 5 = 0 THEN 'active' ELSE {STATE7} END, CASE WHEN id % 5 <> 0 AND id % 7 = 0 THEN 'old' END FROM v_doc""")
def _(t):
    ids = t.doc.filter("id % 5 = 0").select("id")
    show = lambda op, df: df.select(F.lit(op).alias("op"), "id", F.col("archive_state").alias("state"), F.col("archive_reason").alias("reason"))
    a = curation.set_archive_state(_stored(t), ids, "archive", "bulk", EVENTS_NOW)
    return show("archive", a).unionByName(show("restore", curation.set_archive_state(_stored(t), ids, "restore", None, EVENTS_NOW)))


@query("c7_undo_last", f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'active' WHEN id % 4 = 1 THEN 'archived' ELSE {STATE7} END AS state,
    CASE WHEN id % 4 = 1 THEN 'Undo restore' WHEN id % 4 > 1 AND id % 7 = 0 THEN 'old' END AS reason FROM v_doc""")
def _(t):
    i = F.col("id")
    log = t.doc.select((i % 4 < 2).cast("int").alias("entry_seq"), F.concat(F.lit("s"), (i % 4 < 2).cast("int")).alias("suggestion_id"), i.alias("idx"),
                       F.when(i % 4 == 1, "restore").otherwise("archive").alias("type"), i.alias("photo_id"))
    out, _status = curation.undo_last(_stored(t), log, EVENTS_NOW)
    return out.select("id", F.col("archive_state").alias("state"), F.col("archive_reason").alias("reason"))


@query("c12_suggestion_status", """SELECT item_id, CASE arg_max(feedback, (ts, id)) WHEN 'positive' THEN 'accepted' WHEN 'negative' THEN 'rejected' WHEN 'edit' THEN 'dismissed' ELSE 'pending' END AS status,
    count(*) AS changes FROM v_feedback GROUP BY 1""")
def _(t):
    f = F.col("feedback")
    s = F.when(f == "positive", "accepted").when(f == "negative", "rejected").when(f == "edit", "dismissed").otherwise("pending")
    return curation.latest_status(t.feedback.withColumn("status", s), "item_id", ["ts", "id"])


@query("a20_suggestion_confidence", f"""SELECT count(*) AS groups, {q4('avg(c)')} AS mean_confidence, CASE WHEN avg(c) > 0.85 THEN 'high' WHEN avg(c) > 0.7 THEN 'medium' ELSE 'low' END AS level FROM (SELECT 0.7 + (id % 29) / CAST(100 AS DOUBLE) AS c FROM v_vec)
    UNION ALL SELECT count(*), {q4('avg(c)')}, CASE WHEN avg(c) > 0.7 THEN 'high' ELSE 'medium' END FROM (SELECT 0.7 + (id % 29) / CAST(100 AS DOUBLE) AS c FROM v_vec)""")
def _(t):
    g = t.vec.select((F.lit(0.7) + F.col("id") % 29 / F.lit(100.0)).alias("confidence"))
    a = curation.suggestion_confidence(g)
    out = a.unionByName(curation.suggestion_confidence(g, high=0.7, medium=None))
    return out.withColumn("mean_confidence", r4(F.col("mean_confidence")))
