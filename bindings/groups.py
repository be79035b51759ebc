"""Leader grouping. Oracles walk the rows one by one over the edges of all pairs."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import composite, grouping, pairs
from keepsake.plans import cascade

from .pairs import ALL_PAIRS, HCHARS, UDOT, shared_score, shared_sql
from .registry import TOK, leaders_sql, q4, query, r4
from .scalars import H, MINUTES, SAME, SPATIAL, TEMPORAL
from .times import PERMISSIVE

HASH_EDGES = f"he AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, 1.0 - ({HCHARS}) / CAST(64 AS DOUBLE) AS score FROM v_hash a JOIN v_hash b ON a.id < b.id) WHERE score >= 0.85)"
VEC_UNITS = ("u AS MATERIALIZED (SELECT id, list_transform(features, lambda x: x / sqrt(list_sum(list_transform(features, lambda y: y * y)))) AS u FROM {0})")
VEC_EDGES = f"{VEC_UNITS.format('v_vec')}, ve AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, {UDOT} AS score FROM u a JOIN u b ON a.id < b.id) WHERE score >= 0.98)"
DOC_SETS = f"s AS MATERIALIZED (SELECT id, {TOK.format('description')} AS k FROM v_doc)"
TEXT_EDGES = f"""{DOC_SETS}, {shared_sql('s', 'k', 'sh')}, te AS MATERIALIZED (SELECT * FROM ({shared_score('s', 'sh')}) WHERE score >= 0.7)"""


def long_form(edges: str, g: str, score: str = "e.score") -> str:
    return f"""SELECT g.leader AS group_id, g.member AS member_id, false AS is_leader, {q4(score)} AS score FROM {g} g JOIN {edges} e ON e.a = g.leader AND e.b = g.member
        UNION ALL SELECT DISTINCT leader, leader, true, 1.0 FROM {g}"""


def shown(groups):
    return groups.select("group_id", "member_id", "is_leader", r4(F.col("score")).alias("score"))


@query("g1_hash_groups", f"WITH RECURSIVE {HASH_EDGES}, {leaders_sql('he', 'g')} {long_form('he', 'g')}")
def _(t):
    return shown(pairs.hash_groups(t.hash))


@query("g2_vector_groups", f"WITH RECURSIVE {VEC_EDGES}, {leaders_sql('ve', 'g')} {long_form('ve', 'g')}")
def _(t):
    return shown(pairs.vector_groups(t.vec, threshold=0.98, dim=64))


@query("g3_composite_groups", f"WITH RECURSIVE {ALL_PAIRS}, {leaders_sql('scored', 'g')} SELECT leader AS group_id, member AS member_id, false AS is_leader FROM g UNION ALL SELECT DISTINCT leader, leader, true FROM g")
def _(t):
    return composite.composite_groups(t.full)[0]


@query("g3_composite_headers", f"""WITH RECURSIVE {ALL_PAIRS}, {leaders_sql('scored', 'g')},
    f1 AS (SELECT leader, min(member) AS first, count(*) + 1 AS size FROM g GROUP BY leader)
    SELECT leader AS group_id, size, {q4('overall')} AS overall, {q4('least(1.0, 1.2 * overall)')} AS confidence,
    CASE WHEN t > 0.98 AND v > 0.8 AND c > 0.8 THEN 'retry_shots' WHEN t > 0.8 AND s > 0.8 THEN 'retry_shots' WHEN s > 0.7 AND t > 0.5 THEN 'angle_variations'
    WHEN c > 0.8 AND t > 0.3 THEN 'incremental_progress' ELSE 'redundant_documentation' END AS type FROM f1 JOIN scored ON a = leader AND b = first""")
def _(t):
    h = composite.composite_groups(t.full)[1]
    return h.select("group_id", "size", r4(F.col("overall")).alias("overall"), r4(F.col("confidence")).alias("confidence"), "type")


@query("g4_text_groups", f"WITH RECURSIVE {TEXT_EDGES}, {leaders_sql('te', 'g')} {long_form('te', 'g')}")
def _(t):
    return shown(pairs.text_groups(t.doc))


PLACE_EDGES = """places AS MATERIALIZED (SELECT id, 40 + (id % 331) * CAST(0.00007 AS DOUBLE) AS latitude, -74 + (id % 57) * CAST(0.00004 AS DOUBLE) AS longitude FROM v_doc),
    pe AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON a.id < b.id
        WHERE sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)) <= 0.0001)"""


@query("g5_place_groups", f"WITH RECURSIVE {PLACE_EDGES}, {leaders_sql('pe', 'g')} SELECT leader AS group_id, member AS member_id, false AS is_leader FROM g UNION ALL SELECT DISTINCT leader, leader, true FROM g")
def _(t):
    at = t.doc.select("id", (F.lit(40.0) + F.col("id") % 331 * F.lit(0.00007)).alias("latitude"), (F.lit(-74.0) + F.col("id") % 57 * F.lit(0.00004)).alias("longitude"))
    return composite.place_groups(at).drop("score")


@query("g5_photo_places", """SELECT leader AS group_id, id AS member_id, id = leader AS is_leader FROM (SELECT id, min(id) OVER (PARTITION BY latitude, longitude) AS leader,
    count(*) OVER (PARTITION BY latitude, longitude) AS n FROM v_photo) WHERE n > 1""")
def _(t):
    # the spots of the photos are 0.002 degrees apart, so groups are the shared positions
    return composite.place_groups(t.photo).drop("score")


# --- cascade -----------------------------------------------------------------------------------

EXACT = """ex AS MATERIALIZED (SELECT id AS member, leader FROM (SELECT id, min(id) OVER (PARTITION BY content_hash) AS leader, count(*) OVER (PARTITION BY content_hash) AS n FROM v_full) WHERE n > 1)"""


def _cascade_sql(hash_layer: bool, more: str = "", select: str = "") -> str:
    parts = [EXACT, "r1 AS MATERIALIZED (SELECT * FROM v_full WHERE id NOT IN (SELECT member FROM ex))"]
    rest, layers = "r1", ["SELECT 'exact' AS layer, leader AS group_id, member AS member_id, member = leader AS is_leader FROM ex"]
    if hash_layer:
        parts += [f"he AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, 1.0 - ({HCHARS}) / CAST(64 AS DOUBLE) AS score FROM r1 a JOIN r1 b ON a.id < b.id AND a.hash IS NOT NULL AND b.hash IS NOT NULL) WHERE score >= 0.85)",
                  leaders_sql("he", "hg"), "hm AS MATERIALIZED (SELECT member AS id FROM hg UNION SELECT leader FROM hg)",
                  "r2 AS MATERIALIZED (SELECT * FROM r1 WHERE id NOT IN (SELECT id FROM hm))"]
        layers += ["SELECT 'perceptual', leader, member, false FROM hg", "SELECT DISTINCT 'perceptual', leader, leader, true FROM hg"]
        rest = "r2"
    units = VEC_UNITS.format(f"{rest} WHERE features IS NOT NULL")
    parts += [units, f"ce AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, {UDOT} AS score FROM u a JOIN u b ON a.id < b.id) WHERE score >= 0.98)",
              "c9 AS MATERIALIZED (SELECT a, b FROM ce WHERE score >= 0.999)", leaders_sql("c9", "cg"),
              "cand AS MATERIALIZED (SELECT member AS id FROM cg UNION SELECT leader FROM cg)",
              "fe AS MATERIALIZED (SELECT * FROM ce WHERE a IN (SELECT id FROM cand) AND b IN (SELECT id FROM cand))", leaders_sql("fe", "fg")]
    layers += ["SELECT 'vector', leader, member, false FROM fg", "SELECT DISTINCT 'vector', leader, leader, true FROM fg"]
    parts += [more] if more else []
    return f"WITH RECURSIVE {', '.join(parts)} " + (select or " UNION ALL ".join(layers))


# without any candidate, the descriptions of all rows are grouped
TEXT_FALLBACK = f"""said AS MATERIALIZED (SELECT id, {TOK.format('description')} AS k FROM v_full WHERE NOT EXISTS (SELECT 1 FROM cand)),
    {shared_sql('said', 'k', 'sh')}, te AS MATERIALIZED (SELECT * FROM ({shared_score('said', 'sh')}) WHERE score >= 0.7), {leaders_sql('te', 'tg')}"""


@query("g8_cascade", _cascade_sql(True, TEXT_FALLBACK) + " UNION ALL SELECT 'text', leader, member, false FROM tg UNION ALL SELECT DISTINCT 'text', leader, leader, true FROM tg")
def _(t):
    return cascade.analyse(t.full, dim=64).members.drop("score")


@query("g8_cascade_without_hashes", _cascade_sql(False))
def _(t):
    return cascade.analyse(t.full, cascade.Layers(perceptual=False), dim=64).members.drop("score")


HEADERS = f"""sm AS (SELECT fg.leader, count(*) + 1 AS size, avg(fe.score) AS av, min(fg.member) AS first FROM fg JOIN fe ON fe.a = fg.leader AND fe.b = fg.member GROUP BY fg.leader),
    hp AS (SELECT sm.*, {MINUTES} AS m, {H} AS h, {SAME} AS same FROM sm JOIN v_full a ON a.id = sm.leader JOIN v_full b ON b.id = sm.first)"""
ONES = ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in (("overall", 1), ("visual", 1), ("content", 1), ("temporal", 0), ("spatial", 0), ("semantic", 1), ("confidence", 1)))


@query("g8_cascade_headers", _cascade_sql(False, HEADERS, f"""SELECT 'exact' AS layer, leader AS group_id, 'exact_duplicates' AS type, count(*) AS size, {ONES} FROM ex GROUP BY leader
    UNION ALL SELECT 'vector', leader, 'retry_shots', size, {q4('av')}, {q4('av')}, 1.0, {TEMPORAL}, {SPATIAL}, {q4('av')}, {q4('av')} FROM hp"""))
def _(t):
    h = cascade.analyse(t.full, cascade.Layers(perceptual=False), dim=64).headers
    names = ("overall", "visual", "content", "temporal", "spatial", "semantic", "confidence")
    return h.select("layer", "group_id", "type", "size", *[r4(F.col(c)).alias(c) for c in names])


METRICS = """SELECT layer, n_in, n_out, CAST(CASE WHEN n_in > 0 THEN floor((1.0 - n_out / CAST(n_in AS DOUBLE)) * 100 + 0.5) ELSE 0 END AS BIGINT) AS filtered_pct FROM (
    SELECT 'exact' AS layer, (SELECT count(*) FROM v_full) AS n_in, (SELECT count(DISTINCT leader) FROM ex) AS n_out
    UNION ALL SELECT 'perceptual', (SELECT count(*) FROM r1), (SELECT count(DISTINCT leader) FROM hg) WHERE (SELECT count(*) FROM r1) > 1
    UNION ALL SELECT 'vector candidates', (SELECT count(*) FROM r2), (SELECT count(*) FROM cand)
    UNION ALL SELECT 'metadata', (SELECT count(*) FROM cand), (SELECT count(*) FROM likely)
    UNION ALL SELECT 'text fallback', (SELECT count(*) FROM v_full), (SELECT count(DISTINCT leader) FROM tg) WHERE NOT EXISTS (SELECT 1 FROM cand)
    UNION ALL SELECT 'vector', (SELECT count(*) FROM cand), (SELECT count(DISTINCT leader) FROM fg) WHERE EXISTS (SELECT 1 FROM cand))"""
LIKELY = f"""cv AS MATERIALIZED (SELECT * FROM v_full WHERE id IN (SELECT id FROM cand)), lp AS (SELECT a.id AS x, b.id AS y FROM cv a JOIN cv b ON a.id < b.id WHERE {PERMISSIVE}),
    likely AS (SELECT x AS id FROM lp UNION SELECT y FROM lp)"""


@query("a14_layer_metrics", _cascade_sql(True, f"{TEXT_FALLBACK}, {LIKELY}", METRICS))
def _(t):
    return cascade.analyse(t.full, dim=64).metrics


@query("g9_set_operations", """SELECT 'minus' AS op, id FROM v_vec WHERE id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'union', id FROM (SELECT id FROM v_vec UNION SELECT doc_id FROM labels)
    UNION ALL SELECT 'both', id FROM v_vec WHERE id IN (SELECT doc_id FROM labels)""")
def _(t):
    a, b = t.vec.select("id"), t.table("labels").select(F.col("doc_id").alias("id"))
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "id")
    return tag("minus", a.join(b, "id", "left_anti")).unionByName(tag("union", a.union(b).distinct())).unionByName(tag("both", a.join(b, "id", "left_semi")))


@query("a1_exact_duplicates", """SELECT group_id, id AS member_id, id = group_id AS is_leader FROM (SELECT id, min(id) OVER (PARTITION BY content_hash) AS group_id,
    count(*) OVER (PARTITION BY content_hash) AS n FROM v_doc) WHERE n > 1""")
def _(t):
    return cascade.exact_groups(t.doc).drop("score")


@query("a11_group_summary", f"""WITH RECURSIVE {VEC_EDGES}, {leaders_sql('ve', 'g')} SELECT leader AS group_id, count(*) + 1 AS size, {q4('avg(e.score)')} AS similarity
    FROM g JOIN ve e ON e.a = leader AND e.b = member GROUP BY leader""")
def _(t):
    return grouping.summarise(pairs.vector_groups(t.vec, threshold=0.98, dim=64)).withColumn("similarity", r4(F.col("similarity")))


@query("j12_group_of", f"WITH RECURSIVE {VEC_EDGES}, {leaders_sql('ve', 'g')} SELECT v.id AS member_id, coalesce(g.leader, l.leader) AS group_id FROM v_vec v LEFT JOIN g ON g.member = v.id LEFT JOIN (SELECT DISTINCT leader FROM g) l ON l.leader = v.id")
def _(t):
    return pairs.group_of(pairs.vector_groups(t.vec, threshold=0.98, dim=64), t.vec)
