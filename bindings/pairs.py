"""Similarity pair joins, search and look-ups. Oracles compare every pair of distinct contents."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import activity, cells, composite, pairs

from .registry import TOK, q4, query, r4
from .scalars import CONTENT, FULL, H, MINUTES, OVERALL, SAME, SPATIAL, TEMPORAL, TERMS, jac

# Constant 64-term sum: much faster than a list fold over all pairs.
UDOT = " + ".join(f"a.u[{i}] * b.u[{i}]" for i in range(1, 65))
UNITS = ("u AS MATERIALIZED (SELECT min(id) AS id, u FROM (SELECT id, list_transform(features, lambda x: x / n) AS u FROM "
         "(SELECT *, sqrt(list_sum(list_transform(features, lambda x: x * x))) AS n FROM v_vec)) GROUP BY u)")
HCHARS = " + ".join(f"CASE WHEN substr(a.hash, {i}, 1) <> substr(b.hash, {i}, 1) THEN 1 ELSE 0 END" for i in range(1, 17))
HASHES = "h AS MATERIALIZED (SELECT min(id) AS id, hash FROM v_hash GROUP BY hash)"
SETS = f"s AS MATERIALIZED (SELECT min(id) AS id, k FROM (SELECT id, list_sort({TOK.format('description')}) AS k FROM v_doc) WHERE len(k) > 0 GROUP BY k)"


def shared_sql(sets: str, items: str, out: str) -> str:
    """Shared items of all pairs of ``sets(id, items)``, counted over an exploded table: as complete as
    comparing all lists, but quick. Pairs that share nothing are left out."""
    return f"""{out}_i AS MATERIALIZED (SELECT id, unnest({items}) AS x FROM {sets}),
        {out} AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) AS n, count(*) FILTER (list_contains({TERMS}, x)) AS nt
            FROM {out}_i a JOIN {out}_i b USING (x) WHERE a.id < b.id GROUP BY 1, 2)"""


def shared_score(sets: str, shared: str, items: str = "k") -> str:
    """``(a, b, score)`` token similarity from the counts."""
    nt = f"len(list_intersect({items}, {TERMS}))"
    return f"""SELECT p.a, p.b, least(1.0, p.n / CAST(x.n + y.n - p.n AS DOUBLE) + CASE WHEN p.nt = 0 THEN 0.0 ELSE 0.3 * p.nt / CAST(greatest(x.nt, y.nt) AS DOUBLE) END) AS score
        FROM {shared} p JOIN (SELECT id, len({items}) AS n, {nt} AS nt FROM {sets}) x ON x.id = p.a JOIN (SELECT id, len({items}) AS n, {nt} AS nt FROM {sets}) y ON y.id = p.b"""


TEXT_PAIRS = f"{shared_sql('s', 'k', 'sh')}, tp AS MATERIALIZED ({shared_score('s', 'sh')})"


@query("j6_hash_pairs", f"WITH {HASHES} SELECT * FROM (SELECT a.id AS id_a, b.id AS id_b, {q4(f'1.0 - ({HCHARS}) / 64.0')} AS score, {HCHARS} AS d FROM h a JOIN h b ON a.id < b.id) WHERE d <= 9"
       .replace("SELECT * FROM (", "SELECT id_a, id_b, score FROM (", 1))
def _(t):
    return pairs.hash_pairs(t.hash).withColumn("score", r4(F.col("score")))


@query("j7_vector_pairs", f"WITH {UNITS} SELECT id_a, id_b, {q4('v')} AS score FROM (SELECT a.id AS id_a, b.id AS id_b, {UDOT} AS v FROM u a JOIN u b ON a.id < b.id) WHERE v >= 0.98")
def _(t):
    return pairs.vector_pairs(t.vec, dim=64).withColumn("score", r4(F.col("score")))


# The bands that the threshold and a recall of 0.95 ask for, and the library's hyperplanes as fixed numbers.
RECALL, ROWS = 0.95, 10_000
BITS, BANDS = cells.choose_bands(0.98, RECALL, ROWS)
PLANES = ", ".join(f"({band}, {bit}, {plane.tolist()})" for band, planes in enumerate(cells.hyperplanes(BITS, BANDS, 64)) for bit, plane in enumerate(planes))


@query("j7_vector_pairs_approximate", f"""WITH {UNITS}, planes(band, bit, plane) AS (VALUES {PLANES}),
    s AS MATERIALIZED (SELECT id, band, sum(CASE WHEN list_inner_product(u, CAST(plane AS DOUBLE[])) >= 0 THEN 1 << bit ELSE 0 END) AS bits FROM u, planes GROUP BY 1, 2),
    met AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM s a JOIN s b USING (band, bits) WHERE a.id < b.id)
    SELECT a AS id_a, b AS id_b, {q4('v')} AS score FROM (SELECT a.id AS a, b.id AS b, {UDOT} AS v FROM met JOIN u a ON a.id = met.a JOIN u b ON b.id = met.b) WHERE v >= 0.98""")
def _(t):
    return pairs.vector_pairs_approximate(t.vec, dim=64, recall=RECALL, rows=ROWS).withColumn("score", r4(F.col("score")))


AGREE = [" + ".join(f"CASE WHEN substr(a.hash, {i}, 1) = substr(b.hash, {i}, 1) THEN 1 ELSE 0 END" for i in half) for half in (range(1, 9), range(9, 17))]
SAVED = """SELECT layer, total, compared, total * (total - 1) // 2 AS all_pairs, CAST(CASE WHEN total > 1 THEN floor((1.0 - compared / CAST(total * (total - 1) // 2 AS DOUBLE)) * 100 + 0.5) ELSE 0 END AS BIGINT) AS saved_pct FROM c"""


# 7 of 16 characters agree in a pair at the threshold, so 4 in one half: those pairs are compared
@query("a14_pair_savings", f"""WITH {HASHES}, {UNITS}, planes(band, bit, plane) AS (VALUES {PLANES}),
    s AS MATERIALIZED (SELECT id, band, sum(CASE WHEN list_inner_product(u, CAST(plane AS DOUBLE[])) >= 0 THEN 1 << bit ELSE 0 END) AS bits FROM u, planes GROUP BY 1, 2),
    c AS (SELECT 'hash' AS layer, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h a JOIN h b ON a.id < b.id WHERE {AGREE[0]} >= 4 OR {AGREE[1]} >= 4) AS compared
        UNION ALL SELECT 'vector', (SELECT count(*) FROM u), (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM s GROUP BY band, bits)))
    {SAVED}""")
def _(t):
    blocked, _ = pairs.blocked_hashes(t.hash, hot=1 << 40)
    counts = blocked.compared().select(F.lit("hash").alias("layer"), "total", "compared").unionByName(
        pairs.band_comparisons(t.vec, dim=64, recall=RECALL, rows=ROWS).select(F.lit("vector").alias("layer"), "total", "compared"))
    return activity.pair_savings(counts)


@query("j8_text_pairs", f"WITH {SETS}, {TEXT_PAIRS} SELECT a AS id_a, b AS id_b, {q4('score')} AS score FROM tp WHERE score >= 0.7")
def _(t):
    return pairs.text_pairs(t.doc).withColumn("score", r4(F.col("score")))


@query("j9_top_k_filtered", f"""WITH n AS MATERIALIZED (SELECT id, label, list_transform(features, lambda x: x / sqrt(list_sum(list_transform(features, lambda y: y * y)))) AS u FROM v_vec),
    q AS (SELECT label, min(id) AS id FROM n GROUP BY label), qq AS (SELECT n.* FROM n JOIN q USING (label, id))
    SELECT query_id, id, {q4('v')} AS score, rank FROM (SELECT a.id AS query_id, b.id, {UDOT} AS v, row_number() OVER (PARTITION BY a.id ORDER BY {UDOT} DESC, b.id) AS rank
    FROM qq a JOIN n b ON a.label = b.label) WHERE rank <= 20""")
def _(t):
    q = t.vec.groupBy("label").agg(F.min_by(F.struct("id", "features"), "id").alias("q")).select("label", F.col("q.id").alias("query_id"), F.col("q.features").alias("query"))
    out = pairs.top_k(t.vec, q, 20, filter_col="label")
    return out.select("query_id", "id", r4(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


TOP = f"""WITH n AS MATERIALIZED (SELECT id, list_transform(features, lambda x: x / sqrt(list_sum(list_transform(features, lambda y: y * y)))) AS u FROM v_vec)
    SELECT query_id, id, {q4('v')} AS score, rank FROM (SELECT a.id AS query_id, b.id, {UDOT} AS v, row_number() OVER (PARTITION BY a.id ORDER BY {UDOT} DESC, b.id) AS rank
    FROM n a JOIN n b ON a.id % 100 = 0) WHERE rank <= """


def _top(t, k):
    q = t.vec.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("features").alias("query"))
    out = pairs.top_k(t.vec, q, k)
    return out.select("query_id", "id", r4(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("j9_top_k", f"{TOP} 20")
def _(t):
    return _top(t, 20)


@query("j9_top_k_hundredth", f"{TOP} 5")
def _(t):
    return _top(t, 5)


@query("j12_pair_score", f"""WITH {UNITS}, p AS (SELECT a.id AS x, b.id AS y, {UDOT} AS v FROM u a JOIN u b ON a.id < b.id)
    SELECT e.id + 1000000 AS id_a, e.id AS id_b, CASE WHEN v >= 0.98 THEN {q4('v')} END AS score FROM v_vec e LEFT JOIN p ON p.x = e.id AND p.y = e.id + 1000000 WHERE e.id < 1000000""")
def _(t):
    wanted = t.vec.filter("id < 1000000").select((F.col("id") + 1_000_000).alias("id_a"), F.col("id").alias("id_b"))
    return pairs.pair_score(pairs.vector_pairs(t.vec, dim=64), wanted).withColumn("score", r4(F.col("score")))


TAGS = f"0.7 * {jac('a.tags', 'b.tags')}"
ALL_PAIRS = f"""{FULL}, {shared_sql('f', 'k', 'sh')}, tp AS MATERIALIZED ({shared_score('f', 'sh')}), {shared_sql('f', 'w', 'sw')},
    p AS (SELECT a.id AS a, b.id AS b, coalesce(tp.score, 0.0) AS v, {CONTENT} AS c, {TAGS} + 0.3 * CASE WHEN sw.n IS NULL THEN 0.0 ELSE sw.n / CAST(len(a.w) + len(b.w) - sw.n AS DOUBLE) END AS m,
        {MINUTES} AS m_, {H} AS h, {SAME} AS same FROM f a JOIN f b ON a.id < b.id LEFT JOIN tp ON tp.a = a.id AND tp.b = b.id LEFT JOIN sw ON sw.a = a.id AND sw.b = b.id),
    sc AS (SELECT a, b, v, c, m, {TEMPORAL.replace('m <', 'm_ <').replace('m =', 'm_ =')} AS t, {SPATIAL} AS s FROM p),
    scored AS MATERIALIZED (SELECT *, {OVERALL} AS overall FROM sc WHERE {OVERALL} >= 0.4)"""


@query("fn9_composite_pairs", f"WITH {ALL_PAIRS} SELECT a AS id_a, b AS id_b, {q4('v')} AS visual, {q4('overall')} AS overall FROM scored")
def _(t):
    p = composite.composite_pairs(t.full)
    return p.select("id_a", "id_b", r4(F.col("visual")).alias("visual"), r4(F.col("overall")).alias("overall"))
