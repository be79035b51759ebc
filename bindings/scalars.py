"""Scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepsake import functions as K

from .registry import EVENTS_NOW, TOK, joined, q4, query, r4

# Every record with the next one: as many pairs as records.
PHOTO_PAIRS = "FROM v_photo a JOIN v_photo b ON b.id = a.id + 1"
TEMPORAL = """CAST(CASE WHEN m = 0 THEN 1.0 WHEN m < 1 THEN 0.98 WHEN m < 5 THEN 0.95 WHEN m < 15 THEN 0.85
    WHEN m < 60 THEN 0.6 WHEN m < 240 THEN 0.3 WHEN m < 1440 THEN 0.1 ELSE 0.05 END AS DOUBLE)"""
MINUTES = "abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) / 6e7"
HAVERSINE = """2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))"""
H = """pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude))
    * pow(sin(radians(b.longitude - a.longitude) / 2), 2)"""
SPATIAL = f"""CAST(CASE WHEN same THEN 1.0 WHEN {HAVERSINE} < 0.01 THEN 0.98 WHEN {HAVERSINE} < 0.05 THEN 0.92
    WHEN {HAVERSINE} < 0.1 THEN 0.6 WHEN {HAVERSINE} < 0.5 THEN 0.4 WHEN {HAVERSINE} < 1.0 THEN 0.2 ELSE 0.0 END AS DOUBLE)"""
SAME = "(a.latitude = b.latitude AND a.longitude = b.longitude)"
CONTENT = """0.6 * CASE WHEN a.project_id = b.project_id THEN 1.0 ELSE 0.0 END
    + 0.4 * CASE WHEN a.creator_id = b.creator_id THEN 0.8 ELSE 0.3 END"""
TERMS = """['roof','roofing','electrical','plumbing','hvac','framing','drywall','flooring','concrete','foundation',
    'insulation','wiring','pipes','ductwork','shingles','siding','windows','doors','fixtures','installation','repair',
    'inspection','progress','completion']"""


def jac(a: str, b: str) -> str:
    return (f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END")


def boost(a: str, b: str) -> str:
    ta, tb = f"list_intersect({a}, {TERMS})", f"list_intersect({b}, {TERMS})"
    return (f"CASE WHEN greatest(len({ta}), len({tb})) = 0 THEN 0.0 ELSE "
            f"0.3 * len(list_intersect({ta}, {tb})) / CAST(greatest(len({ta}), len({tb})) AS DOUBLE) END")


def toksim(a: str, b: str) -> str:
    return f"least(1.0, CAST({jac(a, b)} AS DOUBLE) + {boost(a, b)})"


WORDS = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda w: length(w) > 3))"


def _pairs(df, step=1):
    left = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])
    right = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    return left.join(right, F.col("b_id") == F.col("a_id") + step)


def _ab(*names):
    return [F.col(f"{p}_{n}") for p in "ab" for n in names]


@query("fn1_temporal_proximity", f"SELECT id, {TEMPORAL} AS score FROM (SELECT a.id, {MINUTES} AS m {PHOTO_PAIRS})")
def _(t):
    return _pairs(t.photo).select(F.col("a_id").alias("id"), K.temporal_proximity(*_ab("captured_at")).alias("score"))


@query("fn2_haversine_km", f"SELECT id, {q4(HAVERSINE)} AS km FROM (SELECT a.id, {H} AS h {PHOTO_PAIRS})")
def _(t):
    return _pairs(t.photo).select(F.col("a_id").alias("id"), r4(K.haversine_km(*_ab("latitude", "longitude"))).alias("km"))


@query("fn3_spatial_proximity",
       f"SELECT id, {SPATIAL} AS score FROM (SELECT a.id, {H} AS h, {SAME} AS same {PHOTO_PAIRS})")
def _(t):
    return _pairs(t.photo).select(F.col("a_id").alias("id"), K.spatial_proximity(*_ab("latitude", "longitude")).alias("score"))


@query("fn4_content_similarity", f"SELECT a.id, {q4(CONTENT)} AS score {PHOTO_PAIRS}")
def _(t):
    a, b, c, d = (F.col(x) for x in ("a_project_id", "b_project_id", "a_creator_id", "b_creator_id"))
    return _pairs(t.photo).select(F.col("a_id").alias("id"), r4(K.content_similarity(a, b, c, d)).alias("score"))


@query("fn5_tokens", f"SELECT id, len(k) AS n, coalesce(array_to_string(list_sort(k), ','), '') AS tokens "
                     f"FROM (SELECT id, {TOK.format('description')} AS k FROM v_doc)")
def _(t):
    k = F.array_sort(K.tokens(F.col("description")))
    return t.doc.select("id", F.size(k).alias("n"), joined(k).alias("tokens"))


DOC_PAIRS = "FROM d a JOIN d b ON b.id = a.id + 1"
DOCS = f"d AS MATERIALIZED (SELECT *, {TOK.format('description')} AS k, {WORDS.format('description')} AS w FROM v_doc)"


@query("fn6_jaccard", f"WITH {DOCS} SELECT a.id, {q4(jac('a.k', 'b.k'))} AS score {DOC_PAIRS}")
def _(t):
    df = _pairs(t.doc.withColumn("k", K.tokens(F.col("description"))).select("id", "k"))
    return df.select(F.col("a_id").alias("id"), r4(K.jaccard(F.col("a_k"), F.col("b_k"))).alias("score"))


@query("fn7_description_similarity", f"WITH {DOCS} SELECT a.id, {q4(toksim('a.k', 'b.k'))} AS score {DOC_PAIRS}")
def _(t):
    return _pairs(t.doc.select("id", "description")).select(
        F.col("a_id").alias("id"), r4(K.description_similarity(*_ab("description"))).alias("score"))


SEMANTIC = f"0.7 * {jac('a.tags', 'b.tags')} + 0.3 * {jac('a.w', 'b.w')}"


@query("fn8_semantic_overlap", f"WITH {DOCS} SELECT a.id, {q4(SEMANTIC)} AS score {DOC_PAIRS}")
def _(t):
    df = _pairs(t.doc.withColumn("w", K.words(F.col("description"))).select("id", "tags", "w"))
    return df.select(F.col("a_id").alias("id"), r4(K.semantic_overlap(*_ab("tags")[:1], F.col("b_tags"), F.col("a_w"), F.col("b_w"))).alias("score"))


FULL = f"f AS MATERIALIZED (SELECT *, {TOK.format('description')} AS k, {WORDS.format('description')} AS w FROM v_full)"
PARTS = f"""p AS (SELECT a.id, {toksim('a.k', 'b.k')} AS v, {CONTENT} AS c, {SEMANTIC} AS m, {MINUTES} AS m_, {H} AS h, {SAME} AS same
    FROM f a JOIN f b ON b.id = a.id + 1),
    s AS (SELECT id, v, c, m, {TEMPORAL.replace('m <', 'm_ <').replace('m =', 'm_ =')} AS t, {SPATIAL} AS s FROM p)"""
OVERALL = "CASE WHEN t > 0.95 AND c > 0.8 THEN 0.7*v + 0.2*t + 0.1*c ELSE 0.4*v + 0.2*c + 0.15*t + 0.15*s + 0.1*m END"


def _scored(t, **kw):
    df = K.prepare(t.full.select("id", "captured_at", "latitude", "longitude", "project_id", "creator_id", "description", "tags"))
    return _pairs(df).select(F.col("a_id").alias("id"), K.photo_similarity("a_", "b_", **kw).alias("s"))


@query("fn9_overall_similarity", f"WITH {FULL}, {PARTS} SELECT id, {q4('v')} AS visual, {q4('c')} AS content, t AS temporal, "
                                 f"s AS spatial, {q4('m')} AS semantic, {q4(OVERALL)} AS overall FROM s")
def _(t):
    names = ["visual", "content", "temporal", "spatial", "semantic", "overall"]
    return _scored(t).select("id", *[r4(F.col(f"s.{n}")).alias(n) for n in names])


@query("fn10_scored_similarity",
       f"WITH {FULL}, {PARTS} SELECT id, {q4('0.5*((id % 10) / 10.0) + 0.2*c + 0.1*t + 0.1*s + 0.1*m')} AS overall, "
       f"{q4('0.4*t + 0.6*s')} AS fallback FROM s")
def _(t):
    given = F.col("a_id") % 10 / 10.0
    df = _scored(t, visual=given, scored=True)
    fallback = K.visual_fallback(F.col("s.temporal"), F.col("s.spatial"))
    return df.select("id", r4(F.col("s.overall")).alias("overall"), r4(fallback).alias("fallback"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"
VEC_PAIRS = "FROM v_vec a JOIN v_vec b ON b.id = a.id + 1"
COS = f"{DOT.format('a.features', 'b.features')} / sqrt({DOT.format('a.features', 'a.features')}) / sqrt({DOT.format('b.features', 'b.features')})"


@query("fn11_vector_stage_overall", f"""WITH p AS (SELECT a.id, {COS} AS v, {MINUTES} AS m, {H} AS h, {SAME} AS same
    FROM v_full a JOIN v_full b ON b.id = a.id + 1 WHERE a.features IS NOT NULL AND b.features IS NOT NULL),
    s AS (SELECT id, v, {TEMPORAL} AS t, {SPATIAL} AS s FROM p)
    SELECT id, {q4('0.8*v + 0.1*t + 0.1*s')} AS overall FROM s""")
def _(t):
    df = _pairs(t.full.filter(F.col("features").isNotNull()).select("id", "captured_at", "latitude", "longitude", "features"))
    v = K.cosine(F.col("a_features"), F.col("b_features"))
    overall = K.vector_stage_overall(v, K.temporal_proximity(*_ab("captured_at")), K.spatial_proximity(*_ab("latitude", "longitude")))
    return df.select(F.col("a_id").alias("id"), r4(overall).alias("overall"))


EPS = (f"greatest(-1.0, least(1.0, {DOT.format('a.features', 'b.features')} / sqrt({DOT.format('a.features', 'a.features')} + 1e-8)"
       f" / sqrt({DOT.format('b.features', 'b.features')} + 1e-8)))")


@query("fn12_cosine", f"SELECT a.id, {q4(COS)} AS guarded, {q4(EPS)} AS epsilon, {q4(COS)} AS plain {VEC_PAIRS}")
def _(t):
    a, b = F.col("a_features"), F.col("b_features")
    return _pairs(t.vec.select("id", "features")).select(
        F.col("a_id").alias("id"), *[r4(K.cosine(a, b, variant=v)).alias(v) for v in ("guarded", "epsilon", "plain")])


NORM = f"sqrt({DOT.format('features', 'features')})"


@query("fn13_l2_normalise", f"SELECT id, {q4('features[1] / ' + NORM)} AS first, {q4('features[64] / ' + NORM)} AS last, "
                            f"{q4('list_sum(list_transform(features, lambda x: x / n))')} AS total FROM (SELECT *, {NORM} AS n FROM v_vec)")
def _(t):
    df = t.vec.select("id", K.l2_normalise(F.col("features")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x)
    return df.select("id", r4(F.col("u")[0]).alias("first"), r4(F.col("u")[63]).alias("last"), r4(total).alias("total"))


@query("fn14_vector_stats", f"""SELECT id, {q4('mu')} AS mean, {q4('list_sum(list_transform(features, lambda x: (x - mu) * (x - mu))) / 64')} AS variance,
    {q4('list_min(features)')} AS min, {q4('list_max(features)')} AS max, {q4(NORM)} AS norm
    FROM (SELECT *, list_sum(features) / 64 AS mu FROM v_vec)""")
def _(t):
    df = t.vec.select("id", K.vector_stats(F.col("features")).alias("s"))
    return df.select("id", *[r4(F.col(f"s.{n}")).alias(n) for n in ("mean", "variance", "min", "max", "norm")])


HAM = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN substr(a.hash, i, 1) <> substr(b.hash, i, 1) THEN 1 ELSE 0 END))"
BITS = ("list_sum(list_transform(range(1, 17), lambda i: bit_count(xor(CAST(strpos('0123456789abcdef', substr(a.hash, i, 1)) - 1 AS INTEGER), "
        "CAST(strpos('0123456789abcdef', substr(b.hash, i, 1)) - 1 AS INTEGER)))))")


@query("fn15_hash_similarity", f"""SELECT a.id, CAST({HAM} AS BIGINT) AS chars, CAST({BITS} AS BIGINT) AS bits,
    {q4('1.0 - ' + HAM + ' / 64.0')} AS by_char, {q4('1.0 - ' + BITS + ' / 64.0')} AS by_bit
    FROM v_hash a JOIN v_hash b ON b.id = a.id + 1""")
def _(t):
    a, b = F.col("a_hash"), F.col("b_hash")
    return _pairs(t.hash).select(F.col("a_id").alias("id"), K.hamming(a, b).alias("chars"), K.hamming(a, b, "bit").alias("bits"),
                                 r4(K.hash_similarity(a, b)).alias("by_char"), r4(K.hash_similarity(a, b, "bit")).alias("by_bit"))


@query("fn16_difference_hash", "SELECT id, hash FROM v_hash")
def _(t):
    return t.hash


def _pixels(features):
    return F.transform(features, lambda x: F.floor((x + 1) * 127.5))


PIX = "list_transform(features, lambda x: floor((x + 1) * 127.5))"


@query("fn17_grey", f"SELECT id, CAST(floor(p[1] * 0.299 + p[2] * 0.587 + p[3] * 0.114 + 0.5) AS BIGINT) AS grey FROM (SELECT id, {PIX} AS p FROM v_vec)")
def _(t):
    p = t.vec.select("id", _pixels("features").alias("p"))
    return p.select("id", K.grey(F.col("p")[0], F.col("p")[1], F.col("p")[2]).alias("grey"))


HIST = ("list_transform(range(0, 48), lambda k: CAST(len(list_filter(list_slice(p, 1 + (k // 16) * 20, 20 + (k // 16) * 20), "
        "lambda x: CAST(floor(x / 16.0) AS INTEGER) = k % 16)) AS DOUBLE) / 20)")
CHI = ("list_sum(list_transform(range(1, 49), lambda i: CASE WHEN a.h[i] + b.h[i] > 0 THEN "
       "(a.h[i] - b.h[i]) * (a.h[i] - b.h[i]) / (a.h[i] + b.h[i]) ELSE 0.0 END)) / 2")
HISTS = f"h AS MATERIALIZED (SELECT id, features, {HIST} AS h FROM (SELECT *, {PIX} AS p FROM v_vec))"


def _histograms(t):
    p = t.vec.withColumn("p", _pixels("features"))
    part = lambda k: F.slice("p", 1 + 20 * k, 20)
    return p.select("id", "features", K.rgb_histogram(part(0), part(1), part(2)).alias("h"))


@query("fn18_rgb_histogram", f"WITH {HISTS} SELECT id, array_to_string(list_transform(h, lambda x: CAST(CAST(x * 20 + 0.5 AS INTEGER) AS VARCHAR)), ',') AS counts FROM h"
       .replace("x * 20 + 0.5", "round(x * 20)"))
def _(t):
    return _histograms(t).select("id", joined(F.transform("h", lambda x: F.round(x * 20).cast("int"))).alias("counts"))


@query("fn19_chi_squared", f"WITH {HISTS} SELECT a.id, {q4(CHI)} AS distance FROM h a JOIN h b ON b.id = a.id + 1")
def _(t):
    return _pairs(_histograms(t)).select(F.col("a_id").alias("id"), r4(K.chi_squared(F.col("a_h"), F.col("b_h"))).alias("distance"))


EDGE = "CASE WHEN {0}.id % 3 = 0 THEN NULL ELSE list_slice({0}.features, 1, 8) END"
COS8 = ("list_sum(list_transform(range(1, 9), lambda i: a.features[i] * b.features[i])) / sqrt(list_sum(list_transform(range(1, 9), lambda i: a.features[i] * a.features[i])))"
        " / sqrt(list_sum(list_transform(range(1, 9), lambda i: b.features[i] * b.features[i])))")


@query("fn20_combined_similarity", f"""WITH {HISTS} SELECT id, {q4('CASE WHEN edge THEN (0.3*v + 0.4*(1 - chi) + 0.3*e) / (0.3 + 0.4 + 0.3) ELSE (0.3*v + 0.4*(1 - chi)) / (0.3 + 0.4) END')} AS score
    FROM (SELECT a.id, {COS} AS v, {CHI} AS chi, {COS8} AS e, a.id % 3 <> 0 AND b.id % 3 <> 0 AS edge FROM h a JOIN h b ON b.id = a.id + 1)""")
def _(t):
    h = _histograms(t).withColumn("edge", F.when(F.col("id") % 3 != 0, F.slice("features", 1, 8)))
    pair = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    return _pairs(h).select(F.col("a_id").alias("id"), r4(K.combined_similarity(pair("features"), pair("h"), pair("edge"))).alias("score"))


INFO = "least(1.0, (0.05 * len(string_split(description, ' ')) + 0.1 * len(tags)) / 2 + 0.3)"
DOCUMENTATION = f"least(1.0, 0.7 * {INFO} + CASE WHEN has_coordinates THEN 0.1 ELSE 0 END + CASE WHEN length(description) > 10 THEN 0.1 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 0.1 ELSE 0 END)"


@query("fn21_quality", f"SELECT id, {q4(INFO)} AS information, {q4(DOCUMENTATION)} AS documentation, CAST(0.6 AS DOUBLE) AS sharpness FROM v_doc")
def _(t):
    q = K.quality(F.col("description"), F.col("tags"), F.col("has_coordinates"))
    return t.doc.select("id", q.alias("q")).select("id", r4(F.col("q.information")).alias("information"),
                                                   r4(F.col("q.documentation")).alias("documentation"), r4(F.col("q.sharpness")).alias("sharpness"))


@query("fn22_fallback_quality", f"SELECT id, {q4('least(1.0, 0.6 + CASE WHEN length(creator_id || content_hash) > 68 THEN 0.05 ELSE 0 END + CASE WHEN has_coordinates THEN 0.05 ELSE 0 END)')} AS quality FROM v_doc"
       .replace("length(creator_id || content_hash) > 68", "length(CASE WHEN id % 3 = 0 THEN creator_id ELSE content_hash END) > 20"))
def _(t):
    h = F.when(F.col("id") % 3 == 0, F.col("creator_id")).otherwise(F.col("content_hash"))
    return t.doc.select("id", r4(K.fallback_quality(h, F.col("has_coordinates"))).alias("quality"))


@query("fn23_content_hash", "SELECT id, content_hash AS hash FROM v_doc")
def _(t):
    return t.doc.select("id", K.content_hash(F.col("description")).alias("hash"))


MB = "floor(CAST(width AS DOUBLE) * height * 3 / 10 / 1048576.0 * 100 + 0.5) / 100"


@query("fn24_estimated_mb", f"SELECT id, {MB} AS mb FROM v_tag")
def _(t):
    return t.tag.select("id", K.estimated_mb(F.col("width"), F.col("height")).alias("mb"))


@query("fn25_time_saved", """SELECT content_hash, CASE WHEN n - 1 = 0 THEN 0.0 ELSE floor((n - 1) * 0.5 * 10 + 0.5) / 10 END AS minutes
    FROM (SELECT content_hash, count(*) AS n FROM v_doc GROUP BY 1)""")
def _(t):
    return t.doc.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).select(
        "content_hash", K.time_saved_minutes(F.col("n"), F.lit(1)).alias("minutes"))


@query("fn26_group_type", f"""WITH {FULL}, {PARTS} SELECT id, CASE WHEN t > 0.98 AND v > 0.8 AND c > 0.8 THEN 'retry_shots'
    WHEN t > 0.8 AND s > 0.8 THEN 'retry_shots' WHEN s > 0.7 AND t > 0.5 THEN 'angle_variations'
    WHEN c > 0.8 AND t > 0.3 THEN 'incremental_progress' ELSE 'redundant_documentation' END AS type FROM s""")
def _(t):
    s = _scored(t)
    return s.select("id", K.group_type(*[F.col(f"s.{n}") for n in ("temporal", "spatial", "content", "visual")]).alias("type"))


@query("fn27_confidence_level", f"SELECT id, CASE WHEN v > 0.85 THEN 'high' WHEN v > 0.7 THEN 'medium' ELSE 'low' END AS level FROM (SELECT a.id, {COS} AS v FROM v_vec a JOIN v_vec b ON b.id = a.id + 1000000)")
def _(t):
    return _pairs(t.vec, 1_000_000).select(F.col("a_id").alias("id"), K.confidence_level(
        K.cosine(F.col("a_features"), F.col("b_features"))).alias("level"))


def _has(lst, word):
    return f"list_contains({lst}, '{word}')"


_NEW = lambda ws: " + ".join(f"CASE WHEN {_has('y', w)} AND NOT {_has('x', w)} THEN 1 ELSE 0 END" for w in ws)
JARGON_SQL = " OR ".join(f"({_has('x', w)} AND NOT {_has('y', w)})" for w in ["api", "endpoint", "implementation", "function", "method", "interface"])
CONTEXT_SQL = " OR ".join(f"({_has('y', w)} AND NOT {_has('x', w)})" for w in ["specifically", "for example", "such as", "including"])
CASUAL_SQL, FORMAL_SQL = _NEW(["hey", "yeah", "stuff", "things", "got"]), _NEW(["greetings", "indeed", "items", "elements", "obtained"])
PATTERNS = f"""list_filter([CASE WHEN length(edited) < 0.7 * length(original) THEN 'shortened response' END,
    CASE WHEN length(edited) > 1.3 * length(original) THEN 'expanded response' END,
    CASE WHEN {JARGON_SQL} THEN 'removed technical jargon' END, CASE WHEN {CONTEXT_SQL} THEN 'added specific examples' END,
    CASE WHEN ({CASUAL_SQL}) > ({FORMAL_SQL}) THEN 'made more conversational' END,
    CASE WHEN ({FORMAL_SQL}) > ({CASUAL_SQL}) THEN 'made more formal' END], lambda z: z IS NOT NULL)"""
EDITS = rf"""e AS MATERIALIZED (SELECT *, regexp_split_to_array(lower(original), '\s+') AS x, regexp_split_to_array(lower(edited), '\s+') AS y FROM v_edit),
    ep AS MATERIALIZED (SELECT *, {PATTERNS} AS patterns FROM e)"""


@query("fn28_edit_patterns", f"WITH {EDITS} SELECT conv_id, turn, array_to_string(patterns, ',') AS patterns FROM ep")
def _(t):
    return t.edit.select("conv_id", "turn", joined(K.edit_patterns(F.col("original"), F.col("edited"))).alias("patterns"))


@query("fn29_reading_minutes", r"SELECT id, CAST(greatest(1, ceil(len(regexp_split_to_array(regexp_replace(description, '^\s+|\s+$', '', 'g'), '\s+')) / 200.0)) AS BIGINT) AS minutes FROM v_doc")
def _(t):
    return t.doc.select("id", K.reading_minutes(F.col("description")).alias("minutes"))


@query("fn30_front_matter", """SELECT id, CASE WHEN id % 2 = 0 THEN 'Doc ' || id || ': part' END AS title,
    CASE WHEN id % 2 = 0 THEN creator_id END AS author, CASE WHEN id % 2 = 0 THEN 'a, b' END AS tags,
    CASE WHEN id % 2 = 0 THEN 4 ELSE 0 END AS n FROM v_doc""")
def _(t):
    header = F.concat(F.lit("---\ntitle: \"Doc "), "id", F.lit(": part\"\nauthor: "), "creator_id",
                      F.lit("\nignored: x\ndate: '2024-01-05'\ntags: a, b\n---\n"), "description")
    text = F.when(F.col("id") % 2 == 0, header).otherwise(F.concat(F.lit("plain "), "description"))
    df = t.doc.select("id", K.front_matter(text).alias("m"))
    return df.select("id", F.col("m")["title"].alias("title"), F.col("m")["author"].alias("author"),
                     F.col("m")["tags"].alias("tags"), F.size("m").alias("n"))


# the lines of the texts, and what a reader finds in them, walked in SQL
MD = r"""src AS (SELECT id, creator_id, CASE WHEN id % 2 = 0 THEN '# Doc ' || id || chr(10) || chr(10) || '*Published by ' || creator_id || ' by hand • '
        || CASE WHEN id % 4 = 0 THEN 'January 5, 2024' ELSE '' END || ' • 5 min read*' || chr(10) || chr(10) || CASE WHEN id % 3 = 0 THEN '## Overview' || chr(10) ELSE '' END || description ELSE description END AS text FROM v_doc),
    md AS (SELECT id, text, string_split(/*header*/text, chr(10)) AS lines FROM src),
    found AS (SELECT id, text, lines, list_filter(lines, lambda x: starts_with(x, '# '))[1] AS h,
        list_transform(string_split(replace(list_filter(lines, lambda x: starts_with(x, '*') AND contains(x, '•'))[1], '*', ''), '•'), lambda x: trim(x)) AS parts,
        coalesce(list_position(list_transform(lines, lambda x: contains(lower(x), '## overview')), true), 0) AS o,
        coalesce(list_position(list_transform(lines, lambda x: starts_with(x, '# ')), true), 0) AS a FROM md),
    picked AS (SELECT *, list_filter(lines[o + 1:], lambda x: length(trim(x)) > 0 AND NOT starts_with(x, '#') AND NOT starts_with(x, '*') AND NOT starts_with(x, '-'))[1] AS p,
        CASE WHEN a > 0 THEN list_filter(lines[a + 1:], lambda x: length(trim(x)) > 0 AND NOT starts_with(x, '#') AND NOT starts_with(x, '*'))[1] END AS s FROM found),
    heads AS (SELECT *, coalesce(trim(substr(h, 3)), 'file') AS title,
        coalesce(CASE WHEN contains(parts[1], 'by ') THEN trim(regexp_replace(regexp_replace(parts[1], 'Published by ', ''), 'by ', '')) END, 'unknown') AS author,
        coalesce(nullif(parts[2], ''), '') AS date, CASE WHEN length(trim(p)) > 150 THEN substr(trim(p), 1, 150) || '...' ELSE coalesce(trim(p), '') END AS description FROM picked)"""


HEADER_SQL = """'---' || chr(10) || 'title: ''Header ' || id || '''' || chr(10) || 'tags: a,  b c' || chr(10) || 'heroImage: x.jpg' || chr(10) || '---' || chr(10) || """


def _md_text():
    head = F.concat(F.lit("# Doc "), "id", F.lit("\n\n*Published by "), "creator_id", F.lit(" by hand • "),
                    F.when(F.col("id") % 4 == 0, "January 5, 2024").otherwise(""), F.lit(" • 5 min read*\n\n"),
                    F.when(F.col("id") % 3 == 0, "## Overview\n").otherwise(""), "description")
    return F.when(F.col("id") % 2 == 0, head).otherwise(F.col("description"))


@query("fn31_heading_metadata", f"""WITH {MD} SELECT id, title, author, date, description,
    CASE WHEN length(trim(s)) > 160 THEN substr(trim(s), 1, 157) || '...' ELSE coalesce(trim(s), 'none') END AS summary FROM heads""")
def _(t):
    text = _md_text()
    m = K.heading_metadata(text, F.lit("file"))
    s = K.heading_summary(text, F.lit("file"), F.lit("none"))
    return t.doc.select("id", m.alias("m"), s["description"].alias("summary")).select("id", "m.*", "summary")


@query("fn31_document_metadata", f"""WITH {MD.replace('/*header*/', HEADER_SQL)} SELECT id, 'Header ' || id AS title, author, date, description, 'a|b c' AS tags, 'x.jpg' AS hero, length(text) AS body_chars FROM heads""")
def _(t):
    text = F.concat(F.lit("---\ntitle: 'Header "), "id", F.lit("'\ntags: a,  b c\nheroImage: x.jpg\n---\n"), _md_text())
    m = K.document_metadata(text, F.lit("file"))
    return t.doc.select("id", m.alias("m"), F.length(K.front_matter_body(text)).alias("body_chars")).select(
        "id", "m.title", "m.author", "m.date", "m.description", F.array_join("m.tags", "|").alias("tags"), F.col("m.heroImage").alias("hero"), "body_chars")


CATEGORY = """CASE WHEN contains(low, 'test') OR contains(low, 'spec') THEN 'test'
    WHEN contains(low, 'component') OR (ext = 'tsx' AND NOT contains(low, 'page')) THEN 'component'
    WHEN contains(low, 'api/') OR contains(low, '/api') OR contains(low, 'endpoint') THEN 'api'
    WHEN contains(low, 'util') OR contains(low, 'helper') OR contains(low, 'lib/') THEN 'util'
    WHEN ext IN ('css','scss','sass','less','styl') THEN 'style'
    WHEN contains(low, 'script') OR ext IN ('sh','bash','zsh') THEN 'script'
    WHEN ext IN ('md','txt','rst','doc') OR contains(low, 'readme') THEN 'documentation'
    WHEN ext IN ('json','yml','yaml','toml','ini','env') OR contains(low, 'config') OR starts_with(path, '.') THEN 'config'
    WHEN ext IN ('png','jpg','jpeg','gif','svg','ico','webp') THEN 'asset' ELSE 'other' END"""
LANGUAGE = """CASE ext WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript'
    WHEN 'md' THEN 'markdown' ELSE ext END"""
FILES = f"""files AS MATERIALIZED (SELECT *, {CATEGORY} AS category, {LANGUAGE} AS language FROM (SELECT *, lower(path) AS low,
    CASE WHEN contains(path, '.') THEN lower(string_split(path, '.')[-1]) ELSE '' END AS ext FROM v_change))"""


@query("fn32_file_category", f"WITH {FILES} SELECT id, category, ext AS extension, language FROM files")
def _(t):
    from keepsake.operators.changes import describe_files
    return describe_files(t.change).select("id", "category", "extension", "language")


DEV = """CASE WHEN creator_id % 5 = 0 THEN 0.4 ELSE 0 END + CASE WHEN tags[1] = 'error' THEN 0.2 ELSE 0 END
    + CASE WHEN contains(path, '/test') THEN 0.3 ELSE 0 END + CASE WHEN contains(path, 'api') OR contains(path, 'debug') THEN 0.2 ELSE 0 END
    + CASE WHEN id % 4 = 0 THEN 0.2 ELSE 0 END"""


@query("fn33_audience", f"""SELECT id, CASE WHEN s >= 0.6 THEN 'developer' ELSE 'endUser' END AS user_type,
    {q4('CASE WHEN s >= 0.6 THEN least(s, 1.0) ELSE 1.0 - s END')} AS confidence FROM (SELECT id, CAST({DEV} AS DOUBLE) AS s
    FROM (SELECT *, CASE id % 3 WHEN 0 THEN '/test/api' WHEN 1 THEN '/debug' ELSE '/home' END AS path FROM v_photo))""")
def _(t):
    path = F.when(F.col("id") % 3 == 0, "/test/api").when(F.col("id") % 3 == 1, "/debug").otherwise("/home")
    asked = F.when(F.col("id") % 4 == 0, F.array(F.lit("show roofs"), F.lit("which API?"))).otherwise(F.array(F.lit("show roofs")))
    a = K.audience(F.col("creator_id") % 5 == 0, F.col("tags")[0] == "error", path, asked)
    return t.photo.select("id", a.alias("a")).select("id", "a.user_type", r4(F.col("a.confidence")).alias("confidence"))


@query("fn34_relative_time", """SELECT id, CASE WHEN m <= 1 THEN 'just now' WHEN m < 60 THEN m || ' minutes ago'
    WHEN m // 60 = 1 THEN '1 hour ago' WHEN m // 60 < 24 THEN (m // 60) || ' hours ago' WHEN m // 1440 = 1 THEN '1 day ago'
    WHEN m // 1440 < 7 THEN (m // 1440) || ' days ago' ELSE strftime(captured_at, '%Y-%m-%d') END AS said
    FROM (SELECT id, captured_at, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(captured_at)) // 60000000 AS m FROM v_photo)""")
def _(t):
    return t.photo.select("id", K.relative_time(F.col("captured_at"), F.lit(EVENTS_NOW).cast("timestamp")).alias("said"))


@query("fn35_keyword_topic", """SELECT id, CASE WHEN contains(d, 'performance') OR contains(d, 'optimization') THEN 'performance'
    WHEN contains(d, 'testing') OR contains(d, 'development') THEN 'testing' WHEN contains(d, 'architecture') OR contains(d, 'system') THEN 'architecture'
    WHEN contains(d, 'data') OR contains(d, 'algorithm') THEN 'data' ELSE 'abstract' END AS topic FROM (SELECT id, lower(description) AS d FROM v_doc)""")
def _(t):
    return t.doc.select("id", K.keyword_topic(F.col("description")).alias("topic"))


PROHIBITED = "['ignore previous','disregard instructions','pretend you are','act as if','bypass','hack']"


@query("fn36_prohibited_terms", f"""SELECT id, array_to_string(list_filter({PROHIBITED}, lambda p: contains(d, p)), ',') AS found,
    contains(d, lang) AND contains(d, 'the') AS all_bounds FROM (SELECT id, lower(description) AS d, lower(project_id) AS lang FROM v_doc)""")
def _(t):
    d = F.col("description")
    bounds = F.array(F.col("project_id"), F.lit("The"))
    return t.doc.select("id", joined(K.prohibited_terms(d)).alias("found"), K.contains_all_boundaries(d, bounds).alias("all_bounds"))


@query("fn37_label_text", """SELECT id, concat_ws(', ', CASE WHEN (id % 10) / 10.0 > 0.6 THEN project_id END,
    CASE WHEN (id % 7) / 10.0 > 0.2 THEN creator_id END, CASE WHEN (id % 3) / 10.0 > 0.1 AND NOT (id % 10) / 10.0 > 0.6 THEN project_id END) AS text FROM v_doc"""
       .replace("(id % 3) / 10.0 > 0.1", "(id % 5) / 10.0 > 0.2"))
def _(t):
    item = lambda name, n: F.struct(F.col(name).alias("description"), (F.col("id") % n / 10.0).alias("score"))
    text = K.label_text(F.array(item("project_id", 10)), F.array(item("creator_id", 7), item("project_id", 5)))
    return t.doc.select("id", text.alias("text"))


@query("fn38_ai_tag_id", r"SELECT id, 'ai_' || id || '_' || regexp_replace(regexp_replace(description || ' #1', '\s+', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g') AS tag_id FROM v_tag")
def _(t):
    return t.tag.select("id", K.ai_tag_id(F.col("id"), F.concat("description", F.lit(" #1"))).alias("tag_id"))
