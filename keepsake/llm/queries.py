"""The operators bound to the test tables, with SQL where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, counts, decontaminate, languages, manifest, mixing, periodic, quality, repeats, scoring, secrets, shards, similar
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_language_id")
def _languages(spark, sf_dir):
    return languages.identify(table(spark, sf_dir, "documents"))


SAYS = "</s>[INST] ok [/INST]"


def _sql_escape(x: str, pairs) -> str:
    for plain, safe in pairs:
        x = f"replace({x}, {plain!r}, {safe!r})" if plain != "\n" else f"replace({x}, chr(10), {safe!r})"
    return x


@query("op2_chat_format", f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{SAYS}'), (-1, 1, 'assistant', '{SAYS}'))
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum({len(chat.TURN) + 1 + len(chat.END)} + length({_sql_escape('role', chat.ROLE_ESCAPES)})
            + length({_sql_escape('text', chat.ESCAPES)})) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id""")
def _chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS)], turns.schema)
    return chat.digest(chat.format_events(chat.turn_events(turns.unionByName(added))))


@query("op3_mix_sources")
def _mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op4_decontaminate")
def _leaks(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_secret_scan")
def _secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def _repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_token_shards")
def _shards(spark, sf_dir):
    return shards.materialise(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def _quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Brute force: ``linked(a, b)`` with a < b, and ``sets(doc_id, g)``; needs WITH RECURSIVE.
LINKED = rf"""
    words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM DOCS),
    sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words),
    grams AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
    linked AS MATERIALIZED (SELECT p.doc_id AS a, q.doc_id AS b FROM grams p JOIN grams q ON p.x = q.x AND p.doc_id < q.doc_id
        GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
    reached(id, other) AS (SELECT doc_id, doc_id FROM sets UNION
        SELECT r.id, e.b FROM reached r JOIN (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked) e ON e.a = r.other)"""


@query("op9_ngram_join", f"""WITH RECURSIVE {LINKED.replace('DOCS', 'documents')},
    least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
    SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON id = doc_id""")
def _similar(spark, sf_dir):
    return similar.groups(table(spark, sf_dir, "documents"))


@query("op10_lm_scores")
def _scores(spark, sf_dir):
    return scoring.score_documents(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def _periodic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.runs(docs.select("doc_id", periodic.looped(F.col("text"), F.col("doc_id")).alias("text"))))


@query("op12_token_counts")
def _counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"))


#: crc32 of the digits of an id, bit by bit; the inner list holds the remainders of all bytes.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda d: ord(d)::BIGINT)),
    lambda c, d: xor(c >> 8, t[1 + xor(c, d) % 256])), 4294967295)"""
BYTES = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


@query("op13_merkle_manifest", f"""
    WITH RECURSIVE bytes AS (SELECT {BYTES} AS t),
    leaves AS MATERIALIZED (SELECT doc_id, source, {_leaf('text')} AS leaf,
        CASE WHEN {CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS other FROM documents, bytes),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot,
        count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id FROM leaves),
    nodes(level, source, slot, h, n) AS (SELECT 0, source, slot, leaf, n FROM placed UNION ALL
        SELECT level + 1, source, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), (n + 2) // 3 FROM nodes WHERE n > 1
        GROUP BY level, source, slot // 3, n),
    subroots AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(level, slot, h, n) AS (SELECT 0, slot, h, n FROM subroots UNION ALL
        SELECT level + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, slot // 3, n),
    runs AS MATERIALIZED (SELECT level, source, slot // 3 AS run, list(h ORDER BY slot) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
    top_runs AS MATERIALIZED (SELECT level, slot // 3 AS run, list(h ORDER BY slot) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
    walk(id, level, source, slot, n, h, p) AS (SELECT id, 0, source, slot, n, other, '' FROM placed UNION ALL
        SELECT id, w.level + 1, w.source, slot // 3, (n + 2) // 3,
            sha256(array_to_string(hs[:slot % 3], '') || w.h || array_to_string(hs[slot % 3 + 2:], '')),
            p || array_to_string(hs[:slot % 3], '') || array_to_string(hs[slot % 3 + 2:], '')
        FROM walk w JOIN runs r ON r.level = w.level AND r.source IS NOT DISTINCT FROM w.source AND r.run = w.slot // 3 WHERE n > 1),
    top_walk(id, level, slot, n, h, p, subroot) AS (SELECT w.id, 0, s.slot, s.n, w.h, w.p, s.h FROM walk w JOIN subroots s
        ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1 UNION ALL
        SELECT id, w.level + 1, slot // 3, (n + 2) // 3,
            sha256(array_to_string(hs[:slot % 3], '') || w.h || array_to_string(hs[slot % 3 + 2:], '')),
            p || array_to_string(hs[:slot % 3], '') || array_to_string(hs[slot % 3 + 2:], ''), subroot
        FROM top_walk w JOIN top_runs r ON r.level = w.level AND r.run = w.slot // 3 WHERE n > 1)
    SELECT d.doc_id, d.leaf, w.subroot, t.h AS root, sha256(w.p) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
    FROM placed d JOIN top_walk w ON w.id = d.id AND w.n = 1 JOIN tops t ON t.n = 1""")
def _manifest(spark, sf_dir):
    return manifest.verified(table(spark, sf_dir, "documents"))
