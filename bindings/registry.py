from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from keepsake.functions import difference_hash
from keepsake.functions.numbers import half_up, let
from keepsake.session import configure, scope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# "Now" of the test tables.
EVENTS_NOW = datetime(2024, 1, 31)
ORDERS_NOW = datetime(2001, 8, 2)


def r4(x: Column) -> Column:
    return half_up(x, 4)


def q4(x: str) -> str:
    """SQL twin of :func:`r4`."""
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


def joined(x: Column) -> Column:
    """Array as text, so that both engines compare it alike."""
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


class Tables:
    """The test tables and the derived views the operators are bound to."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        found = self.spark.read.parquet(path).schema
        # times are instants here: read as such, without a cast that would keep filters from the scan
        fields = [T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType) for f in found.fields]
        return self.spark.read.schema(T.StructType(fields)).parquet(path)

    @cached_property
    def photo(self) -> DataFrame:
        e, spot = F.col("event_id"), F.floor(F.col("event_id") / 3)
        return self.table("events").select(
            e.alias("id"), F.col("ts").alias("captured_at"), F.col("user_id").alias("creator_id"),
            (F.col("user_id") % 20).alias("project_id"),
            (F.lit(40.0) + (spot % 997) * F.lit(0.002)).alias("latitude"),
            (F.lit(-74.0) + (spot % 1009) * F.lit(0.002)).alias("longitude"),
            F.array("event_type").alias("tags"), F.col("props").alias("description"),
            F.when(e % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("analyzed_at"),
            F.when(e % 7 == 0, "archived").when(e % 11 != 0, "active").alias("archive_state"),
            (F.lit(640) + e % 40 * 80).alias("width"), (F.lit(480) + e % 30 * 80).alias("height"),
            F.concat(F.lit("img_"), e, F.lit(".jpg")).alias("filename"))

    @cached_property
    def doc(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("lang").alias("project_id"),
            F.col("source").alias("creator_id"), F.array("lang", "source").alias("tags"),
            (F.col("doc_id") % 2 == 0).alias("has_coordinates"), F.sha2("text", 256).alias("content_hash"))

    @staticmethod
    def _nudged(vector: str, id_: Column) -> Column:
        return F.transform(vector, lambda x, i: x.cast("double") * (
            F.lit(1.0) + (((i + 1) * 7 + id_) % 5) * F.lit(0.02)))

    @cached_property
    def vec(self) -> DataFrame:
        raw = self.table("embeddings")
        base = raw.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")
        near = raw.filter(F.col("vec_id") % 5 == 0).select(
            (F.col("vec_id") + 1_000_000).alias("id"), self._nudged("embedding", F.col("vec_id")).alias("features"), "label")
        return base.unionByName(near)

    @cached_property
    def hash(self) -> DataFrame:
        # bound first: inside the function the vector would be computed again for each value
        grid = let(F.col("features"), lambda v: F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get(v, (i % 64).cast("int"))))
        return self.vec.select("id", difference_hash(grid).alias("hash"))

    @cached_property
    def feedback(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"), "ts", "user_id", F.concat(F.lit("i"), F.col("event_id") % 500).alias("item_id"),
            F.when(F.col("user_id") % 2 == 0, "developer").otherwise("endUser").alias("user_type"),
            F.when(kind.isin("click", "purchase"), "positive").when(kind == "error", "negative")
            .when(kind == "view", "edit").otherwise("other").alias("feedback"))

    @cached_property
    def edit(self) -> DataFrame:
        turns = self.table("conversations")
        after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("edited"))
        return turns.withColumnRenamed("text", "original").join(after, ["conv_id", "turn"]).select(
            "conv_id", "turn", "role", "original", "edited")

    @cached_property
    def tag(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.concat(F.split("p_name", " "), F.array("p_type")).alias("tags"),
            F.col("p_name").alias("description"), (F.col("p_size") * 100).cast("bigint").alias("width"),
            (F.col("p_size") * 75).cast("bigint").alias("height"), F.col("p_brand").alias("brand"))

    @cached_property
    def task(self) -> DataFrame:
        status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
        made = F.col("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
            F.concat(F.lit("priority "), "o_orderpriority").alias("description"),
            F.when(status == "P", "pending").when(status == "O", "in-progress").otherwise("completed").alias("status"),
            F.when(priority == "1", "urgent").when(priority == "2", "high").when(priority == "3", "medium")
            .otherwise("low").alias("priority"),
            made.alias("created_at"), (made + F.expr("INTERVAL 7 DAY")).alias("due_at"),
            F.timestamp_micros(F.unix_micros(made) + F.col("o_orderkey") % 10 * 86_400_000_000).alias("updated_at"),
            F.col("o_custkey").alias("assignee"), F.array(F.lower("o_orderpriority")).alias("tags"))

    @cached_property
    def change(self) -> DataFrame:
        p = F.col("page_id")
        return self.table("pages").select(
            p.alias("id"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"), "url",
            (F.length("html") % 500).cast("bigint").alias("insertions"), (F.length("html") % 70).cast("bigint").alias("deletions"),
            F.when(p % 4 == 0, "added").when(p % 4 == 3, "deleted").otherwise("modified").alias("status"),
            (p % 4 == 0).alias("is_new"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("message"))

    @cached_property
    def full(self) -> DataFrame:
        """Documents with the time, place and creator of the event of the same id, and a vector: every
        fifth row has a nudged copy of the vector of the row before it."""
        docs = self.doc.select("id", "description", "tags", "content_hash")
        where = self.photo.select("id", "captured_at", "creator_id", "project_id", "latitude", "longitude")
        vecs = self.table("embeddings").select(F.col("vec_id").alias("v"), "embedding")
        out = docs.join(where, "id").withColumn("v", F.col("id") - (F.col("id") % 5 == 1).cast("int")).join(vecs, "v", "left")
        own = F.transform("embedding", lambda x: x.cast("double"))
        out = out.withColumn("features", F.when(F.col("id") % 5 == 1, self._nudged("embedding", F.col("v"))).otherwise(own))
        grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get(F.col("features"), (i % 64).cast("int")))
        return out.withColumn("hash", F.when(F.col("features").isNotNull(), difference_hash(grid))).drop("v", "embedding")


TOK = (r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+'),"
       r" lambda w: length(w) > 2))")
DHASH = ("list_reduce(list_transform(range(16), lambda k: substr('0123456789abcdef', CAST(1 + list_sum(list_transform(range(4), "
         "lambda j: CASE WHEN {0}[1 + (((4*k+j)//8)*9 + (4*k+j)%8) % 64] < {0}[1 + (((4*k+j)//8)*9 + (4*k+j)%8 + 1) % 64] "
         "THEN 8 // CAST(pow(2, j) AS INTEGER) ELSE 0 END)) AS INTEGER), 1)), lambda x, y: x || y)")
NUDGE = ("list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * "
         "(CAST(1 AS DOUBLE) + ((7*i + {0}) % 5) * CAST(0.02 AS DOUBLE)))")

VIEWS = {
    "v_photo": """SELECT event_id AS id, ts AS captured_at, user_id AS creator_id, user_id % 20 AS project_id,
        40 + ((event_id // 3) % 997) * CAST(0.002 AS DOUBLE) AS latitude,
        -74 + ((event_id // 3) % 1009) * CAST(0.002 AS DOUBLE) AS longitude,
        [event_type] AS tags, props AS description,
        CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 DAY END AS analyzed_at,
        CASE WHEN event_id % 7 = 0 THEN 'archived' WHEN event_id % 11 <> 0 THEN 'active' END AS archive_state,
        640 + event_id % 40 * 80 AS width, 480 + event_id % 30 * 80 AS height,
        'img_' || event_id || '.jpg' AS filename FROM events""",
    "v_doc": """SELECT doc_id AS id, text AS description, lang AS project_id, source AS creator_id,
        [lang, source] AS tags, doc_id % 2 = 0 AS has_coordinates, sha256(text) AS content_hash FROM documents""",
    "v_vec": f"""SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features, label FROM embeddings
        UNION ALL SELECT vec_id + 1000000, {NUDGE.format('vec_id')}, label FROM embeddings WHERE vec_id % 5 = 0""",
    "v_hash": f"SELECT id, {DHASH.format('features')} AS hash FROM v_vec",
    "v_feedback": """SELECT event_id AS id, ts, user_id, 'i' || (event_id % 500) AS item_id,
        CASE WHEN user_id % 2 = 0 THEN 'developer' ELSE 'endUser' END AS user_type,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'positive' WHEN event_type = 'error' THEN 'negative'
             WHEN event_type = 'view' THEN 'edit' ELSE 'other' END AS feedback FROM events""",
    "v_edit": """SELECT * FROM (SELECT conv_id, turn, role, text AS original,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS edited FROM conversations) WHERE edited IS NOT NULL""",
    "v_tag": """SELECT p_partkey AS id, list_concat(string_split(p_name, ' '), [p_type]) AS tags, p_name AS description,
        CAST(p_size * 100 AS BIGINT) AS width, CAST(p_size * 75 AS BIGINT) AS height, p_brand AS brand FROM part""",
    "v_task": """SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, 'priority ' || o_orderpriority AS description,
        CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'in-progress' ELSE 'completed' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
        o_orderdate AS created_at, o_orderdate + INTERVAL 7 DAY AS due_at,
        o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS updated_at, o_custkey AS assignee,
        [lower(o_orderpriority)] AS tags FROM orders""",
    "v_change": """SELECT page_id AS id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path, url,
        length(html) % 500 AS insertions, length(html) % 70 AS deletions,
        CASE page_id % 4 WHEN 0 THEN 'added' WHEN 3 THEN 'deleted' ELSE 'modified' END AS status, page_id % 4 = 0 AS is_new,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS message FROM pages""",
    "v_full": f"""SELECT d.*, CASE WHEN features IS NULL THEN NULL ELSE {DHASH.format('features')} END AS hash FROM (
        SELECT d.id, d.description, d.tags, d.content_hash, p.captured_at, p.creator_id, p.project_id, p.latitude, p.longitude,
        CASE WHEN embedding IS NULL THEN NULL WHEN d.id % 5 = 1 THEN {NUDGE.format('vec_id')}
             ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS features
        FROM v_doc d JOIN v_photo p ON p.id = d.id
        LEFT JOIN embeddings e ON e.vec_id = d.id - CASE WHEN d.id % 5 = 1 THEN 1 ELSE 0 END) d""",
}


def with_views(sql: str) -> str:
    """Prepend the views that ``sql`` names, directly or through another view."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {views},\n" + re.sub(r"^WITH\s+RECURSIVE\b", "", body, flags=re.I)
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {views},\n" + re.sub(r"^WITH\b", "", body, flags=re.I)
    return f"WITH {views}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle."""
    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = Tables(spark, sf_dir)
            with scope(spark) as keep:  # only the result stays in the shared folder
                return keep(fn(tables))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return register


def leaders_sql(edges: str, out: str) -> str:
    """Sequential leader grouping as a recursive walk over the rows in id order; brute force on
    purpose. ``edges(a, b)`` with ``a < b``. Defines ``out(leader, member)``; needs WITH RECURSIVE."""
    return f"""
    {out}_nb AS MATERIALIZED (SELECT b AS id, list(a) AS smaller FROM {edges} GROUP BY b),
    {out}_nodes AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k
        FROM (SELECT a AS id FROM {edges} UNION SELECT b FROM {edges})),
    {out}_walk(k, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
        UNION ALL SELECT w.k + 1, CASE WHEN list_has_any(coalesce(nb.smaller, []), w.leaders) THEN w.leaders
                                       ELSE list_append(w.leaders, n.id) END
        FROM {out}_walk w JOIN {out}_nodes n ON n.k = w.k + 1 LEFT JOIN {out}_nb nb ON nb.id = n.id),
    {out}_set AS MATERIALIZED (SELECT unnest(leaders) AS id FROM (SELECT leaders FROM {out}_walk ORDER BY k DESC LIMIT 1)),
    {out} AS MATERIALIZED (SELECT min(e.a) AS leader, e.b AS member FROM {edges} e
        WHERE e.a IN (SELECT id FROM {out}_set) AND e.b NOT IN (SELECT id FROM {out}_set) GROUP BY e.b)"""
