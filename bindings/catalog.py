"""Sources, sinks, filters, catalog joins, sorting."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from keepsake.operators import activity, catalog, filters
from keepsake.session import fresh_path, scratch_path
from keepsake.sources import indexes, readers
from keepsake.sources.snapshots import Snapshots, export_json, import_json, write_aggregates

from .registry import EVENTS_NOW, ORDERS_NOW, joined, q4, query, r4
from .scalars import MB

us = F.unix_micros
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
TASK_NOW_SQL = "TIMESTAMP '2001-08-02 00:00:00'"


def _photos(df):
    return df.select("id", "project_id", us("captured_at").alias("captured"))


# --- sources -----------------------------------------------------------------------------------

@query("src1_newest_photos", """SELECT id, project_id, epoch_us(captured_at) AS captured FROM v_photo WHERE project_id = 7
    ORDER BY captured_at DESC, id LIMIT 200""")
def _(t):
    return _photos(readers.newest_first(t.photo, "captured_at", project_id=7, limit=200))


@query("src2_page", "SELECT id, title, epoch_us(created_at) AS created FROM v_task ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def _(t):
    return readers.page(t.task, 3, 50, "created_at").select("id", "title", us("created_at").alias("created"))


@query("src2_page_after", """SELECT id, title FROM v_task WHERE created_at < TIMESTAMP '2000-01-01' OR (created_at = TIMESTAMP '2000-01-01' AND id > 5000)
    ORDER BY created_at DESC, id LIMIT 50""")
def _(t):
    return readers.page_after(t.task, datetime(2000, 1, 1), 5000, 50, "created_at").select("id", "title")


@query("src2_deep_page", """SELECT id, title, epoch_us(created_at) AS created FROM v_task ORDER BY created_at DESC, id
    LIMIT 20 OFFSET (SELECT CAST(count(*) // 40 * 20 AS BIGINT) FROM v_task)""")
def _(t):
    """The page in the middle of all rows, by the page index."""
    path, rows = scratch_path(t.spark, "pages"), t.task.select("id", "title", "created_at")
    indexes.write_pages(rows, path, "created_at")
    return indexes.read_page(t.spark, path, rows.count() // 40 + 1, 20, "created_at").select("id", "title", us("created_at").alias("created"))


@query("src3_photo_json", """SELECT CAST(page_id AS VARCHAR) AS id, CASE page_id % 3 WHEN 0 THEN url || '#web' WHEN 1 THEN url || '#original' ELSE url END AS web_url,
    CASE WHEN page_id % 4 > 0 THEN CAST(page_id AS DOUBLE) / 10 END AS latitude, CAST(1700000000 + page_id AS BIGINT) AS captured,
    CASE WHEN page_id % 2 = 0 THEN 'v' || page_id ELSE 'd' || page_id END AS tags, 'active' AS archive_state FROM pages, range(2)""")
def _(t):
    p, url = F.col("page_id"), F.col("url")
    uri = lambda kind: F.struct(F.lit(kind).alias("type"), F.concat(url, F.lit("#" + kind)).alias("uri"))
    thumb = F.struct(F.lit("thumbnail").alias("type"), url.alias("uri"))
    uris = F.when(p % 3 == 0, F.array(uri("original"), uri("web"))).when(p % 3 == 1, F.array(thumb, uri("original"))).otherwise(F.array(thumb))
    at = F.struct((p / 10).alias("latitude"), F.lit(1.5).alias("longitude"))
    tag = F.struct(F.when(p % 2 == 0, F.concat(F.lit("v"), p)).otherwise("").alias("value"), F.concat(F.lit("d"), p).alias("display_value"))
    doc = F.struct(p.cast("string").alias("id"), uris.alias("uris"), url.alias("photo_url"), (p + 1_700_000_000).alias("captured_at"),
                   F.when(p % 4 > 0, F.array(at, at)).otherwise(F.array().cast("array<struct<latitude:double,longitude:double>>")).alias("coordinates"),
                   F.array(tag).alias("tags"))
    lines = t.table("pages").select(F.to_json(doc).alias("j"))
    path = fresh_path(t.spark, "src3")
    lines.write.text(path)
    show = lambda df: df.select("id", "web_url", "latitude", F.unix_seconds("captured_at").alias("captured"), joined(F.col("tags")).alias("tags"), "archive_state")
    # the reader of JSON-lines files and the parser of a JSON column see the same records
    return show(readers.read_photo_json(t.spark, path)).unionByName(show(readers.parse_photos(lines, "j")))


@query("src4_lookup_ids", "SELECT id, project_id FROM v_doc WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    ids = t.table("labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return catalog.lookup(t.doc, ids, "id").select("id", "project_id")


@query("src5_tagged_records", "SELECT id, description FROM v_tag WHERE list_contains(tags, 'red') AND list_contains(tags, 'ECONOMY')")
def _(t):
    return readers.search_tagged(t.tag, ["red", "ECONOMY"], tags="tags").select("id", "description")


@query("src5_tag_postings", """SELECT id, description, 'AND' AS logic FROM v_tag WHERE list_contains(tags, 'red') AND list_contains(tags, 'ECONOMY')
    UNION ALL SELECT id, description, 'OR' FROM v_tag WHERE list_contains(tags, 'red') OR list_contains(tags, 'ECONOMY')""")
def _(t):
    """Records by tags, from an inverted index."""
    path = scratch_path(t.spark, "tags")
    indexes.write_tags(t.tag, path)
    both = [indexes.tagged(t.tag, path, ["red", "ECONOMY"], logic).select("id", "description", F.lit(logic).alias("logic")) for logic in ("AND", "OR")]
    return both[0].unionByName(both[1])


@query("src6_user_records", "SELECT id, epoch_us(created_at) AS created FROM v_task WHERE assignee = 100 ORDER BY created_at DESC, id LIMIT 20")
def _(t):
    return readers.user_records(t.task, 100, "assignee", "created_at", "id", 20).select("id", us("created_at").alias("created"))


@query("src7_by_extension", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '\\.(html|htm)$')")
def _(t):
    return readers.by_extension(t.table("pages"), "url", ("html", "htm")).select("page_id", "url")


# --- sinks: written and read back ---------------------------------------------------------------

@query("snk1_upsert", """SELECT id, CASE WHEN id % 3 = 0 THEN 'changed ' || (id % 5) ELSE title END AS title,
    epoch_us(CASE WHEN id % 2 = 0 THEN created_at ELSE TIMESTAMP '2001-08-02' END) AS created,
    epoch_us(CASE WHEN id % 3 = 0 OR id % 2 = 1 THEN TIMESTAMP '2001-08-02' ELSE updated_at END) AS updated
    FROM v_task WHERE id % 2 = 0 OR id % 3 = 0""")
def _(t):
    tasks = t.task.select("id", "title", "created_at", "updated_at")
    current = tasks.filter("id % 2 = 0")
    touched = tasks.filter("id % 3 = 0").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    changes = touched.select("id", F.when(F.col("n") == 1, F.concat(F.lit("changed "), F.col("id") % 5)).otherwise("first try").alias("title"), "n")
    store = Snapshots(t.spark, fresh_path(t.spark, "snk1"))
    store.write(catalog.upsert(current, changes, "id", ORDERS_NOW, "n"), "0001")
    return store.current().select("id", "title", us("created_at").alias("created"), us("updated_at").alias("updated"))


@query("snk2_delete", "SELECT id, title FROM v_task WHERE NOT (status = 'completed' AND priority = 'low')")
def _(t):
    gone = t.task.filter("status = 'completed' AND priority = 'low'")
    store = Snapshots(t.spark, fresh_path(t.spark, "snk2"))
    return store.write(catalog.delete_keys(t.task, gone, "id"), "0001").select("id", "title")


@query("snk3_index_text", """SELECT id, CASE WHEN id % 4 = 3 AND id % 3 = 2 THEN 'Photo ' || id ELSE concat_ws('. ',
    CASE WHEN id % 4 <> 3 THEN description END, CASE WHEN id % 3 <> 2 THEN 'Tags: ' || project_id || ', ' || creator_id END,
    CASE WHEN id % 4 <> 3 OR id % 3 <> 2 THEN CASE WHEN id % 2 = 0 THEN 'Project: ' || project_id END END) END AS text FROM v_doc
    WHERE NOT (id % 4 = 3 AND id % 3 = 2 AND id % 2 = 0)""")
def _(t):
    i = F.col("id")
    text = catalog.index_text(i, F.when(i % 4 != 3, F.col("description")), F.when(i % 3 != 2, F.col("tags")),
                              F.when(i % 2 == 0, F.col("project_id")))
    return t.doc.select("id", text.alias("text"))


@query("snk4_index_export", """SELECT id, 'Project ' || project_id AS project_name, CASE WHEN id % 2 = 0 THEN 'AI text ' || id ELSE description END AS description,
    project_id || ',' || creator_id || CASE WHEN id % 2 = 0 THEN ',new' ELSE '' END AS tags FROM v_doc""")
def _(t):
    i = F.col("id")
    ai = t.doc.filter(i % 2 == 0).select("id", F.concat(F.lit("AI text "), "id").alias("ai_description"),
                                         F.array(F.upper("project_id"), F.lit("new"), F.lit("NEW")).alias("accepted_ai_tags"))
    path = fresh_path(t.spark, "snk4")
    catalog.index_records(t.doc, ai).write.parquet(path)
    return t.spark.read.parquet(path).select("id", "project_name", "description", joined(F.col("tags")).alias("tags"))


@query("snk5_json_round_trip", "SELECT id, title, status, epoch_us(created_at) AS created, epoch_us(updated_at) AS updated, tags[1] AS tag FROM v_task")
def _(t):
    df = t.task.select("id", "title", "status", "created_at", "updated_at", "tags")
    path = fresh_path(t.spark, "snk5")
    export_json(df, path)
    back = import_json(t.spark, path, df.schema)
    return back.select("id", "title", "status", us("created_at").alias("created"), us("updated_at").alias("updated"), F.col("tags")[0].alias("tag"))


@query("snk6_aggregate_store", """SELECT user_type, epoch_us(date_trunc('hour', ts)) AS start, count(*) AS total FROM v_feedback GROUP BY ALL""")
def _(t):
    agg = (t.feedback.groupBy("user_type", F.date_trunc("hour", "ts").alias("period_start")).agg(F.count(F.lit(1)).alias("total"))
           .withColumn("grain", F.lit("hour")))
    path = fresh_path(t.spark, "snk6")
    write_aggregates(agg, path)
    # writing one day again replaces that day only
    write_aggregates(agg.filter(F.to_date("period_start") == F.lit("2024-01-05").cast("date")), path)
    return t.spark.read.parquet(path).select("user_type", us("period_start").alias("start"), "total")


# --- filters -----------------------------------------------------------------------------------

def D(*a):
    return datetime(*a)


@query("f1_date_range", "SELECT id FROM v_photo WHERE captured_at >= TIMESTAMP '2024-01-05' AND captured_at <= TIMESTAMP '2024-01-10 12:00:00'")
def _(t):
    return t.photo.filter(filters.in_date_range(F.col("captured_at"), D(2024, 1, 5), D(2024, 1, 10, 12))).select("id")


@query("f2_size_range", f"SELECT id FROM v_tag WHERE {MB} BETWEEN 0.5 AND 2")
def _(t):
    return t.tag.filter(filters.in_size_range(F.col("width"), F.col("height"), 0.5, 2)).select("id")


@query("f3_min_dimensions", "SELECT id FROM v_tag WHERE width >= 2048 AND height >= 1536")
def _(t):
    return t.tag.filter(filters.at_least(F.col("width"), F.col("height"), 2048, 1536)).select("id")


@query("f4_tag_substring", "SELECT id FROM v_tag WHERE len(list_filter(tags, lambda x: contains(lower(x), 'eco') OR contains(lower(x), 'idg'))) > 0")
def _(t):
    return t.tag.filter(filters.tag_contains_any(F.col("tags"), ["ECO", "idg"])).select("id")


@query("f5_search", """SELECT id FROM v_doc WHERE contains(lower(description || ' ' || project_id || ' ' || creator_id), 'the')
    AND contains(lower(description || ' ' || project_id || ' ' || creator_id), 'src1')""")
def _(t):
    return t.doc.filter(filters.matches_search(filters.search_text(F.col("description"), F.col("tags")), "The  SRC1")).select("id")


FUNNEL = filters.Criteria(start=D(2024, 1, 8), min_mb=0.5, min_width=1000, tags=("CLI", "view"), search="img 1")
S1, S2 = "captured_at >= TIMESTAMP '2024-01-08'", f"{MB} BETWEEN 0.5 AND 100"
S3, S4 = "width >= 1000 AND height >= 0", "(contains(tags[1], 'cli') OR contains(tags[1], 'view'))"
TEXT = "lower(filename || ' ' || description || ' ' || tags[1])"
S5 = f"contains({TEXT}, 'img') AND contains({TEXT}, '1')"


@query("f6_filter_funnel", f"""SELECT count(*) AS total, count(*) FILTER ({S1}) AS date_range, count(*) FILTER ({S1} AND {S2}) AS file_size,
    count(*) FILTER ({S1} AND {S2} AND {S3}) AS dimensions, count(*) FILTER ({S1} AND {S2} AND {S3} AND {S4}) AS tags,
    count(*) FILTER ({S1} AND {S2} AND {S3} AND {S4} AND {S5}) AS search, count(*) FILTER ({S1} AND {S2} AND {S3} AND {S4} AND {S5}) AS matched FROM v_photo""")
def _(t):
    return filters.filter_funnel(t.photo, FUNNEL)


@query("f7_presets", f"""SELECT 'recent' AS preset, id FROM v_photo WHERE captured_at >= TIMESTAMP '2024-01-24'
    UNION ALL SELECT 'high-res', id FROM v_photo WHERE width >= 2048 AND height >= 1536 AND {MB} >= 2
    UNION ALL SELECT 'large-files', id FROM v_photo WHERE {MB} >= 5
    UNION ALL SELECT 'tagged', id FROM v_photo WHERE contains(tags[1], 'important') OR contains(tags[1], 'progress') OR contains(tags[1], 'issue')""")
def _(t):
    parts = [filters.apply_criteria(t.photo, filters.preset(n, EVENTS_NOW)).select(F.lit(n).alias("preset"), "id")
             for n in ("recent", "high-res", "large-files", "tagged")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("f8_tag_filter", """SELECT 'and' AS logic, id FROM v_tag WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'economy') AND list_contains(tags, 'red')
    UNION ALL SELECT 'or', id FROM v_tag WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'economy') OR list_contains(tags, 'red')
    UNION ALL SELECT 'view', id FROM v_photo WHERE coalesce(archive_state, 'active') <> 'archived' AND tags[1] = 'click'""")
def _(t):
    a = t.tag.filter(filters.tags_match(F.col("tags"), ["Economy", "RED"], "AND")).select(F.lit("and").alias("logic"), "id")
    o = t.tag.filter(filters.tags_match(F.col("tags"), ["Economy", "RED"], "OR")).select(F.lit("or").alias("logic"), "id")
    v = filters.tag_filter(t.photo, ["Click"]).select(F.lit("view").alias("logic"), "id")
    return a.unionByName(o).unionByName(v)


@query("f9_tag_ids", "SELECT id FROM v_tag WHERE list_contains(tags, 'small') AND list_contains(tags, 'ring')")
def _(t):
    return t.tag.filter(filters.has_all(F.col("tags"), ["small", "ring"])).select("id")


@query("f10_archive_state", "SELECT id, coalesce(archive_state, 'active') AS state FROM v_photo WHERE coalesce(archive_state, 'active') = 'active'")
def _(t):
    return t.photo.filter(filters.archive_state_is(F.col("archive_state"), "active")).select("id", F.coalesce("archive_state", F.lit("active")).alias("state"))


NOT_ARCHIVED = "coalesce(archive_state, 'active') <> 'archived'"
CUT = "TIMESTAMP '2024-01-24'"
SMART = f"""CASE WHEN analyzed_at IS NULL THEN captured_at >= {CUT} ELSE captured_at > analyzed_at OR analyzed_at < {CUT} END"""


@query("f11_select_for_analysis", f"""SELECT 'smart' AS mode, id FROM v_photo WHERE {NOT_ARCHIVED} AND {SMART}
    UNION ALL SELECT 'forced', id FROM v_photo WHERE captured_at >= {CUT}
    UNION ALL SELECT 'range', id FROM v_photo WHERE {NOT_ARCHIVED} AND captured_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND analyzed_at IS NULL
    UNION ALL SELECT 'all', id FROM v_photo WHERE {NOT_ARCHIVED} AND analyzed_at IS NULL
    UNION ALL SELECT 'selection', id FROM v_photo WHERE {NOT_ARCHIVED} AND id IN (SELECT doc_id FROM labels)""")
def _(t):
    ids = t.table("labels").select(F.col("doc_id").alias("id"))
    S = filters.Selection
    modes = {"smart": S("smart"), "forced": S("smart", force=True, include_archived=True),
             "range": S("date-range", D(2024, 1, 5), D(2024, 1, 6)), "all": S("all"), "selection": S("selection", ids=ids)}
    out = None
    for name, s in modes.items():
        part = filters.select_for_analysis(t.photo, s, EVENTS_NOW).select(F.lit(name).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("f12_new_records", f"SELECT id FROM v_photo WHERE analyzed_at IS NULL OR captured_at > analyzed_at OR analyzed_at < {CUT}")
def _(t):
    return filters.new_records(t.photo, EVENTS_NOW).select("id")


@query("f13_selection_estimate", f"""SELECT count(*) AS n, 'New photos from last 7 days excluding archived' AS description FROM v_photo WHERE {NOT_ARCHIVED} AND {SMART}
    UNION ALL SELECT count(*), 'All unanalyzed photos excluding archived' FROM v_photo WHERE {NOT_ARCHIVED} AND analyzed_at IS NULL""")
def _(t):
    a = filters.estimate_selection(t.photo, filters.Selection("smart"), EVENTS_NOW)
    return a.unionByName(filters.estimate_selection(t.photo, filters.Selection("all"), EVENTS_NOW))


NOTES = "SELECT id, captured_at AS created_at, captured_at + to_days(CAST(id % 20 AS INTEGER)) AS due, id % 4 = 0 AS dismissed FROM v_photo"


@query("f14_notifications", f"""WITH n AS ({NOTES}) SELECT 'active' AS kind, id FROM n WHERE NOT dismissed AND due >= {NOW_SQL}
    UNION ALL SELECT 'retained', id FROM n WHERE (NOT dismissed AND due > {NOW_SQL}) OR (dismissed AND created_at > {NOW_SQL} - INTERVAL 7 DAY)""")
def _(t):
    due = F.timestamp_micros(us("captured_at") + F.col("id") % 20 * 86_400_000_000)
    n = t.photo.select("id", F.col("captured_at").alias("created_at"), due.alias("scheduled_deletion_at"), (F.col("id") % 4 == 0).alias("dismissed"))
    a = filters.active_notifications(n, EVENTS_NOW).select(F.lit("active").alias("kind"), "id")
    return a.unionByName(filters.retained_notifications(n, EVENTS_NOW).select(F.lit("retained").alias("kind"), "id"))


@query("f15_confidence_split", "SELECT id AS group_id, (id % 100) / 100.0 >= 0.85 AS accepted FROM v_vec")
def _(t):
    g = t.vec.select(F.col("id").alias("group_id"), (F.col("id") % 100 / 100.0).alias("confidence"))
    ok, low = filters.split_by_confidence(g)
    return ok.select("group_id", F.lit(True).alias("accepted")).unionByName(low.select("group_id", F.lit(False).alias("accepted")))


@query("f16_new_suggestions", """SELECT id, array_to_string(list_filter(['RED', 'Blue', 'economy', brand], lambda s: NOT list_contains(list_transform(tags, lambda x: lower(x)), lower(s))), ',') AS suggested FROM v_tag""")
def _(t):
    offered = F.array(F.lit("RED"), F.lit("Blue"), F.lit("economy"), F.col("brand"))
    return t.tag.select("id", joined(filters.new_suggestions(offered, F.col("tags"))).alias("suggested"))


@query("f17_task_filter", """SELECT id FROM v_task WHERE contains(lower(title || ' ' || description || ' ' || assignee || ' ' || tags[1]), 'order')
    AND contains(lower(title || ' ' || description || ' ' || assignee || ' ' || tags[1]), '1') AND status IN ('pending', 'in-progress') AND priority IN ('urgent', 'high')
    AND contains(tags[1], 'h') AND due_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01'""")
def _(t):
    return filters.filter_tasks(t.task, "order 1", ("pending", "in-progress"), ("urgent", "high"), None, ("H",), D(1996, 1, 1), D(1999, 1, 1)).select("id")


# --- joins, keyed tables -----------------------------------------------------------------------

ENRICH_TAGS = """list_concat([{'d': upper(project_id), 'a': id % 4 = 0}, {'d': creator_id, 'a': false}],
    CASE WHEN quality IS NULL THEN [] WHEN id % 4 = 0 THEN [{'d': 'new tag', 'a': true}] ELSE [{'d': 'other', 'a': true}] END)"""


@query("j1_enrich", f"""SELECT id, CASE WHEN quality = 1 THEN 'AI ' || id ELSE description END AS description,
    array_to_string(list_transform(tags, lambda x: x.d || ':' || CASE WHEN x.a THEN 'ai' ELSE 'own' END), ',') AS tags
    FROM (SELECT d.id, d.description, l.quality, list_concat([{{'d': upper(project_id), 'a': l.quality IS NOT NULL AND d.id % 4 = 0}}, {{'d': creator_id, 'a': false}}],
        CASE WHEN l.quality IS NULL THEN [] WHEN d.id % 4 = 0 THEN [{{'d': 'new tag', 'a': true}}] ELSE [{{'d': 'other', 'a': true}}] END) AS tags
        FROM v_doc d LEFT JOIN labels l ON l.doc_id = d.id)""")
def _(t):
    tag = lambda c: F.struct(F.lit("1").alias("id"), c.alias("display_value"), c.alias("value"))
    tags = t.doc.select("id", F.array(tag(F.upper("project_id")), tag(F.col("creator_id"))).alias("tags"))
    four = F.col("id") % 4 == 0
    ai = t.table("labels").withColumnRenamed("doc_id", "id").join(t.doc.select("id", "project_id"), "id").select(
        "id", F.when(F.col("quality") == 1, F.concat(F.lit("AI "), "id")).alias("ai_description"),
        F.when(four, F.array(F.concat(F.lit(" "), "project_id"), F.lit("new tag "), F.lit(""), F.lit("New Tag")))
        .otherwise(F.array(F.lit("other"), F.lit("  "))).alias("accepted_ai_tags"))
    out = catalog.enrich(t.doc.select("id", "description"), tags, ai)
    shown = F.transform("tags", lambda x: F.concat(x["display_value"], F.lit(":"), F.when(x["is_ai"], "ai").otherwise("own")))
    return out.select("id", "description", joined(shown).alias("tags"))


@query("j2_batch_lookup", "SELECT id, creator_id FROM v_doc WHERE id IN (SELECT item_id FROM benchmark)")
def _(t):
    return catalog.lookup(t.doc, t.table("benchmark").select(F.col("item_id").alias("id")), "id").select("id", "creator_id")


@query("j3_append_page", "SELECT id, min(source) AS source FROM (SELECT id, 'a' AS source FROM v_task WHERE id % 2 = 0 UNION ALL SELECT id, 'b' FROM v_task WHERE id % 3 = 0) GROUP BY id")
def _(t):
    have = t.task.filter("id % 2 = 0").select("id", F.lit("a").alias("source"))
    return catalog.append_page(have, t.task.filter("id % 3 = 0").select("id", F.lit("b").alias("source")), "id")


@query("j10_resolve_tags", """SELECT key, coalesce(tag_id, 'new:' || key) AS tag_id, tag_id IS NULL AS is_new
    FROM (SELECT DISTINCT lower(x) AS key FROM (SELECT unnest(tags) AS x FROM v_tag)) w
    LEFT JOIN (SELECT lower(p_type) AS k, CAST(min(p_partkey) AS VARCHAR) AS tag_id FROM part GROUP BY 1) d ON d.k = w.key""")
def _(t):
    wanted = t.tag.select(F.explode("tags").alias("display_value"))
    defs = t.table("part").select(F.col("p_partkey").alias("id"), F.upper("p_type").alias("display_value"))
    return catalog.resolve_tags(wanted, defs)


@query("a9_distinct_tags_first", "SELECT lower(x) AS key, arg_min(x, id * 10 + i) AS value FROM (SELECT id, unnest(tags) AS x, unnest(range(len(tags))) AS i FROM v_tag) GROUP BY 1")
def _(t):
    flat = t.tag.select("id", F.posexplode("tags").alias("i", "x"))
    return catalog.distinct_tags(flat, F.lower("x"), F.col("x"), ["id", "i"], "first")


@query("a10_distinct_tags_last", "SELECT x AS key, arg_max('from ' || id, id * 10 + i) AS value FROM (SELECT id, unnest(tags) AS x, unnest(range(len(tags))) AS i FROM v_tag) GROUP BY 1")
def _(t):
    flat = t.tag.select("id", F.posexplode("tags").alias("i", "x"))
    return catalog.distinct_tags(flat, F.col("x"), F.concat(F.lit("from "), "id"), ["id", "i"], "last")


@query("a22_index_coverage", """SELECT count(*) AS total, count(*) FILTER (id % 5 = 0 OR contains(description, 'AI')) AS with_ai,
    count(*) FILTER (length(description) > 0 OR len(tags) > 0) AS with_content FROM v_doc""")
def _(t):
    df = t.doc.withColumn("ai_tags", F.when(F.col("id") % 5 == 0, F.array(F.lit("x"))))
    return catalog.index_coverage(df)


OPS = """ops AS (SELECT conv_id AS photo_id, turn AS seq, CASE WHEN length(text) % 5 = 0 THEN 'replace' WHEN length(text) % 5 < 3 THEN 'add'
    WHEN length(text) % 5 = 3 THEN CASE WHEN length(text) % 2 = 0 THEN 'remove' ELSE 'clear' END ELSE 'describe' END AS op,
    't' || (length(text) % 4) AS tag, ['t' || (length(text) % 3), 'base'] AS tags, role AS source, text FROM conversations)"""


@query("c8_fold_enhancements", f"""WITH {OPS}, resets AS (SELECT photo_id, max(seq) AS at FROM ops WHERE op = 'replace' GROUP BY 1),
    removed AS (SELECT photo_id, tag, max(seq) AS gone FROM ops WHERE op = 'remove' GROUP BY 1, 2),
    listed AS (SELECT b.* FROM (SELECT o.photo_id, o.seq, unnest(o.tags) AS tag, unnest(range(len(o.tags))) AS place FROM ops o JOIN resets r ON r.photo_id = o.photo_id AND r.at = o.seq) b
        LEFT JOIN removed d ON d.photo_id = b.photo_id AND d.tag = b.tag WHERE d.gone IS NULL OR b.seq > d.gone),
    added AS (SELECT o.photo_id, min(o.seq) AS seq, o.tag, 0 AS place FROM ops o LEFT JOIN resets r ON r.photo_id = o.photo_id LEFT JOIN removed d ON d.photo_id = o.photo_id AND d.tag = o.tag
        WHERE o.op = 'add' AND (r.at IS NULL OR o.seq > r.at) AND (d.gone IS NULL OR o.seq > d.gone)
        AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.photo_id = o.photo_id AND l.tag = o.tag) GROUP BY o.photo_id, o.tag),
    final AS (SELECT photo_id, string_agg(tag, ',' ORDER BY seq, place) AS tags FROM (SELECT photo_id, seq, tag, place FROM listed UNION ALL SELECT photo_id, seq, tag, place FROM added) GROUP BY 1)
    SELECT p.photo_id, coalesce(f.tags, '') AS tags,
    (SELECT CASE WHEN op = 'describe' THEN text END FROM ops o WHERE o.photo_id = p.photo_id AND op IN ('describe', 'clear') ORDER BY seq DESC LIMIT 1) AS description,
    (SELECT source FROM ops o WHERE o.photo_id = p.photo_id AND op IN ('replace', 'add', 'describe') ORDER BY seq DESC LIMIT 1) AS source
    FROM (SELECT DISTINCT photo_id FROM ops WHERE op IN ('replace', 'add', 'describe')) p LEFT JOIN final f ON f.photo_id = p.photo_id""")
def _(t):
    n = F.length("text")
    op = (F.when(n % 5 == 0, "replace").when(n % 5 < 3, "add").when(n % 5 == 3, F.when(n % 2 == 0, "remove").otherwise("clear")).otherwise("describe"))
    ops = t.table("conversations").select(
        F.col("conv_id").alias("photo_id"), F.col("turn").alias("seq"), op.alias("op"), F.concat(F.lit("t"), n % 4).alias("tag"),
        F.array(F.concat(F.lit("t"), n % 3), F.lit("base")).alias("tags"), F.col("role").alias("source"), "text")
    out = catalog.fold_enhancements(ops)
    return out.select("photo_id", joined(F.col("accepted_ai_tags")).alias("tags"), F.col("ai_description").alias("description"), F.col("suggestion_source").alias("source"))


@query("c9_mark_analysed", f"""SELECT id, epoch_us(CASE WHEN id % 5 = 0 THEN {NOW_SQL} ELSE analyzed_at END) AS analyzed,
    CASE WHEN id % 5 = 0 THEN 'v2' END AS version, CASE WHEN id % 5 = 0 THEN 'kept' END AS action FROM v_photo""")
def _(t):
    marks = t.photo.filter("id % 5 = 0").select("id", F.lit("kept").alias("user_action"))
    out, _counts = catalog.mark_analysed(t.photo, marks, EVENTS_NOW, "v2")
    return out.select("id", us("analyzed_at").alias("analyzed"), F.col("analysis_version").alias("version"), F.col("user_action").alias("action"))


@query("c9_mark_counts", "SELECT count(*) AS total, count(*) AS successful, CAST(0 AS BIGINT) AS failed FROM v_photo WHERE id % 5 = 0 UNION ALL "
                         "SELECT 2 * count(*), count(*), count(*) FROM v_photo")
def _(t):
    marks = t.photo.select("id", F.lit("kept").alias("user_action"))
    far = t.photo.select((F.col("id") + 10_000_000).alias("id"), F.lit("kept").alias("user_action"))
    a = catalog.mark_analysed(t.photo, marks.filter("id % 5 = 0"), EVENTS_NOW, "v2")[1]
    return a.unionByName(catalog.mark_analysed(t.photo, marks.unionByName(far), EVENTS_NOW, "v2")[1])


@query("c10_merge_posts", f"""SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'new text' ELSE description END AS content,
    CASE WHEN id % 3 = 0 THEN 'new title' ELSE project_id END AS title, CASE WHEN id % 2 = 0 THEN creator_id ELSE 'editor' END AS author,
    id % 3 = 0 AS touched FROM v_doc WHERE id % 2 = 0""" .replace("CASE WHEN id % 2 = 0 THEN creator_id ELSE 'editor' END", "creator_id"))
def _(t):
    i = F.col("id")
    meta = lambda title, author: F.struct(title.alias("title"), author.alias("author")).alias("metadata")
    none = F.lit(None).cast("timestamp")
    base = t.doc.withColumn("id", i.cast("string"))
    old = base.filter(i % 2 == 0).select("id", F.col("description").alias("content"), meta(F.col("project_id"), F.col("creator_id")),
                                         F.lit(ORDERS_NOW).cast("timestamp").alias("created_at"), F.lit(ORDERS_NOW).cast("timestamp").alias("updated_at"))
    # odd ids are new posts without content, so they are rejected
    new = base.filter(i % 3 == 0).select("id", F.when(F.col("id").cast("bigint") % 2 == 0, "new text").alias("content"),
                                         meta(F.lit("new title"), F.lit(None).cast("string")), none.alias("created_at"), none.alias("updated_at"))
    merged, _rejected = catalog.merge_posts(old, new, EVENTS_NOW)
    return merged.select(F.col("id").cast("bigint").alias("id"), "content", F.col("metadata.title").alias("title"), F.col("metadata.author").alias("author"),
                         (F.col("updated_at") == F.lit(EVENTS_NOW).cast("timestamp")).alias("touched"))


# --- sorting -----------------------------------------------------------------------------------

@query("t1_by_confidence", "SELECT id AS group_id, (id % 97) / 97.0 AS confidence FROM v_vec ORDER BY confidence DESC, group_id"
       .replace("(id % 97) / 97.0 AS confidence", f"{q4('(id % 97) / 97.0')} AS confidence"))
def _(t):
    g = t.vec.select(F.col("id").alias("group_id"), r4(F.col("id") % 97 / 97.0).alias("confidence"))
    return activity.by_confidence(g)


@query("t2_newest_posts", """SELECT id, CASE id % 3 WHEN 0 THEN strftime(make_date(2020 + CAST(id % 5 AS INTEGER), 1 + CAST(id % 12 AS INTEGER), 1 + CAST(id % 28 AS INTEGER)), '%Y-%m-%d') WHEN 1 THEN 'soon' END AS date,
    epoch_us(CASE id % 3 WHEN 0 THEN CAST(make_date(2020 + CAST(id % 5 AS INTEGER), 1 + CAST(id % 12 AS INTEGER), 1 + CAST(id % 28 AS INTEGER)) AS TIMESTAMP) ELSE TIMESTAMP '1970-01-01' END) AS sort_at FROM v_doc
    ORDER BY sort_at DESC, id LIMIT 500""")
def _(t):
    i = F.col("id")
    date = F.date_format(F.make_date(2020 + i % 5, 1 + i % 12, 1 + i % 28), "yyyy-MM-dd")
    posts = t.doc.select("id", F.when(i % 3 == 0, date).when(i % 3 == 1, "soon").alias("date"))
    return activity.newest_posts(posts, limit=500).withColumn("sort_at", us("sort_at"))


@query("t4_first_rows", "SELECT id, title FROM v_task ORDER BY created_at, id LIMIT 15")
def _(t):
    return activity.first_rows(t.task, ["created_at", "id"], 15).select("id", "title")


@query("t5_sort_tasks", "SELECT id, priority FROM v_task ORDER BY priority DESC, id")
def _(t):
    return activity.sort_tasks(t.task, "priority", False).select("id", "priority")
