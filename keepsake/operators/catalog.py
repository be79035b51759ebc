"""Catalog joins, keyed tables and record merges.

Keyed operations use aggregates with map-side combine (``max_by``) rather than one window per key, so
a key that holds a third of the rows never lands whole in one task.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ai_tag_id, strings

TAG_TYPE = "struct<id:string,display_value:string,value:string,is_ai:boolean>"


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The last row of each key by ``order`` columns, as one partial aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(df.columns)


def merge_tags(photo_id: Column, tags: Column, ai_tags: Column) -> Column:
    """Flag tags that AI confirmed, append the other AI tags once each, trimmed and without blanks.

    ``tags`` is ``array<struct<id,display_value,value>>``, ``ai_tags`` is ``array<string>``.
    """
    clean = F.filter(F.transform(F.coalesce(ai_tags, strings([])), lambda t: F.trim(t)),
                     lambda t: F.length(t) > 0)
    low = F.transform(clean, lambda t: F.lower(t))
    # the first spelling of each AI tag is the one that is added
    first = F.filter(F.transform(clean, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                     lambda x: F.array_position(low, F.lower(x["t"])) == x["i"] + 1)
    have = F.transform(tags, lambda t: F.lower(t["display_value"]))
    kept = F.transform(tags, lambda t: F.struct(
        t["id"].cast("string").alias("id"), t["display_value"].alias("display_value"),
        t["value"].alias("value"),
        F.array_contains(low, F.lower(t["display_value"])).alias("is_ai")).cast(TAG_TYPE))
    added = F.transform(F.filter(first, lambda x: ~F.array_contains(have, F.lower(x["t"]))),
                        lambda x: F.struct(
                            ai_tag_id(photo_id, x["t"]).alias("id"), x["t"].alias("display_value"),
                            F.lower(x["t"]).alias("value"), F.lit(True).alias("is_ai")).cast(TAG_TYPE))
    return F.concat(kept, added)


def enrich(photos: DataFrame, tags: DataFrame, enhancements: DataFrame, id_col: str = "id") -> DataFrame:
    """Photos with merged tags and the AI description where there is one.

    ``tags(id, tags)`` and ``enhancements(id, ai_description, accepted_ai_tags)`` hold one row per photo.
    """
    own = F.coalesce(F.col("tags"), F.array().cast("array<struct<id:string,display_value:string,value:string>>"))
    ai_text = F.nullif(F.col("ai_description"), F.lit(""))
    return (photos.join(tags, id_col, "left").join(enhancements, id_col, "left")
            .withColumn("tags", merge_tags(F.col(id_col), own, F.col("accepted_ai_tags")))
            .withColumn("description", F.coalesce(ai_text, F.col("description")))
            .drop("ai_description", "accepted_ai_tags"))


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted; Catalyst broadcasts ``ids`` only while it is small."""
    return table.join(ids.select(key), key, "left_semi")


def delete_keys(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def append_page(have: DataFrame, page: DataFrame, key: str) -> DataFrame:
    return have.unionByName(page.join(have.select(key), key, "left_anti"))


def upsert(current: DataFrame, changes: DataFrame, key: str, now: datetime, order) -> DataFrame:
    """New snapshot: the last change per key wins; inserts stamp both times, updates ``updated_at``."""
    stamp = F.lit(now).cast("timestamp")
    last = latest_per_key(changes, key, order)
    cols = [c for c in current.columns if c not in (key, "created_at", "updated_at")]
    new = last.select(key, F.struct(*cols).alias("_new"))
    joined = current.select(key, F.struct(*cols, "created_at", "updated_at").alias("_old")).join(new, key, "full")
    changed = F.col("_new").isNotNull()
    return joined.select(
        key, *[F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in cols],
        F.coalesce(F.col("_old.created_at"), stamp).alias("created_at"),
        F.when(changed, stamp).otherwise(F.col("_old.updated_at")).alias("updated_at"))


def resolve_tags(wanted: DataFrame, definitions: DataFrame, name: str = "display_value",
                 order: str = "id") -> DataFrame:
    """Tag id of each wanted name, compared without case; unknown names get a new definition.

    The first definition by ``order`` answers for a name. Returns ``(key, tag_id, is_new)``.
    """
    defs = (definitions.groupBy(F.lower(F.col(name)).alias("key"))
            .agg(F.min(order).cast("string").alias("tag_id")))
    names = wanted.groupBy(F.lower(F.col(name)).alias("key")).agg(F.min(name).alias("_name"))
    return (names.join(defs, "key", "left")
            .select("key", F.coalesce("tag_id", F.concat(F.lit("new:"), F.col("key"))).alias("tag_id"),
                    F.col("tag_id").isNull().alias("is_new")))


def distinct_tags(df: DataFrame, tag_key: Column, value: Column, order, keep: str = "first") -> DataFrame:
    """One ``(key, value)`` per distinct tag key, first or last seen by ``order``."""
    pick = F.min_by if keep == "first" else F.max_by
    return (df.select(tag_key.alias("key"), value.alias("value"), F.struct(*order).alias("_o"))
            .filter(F.col("key").isNotNull())
            .groupBy("key").agg(pick("value", "_o").alias("value")))


def fold_enhancements(ops: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Final enhancement per photo after an ordered log of changes.

    ``ops(photo_id, seq, op, tags, tag, text, source)`` with op in ``replace`` (tags), ``add`` (tag),
    ``remove`` (tag), ``describe`` (text) and ``clear``. ``existing`` rows enter as changes before the
    log. Only what follows the last replacement counts for the tags. They come back in the order in
    which they entered: a replacement keeps its order and repeats, adding a tag that is there changes
    nothing, and a tag that was removed and added again is last. Removing and clearing never create a
    record and never set the source.
    """
    log = ops.select("photo_id", "seq", "op", "tags", "tag", "text", "source")
    if existing is not None:
        old = existing.select("photo_id", F.lit(-1).cast("bigint").alias("seq"),
                              F.explode(F.array(F.lit("replace"), F.lit("describe"))).alias("op"),
                              F.col("accepted_ai_tags").alias("tags"), F.lit(None).cast("string").alias("tag"),
                              F.col("ai_description").alias("text"), F.col("suggestion_source").alias("source"))
        log = old.unionByName(log)
    is_text, makes = F.col("op").isin("describe", "clear"), F.col("op").isin("replace", "add", "describe")
    replaced = F.when(F.col("op") == "replace", F.col("seq"))
    head = log.groupBy("photo_id").agg(
        (F.count_if(makes) > 0).alias("made"), F.max(replaced).alias("reset"), F.max_by("tags", replaced).alias("base"),
        F.max_by(F.when(F.col("op") == "describe", F.col("text")), F.when(is_text, F.col("seq"))).alias("ai_description"),
        F.max_by("source", F.when(makes & (F.length("source") > 0), F.col("seq"))).alias("source")).filter("made")
    single = log.filter(F.col("op").isin("add", "remove") & (F.length(F.trim("tag")) > 0))
    removed = single.filter("op = 'remove'").groupBy("photo_id", "tag").agg(F.max("seq").alias("gone"))
    after = F.col("gone").isNull() | (F.col("seq") > F.col("gone"))
    listed = (head.select("photo_id", F.col("reset").alias("seq"), F.posexplode("base").alias("place", "tag"))
              .filter(F.length(F.trim("tag")) > 0).join(removed, ["photo_id", "tag"], "left").filter(after))
    added = (single.filter("op = 'add'").join(head.select("photo_id", "reset"), "photo_id")
             .filter(F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
             .join(removed, ["photo_id", "tag"], "left").filter(after)
             .groupBy("photo_id", "tag").agg(F.min("seq").alias("seq"))
             .join(listed.select("photo_id", "tag"), ["photo_id", "tag"], "left_anti"))
    cols = ["photo_id", "seq", "place", "tag"]
    entries = listed.select(*cols).unionByName(added.withColumn("place", F.lit(0)).select(*cols))
    state = entries.groupBy("photo_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "place", "tag"))), lambda e: e["tag"]).alias("accepted_ai_tags"))
    return (head.join(state, "photo_id", "left")
            .select("photo_id", "ai_description",
                    F.coalesce("accepted_ai_tags", strings([])).alias("accepted_ai_tags"),
                    F.coalesce("source", F.lit("Unknown")).alias("suggestion_source")))


def mark_analysed(photos: DataFrame, marks: DataFrame, now: datetime, version: str,
                  id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Stamp analysis time, version and user action; one summary row counts hits and misses."""
    stamp = F.lit(now).cast("timestamp")
    acts = latest_per_key(marks.select(id_col, "user_action"), id_col, "user_action")
    hit = acts.withColumn("_hit", F.lit(True)).withColumnRenamed("user_action", "_action")
    drop = [c for c in ("analyzed_at", "analysis_version", "user_action") if c in photos.columns]
    base = photos.select("*", *[F.lit(None).cast("timestamp" if c == "analyzed_at" else "string").alias(c)
                                for c in ("analyzed_at", "analysis_version", "user_action") if c not in drop])
    joined = base.join(hit, id_col, "left")
    marked = joined.select(
        *[c for c in base.columns if c not in ("analyzed_at", "analysis_version", "user_action")],
        F.when(F.col("_hit"), stamp).otherwise(F.col("analyzed_at")).alias("analyzed_at"),
        F.when(F.col("_hit"), F.lit(version)).otherwise(F.col("analysis_version")).alias("analysis_version"),
        F.when(F.col("_hit"), F.col("_action")).otherwise(F.col("user_action")).alias("user_action"))
    known = photos.select(id_col).withColumn("_known", F.lit(True))
    counts = hit.join(known, id_col, "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_known")).alias("successful"),
        F.count_if(F.col("_known").isNull()).alias("failed"))
    return marked, counts


def merge_posts(existing: DataFrame, updates: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Partial update of posts with nested metadata; new posts without id, title or content are rejected.

    Both sides hold ``(id, content, metadata struct, created_at, updated_at)``; null means "not given".
    """
    stamp = F.lit(now).cast("timestamp")
    fields = existing.schema["metadata"].dataType.fieldNames()
    old = existing.select("id", F.struct("content", "metadata", "created_at", "updated_at").alias("o"))
    new = updates.select("id", F.struct("content", "metadata", "created_at").alias("n"))
    both = old.join(new, "id", "full")
    is_new, touched = F.col("o").isNull(), F.col("n").isNotNull()
    complete = ~is_new | ((F.length("id") > 0) & (F.length("n.metadata.title") > 0) & (F.length("n.content") > 0))
    ok = F.coalesce(complete, F.lit(False))
    merged = both.filter(ok).select(
        "id", F.coalesce("n.content", "o.content").alias("content"),
        F.struct(*[F.coalesce(F.col(f"n.metadata.{f}"), F.col(f"o.metadata.{f}")).alias(f) for f in fields])
        .alias("metadata"),
        F.coalesce("o.created_at", "n.created_at", F.when(touched, stamp)).alias("created_at"),
        F.when(touched, stamp).otherwise(F.col("o.updated_at")).alias("updated_at"))
    return merged, both.filter(~ok).select("id")


def index_text(id_: Column, description: Column, tags: Column, project_name: Column) -> Column:
    """Text that stands for a record in a vector index."""
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    project = F.when(F.length(project_name) > 0, F.concat(F.lit("Project: "), project_name))
    text = F.concat_ws(". ", F.nullif(description, F.lit("")), listed, project)
    return F.when(F.length(text) > 0, text).otherwise(F.concat(F.lit("Photo "), id_.cast("string")))


def merged_tag_values(own: Column, ai: Column) -> Column:
    """Own tag values, then AI tags not yet present, compared without case."""
    ai = F.coalesce(ai, strings([]))
    have = F.transform(own, lambda t: F.lower(t))
    low = F.transform(ai, lambda t: F.lower(t))
    extra = F.filter(F.transform(ai, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                     lambda x: (F.array_position(low, F.lower(x["t"])) == x["i"] + 1)
                     & ~F.array_contains(have, F.lower(x["t"])))
    return F.concat(own, F.transform(extra, lambda x: x["t"]))


def index_records(photos: DataFrame, enhancements: DataFrame, id_col: str = "id") -> DataFrame:
    """Flat index rows with AI tags and descriptions merged in."""
    joined = photos.join(enhancements, id_col, "left")
    description = F.coalesce(F.nullif(F.col("ai_description"), F.lit("")), F.col("description"), F.lit(""))
    project = F.concat(F.lit("Project "), F.col("project_id").cast("string"))
    tags = merged_tag_values(F.col("tags"), F.col("accepted_ai_tags"))
    return joined.select(id_col, "project_id", project.alias("project_name"), description.alias("description"),
                         tags.alias("tags"), "creator_id").withColumn(
        "text", index_text(F.col(id_col), F.col("description"), F.col("tags"), F.col("project_name")))


def index_coverage(df: DataFrame, description="description", tags="tags", ai_tags="ai_tags") -> DataFrame:
    enhanced = (F.coalesce(F.size(ai_tags), F.lit(0)) > 0) | F.coalesce(F.contains(F.col(description), F.lit("AI")), F.lit(False))
    content = (F.coalesce(F.length(description), F.lit(0)) > 0) | (F.coalesce(F.size(tags), F.lit(0)) > 0)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(enhanced).alias("with_ai"),
                  F.count_if(content).alias("with_content"))
