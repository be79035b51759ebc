"""Ranking, recommendations and photo actions.

Groups are in long form, ``(group_id, member_id, ...)`` with one header row per group: a group of any
size stays spread over tasks, and no row ever holds a whole group.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.quality import confidence_level, keep_count, quality, time_saved_minutes
from ..session import materialize
from .catalog import latest_per_key

# A group above this size is ranked across tasks.
RANK_LIMIT = 1_000_000

# The texts of a recommendation.
TYPE_TEXT = {
    "exact_duplicates": "identical photos (exact duplicates)",
    "retry_shots": "multiple attempts at the same shot",
    "angle_variations": "different angles of the same subject",
    "incremental_progress": "incremental progress documentation",
    "redundant_documentation": "similar documentation content",
}
OTHER_TEXT = "similar photos"
ONE_KEPT = ("This photo captures everything you need with the best quality and most complete documentation.")
SOME_KEPT = "These %d photos provide the most comprehensive documentation while eliminating redundancy."
NOTHING_FOUND = "I've analyzed your photos and everything looks well organized!"
ONE_GROUP_TEXT = {
    "retry_shots": "I noticed %d photos that look like retry shots of the same thing. Would you like me to "
                   "recommend the best %d that capture everything you need?",
    "angle_variations": "I found %d photos showing the same work from different angles. I can help you pick "
                        "the %d most useful shots - want to see my suggestions?",
    "incremental_progress": "I see %d progress photos that tell a similar story. Would you like me to recommend "
                            "the %d key shots that best document the progression?",
}
ONE_GROUP_OTHER = ("I've noticed %d photos that appear very similar. I can help you streamline to the best %d "
                   "photos - shall I show you?")
GROUPS_TEXT = ("I found %d groups of similar photos (%d total). I can help you streamline these to %d photos "
               "that maintain all the important documentation.")
SAVINGS_TEXT = " This could save you about %d minute%s during photo reviews."


def ranked(df: DataFrame, keys, order, limit: int = RANK_LIMIT, name: str = "rank") -> DataFrame:
    """Row number within ``keys`` by ``order`` (a total order), also for groups too large for one task.

    Such groups are range-partitioned on the full order, so they span many tasks; each task numbers
    its rows and adds the rows of the same group in the tasks before it.
    """
    keys, order = list(keys), list(order)
    within = Window.partitionBy(*keys).orderBy(*order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = materialize(sizes.select(*keys), "hot-groups")
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(within).cast("bigint"))
    calm = df.join(hot, keys, "left_anti").withColumn(name, F.row_number().over(within).cast("bigint"))
    spread = df.join(hot, keys, "left_semi").repartitionByRange(*keys, *order)
    placed = materialize(spread.withColumn("_p", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
    local = Window.partitionBy(*keys, "_p").orderBy(*order)
    numbered = (placed.withColumn("_k", F.row_number().over(local)).join(offsets, keys + ["_p"])
                .withColumn(name, F.col("_k") + F.col("_o")).drop("_k", "_o", "_p"))
    return calm.unionByName(numbered.select(calm.columns))


def quality_order(q: str = "quality", id_col: str = "member_id"):
    other = (F.col(f"{q}.sharpness") + F.col(f"{q}.lighting") + F.col(f"{q}.composition")) / 3
    return [F.desc(f"{q}.documentation"), F.desc(f"{q}.information"), F.desc(other), F.col(id_col)]


def rank_members(groups: DataFrame, photos: DataFrame, id_col="id", limit: int = RANK_LIMIT) -> DataFrame:
    """Members with quality and rank, best first: documentation, information, mean of the rest, id."""
    q = quality(F.col("description"), F.col("tags"), F.col("has_coordinates"))
    scored = photos.select(F.col(id_col).alias("member_id"), q.alias("quality"))
    joined = groups.join(scored, "member_id")
    return ranked(joined.select("group_id", "member_id", "quality"), ["group_id"], quality_order(), limit)


def best_in_group(groups: DataFrame, photos: DataFrame, k: int, id_col="id") -> DataFrame:
    """The best ``k`` of each group; Spark keeps ``k`` per group and task before it exchanges rows."""
    q = quality(F.col("description"), F.col("tags"), F.col("has_coordinates"))
    joined = groups.join(photos.select(F.col(id_col).alias("member_id"), q.alias("quality")), "member_id")
    within = Window.partitionBy("group_id").orderBy(*quality_order())
    return joined.withColumn("rank", F.row_number().over(within).cast("bigint")).filter(F.col("rank") <= k)


def burst_ranking(members: DataFrame, scores: DataFrame, limit: int = RANK_LIMIT) -> DataFrame:
    """Members of burst groups by quality score, best first; a missing or zero score counts as 0.5."""
    joined = (members.filter(F.col("type") == "burst_sequence").select("group_id", "member_id")
              .join(scores, "member_id", "left")
              .withColumn("score", F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(0.5))))
    return ranked(joined, ["group_id"], [F.desc("score"), F.col("member_id")], limit)


def recommend(groups: DataFrame, headers: DataFrame, photos: DataFrame, id_col="id",
              limit: int = RANK_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Header and member rows of the recommendations.

    ``headers(group_id, type, overall, confidence)``. Headers gain size, keep count, rationale, minutes
    saved and confidence; members gain rank and action (``keep`` or ``archive``).
    """
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    head = headers.join(sizes, "group_id").withColumn("keep_count", F.least(F.col("size"), keep_count(F.col("type"), F.col("size"))))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_TEXT.items() for x in kv])[F.col("type")], F.lit(OTHER_TEXT))
    end = F.when(F.col("keep_count") == 1, F.lit(ONE_KEPT)).otherwise(F.format_string(SOME_KEPT, "keep_count"))
    head = head.select(
        "group_id", "type", "size", "keep_count",
        F.concat(F.format_string("I found %d photos showing ", "size"), kind, F.lit(". "), end).alias("rationale"),
        time_saved_minutes(F.col("size"), F.col("keep_count")).alias("minutes_saved"),
        F.least(F.lit(0.95), F.col("confidence") * 0.9 + F.col("overall") * 0.1).alias("confidence"))
    members = (rank_members(groups, photos, id_col, limit).join(head.select("group_id", "keep_count"), "group_id")
               .withColumn("action", F.when(F.col("rank") <= F.col("keep_count"), "keep").otherwise("archive"))
               .drop("keep_count"))
    return head, members


def rollup(headers: DataFrame, position: str = "group_id") -> DataFrame:
    """One row over all recommendations; the primary type is the most common, the earlier on a tie."""
    by_type = headers.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first"), F.sum("size").alias("size"),
        F.sum("keep_count").alias("keep"), F.sum("minutes_saved").alias("minutes"))
    # few types are left: the most common, and of those the one that came first
    top = F.min_by("type", F.struct((-F.col("n")).alias("n"), "first"))
    return by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("photos"),
                       F.coalesce(F.sum("keep"), F.lit(0)).alias("keep"),
                       F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes_saved"), top.alias("primary_type"))


def summary_message(total: DataFrame) -> DataFrame:
    one = None
    for kind, text in ONE_GROUP_TEXT.items():
        msg = F.format_string(text, "photos", "keep")
        one = F.when(F.col("primary_type") == kind, msg) if one is None else one.when(F.col("primary_type") == kind, msg)
    one = one.otherwise(F.format_string(ONE_GROUP_OTHER, "photos", "keep"))
    text = F.when(F.col("groups") == 1, one).otherwise(F.format_string(GROUPS_TEXT, "groups", "photos", "keep"))
    minutes = F.floor(F.col("minutes_saved") + 0.5)
    plural = F.when(F.col("minutes_saved") > 1, F.lit("s")).otherwise(F.lit(""))
    more = F.when(F.col("minutes_saved") >= 1, F.format_string(SAVINGS_TEXT, minutes, plural)).otherwise(F.lit(""))
    return total.withColumn("message", F.when(F.col("groups") == 0, F.lit(NOTHING_FOUND)).otherwise(F.concat(text, more)))


def actions_from(head: DataFrame, members: DataFrame, assistant: str = "Assistant") -> DataFrame:
    """Keep and archive actions with reason and group metadata."""
    info = head.select("group_id", F.col("type").alias("group_type"), "confidence", "rationale")
    keep = F.concat(F.lit(f"{assistant} recommended to keep - "), F.col("rationale"))
    drop = F.lit(f"{assistant} archived - similar to kept photo in same group")
    return members.join(info, "group_id").select(
        F.col("member_id").alias("photo_id"), F.col("action").alias("type"),
        F.when(F.col("action") == "keep", keep).otherwise(drop).alias("reason"),
        "group_id", "group_type", "confidence", "rationale", F.col("rank").cast("bigint").alias("seq"))


ACTION_TYPES = ["archive", "keep", "tag", "delete", "restore"]


def apply_actions(photos: DataFrame, actions: DataFrame, now: datetime,
                  id_col="id") -> tuple[DataFrame, DataFrame]:
    """Photos after the actions, and every action with its status (``applied`` or ``failed``).

    Each action starts from the photo as it was, so the last by ``seq`` decides. Actions on unknown
    photos or of unknown type fail.
    """
    known = photos.select(F.col(id_col).alias("photo_id")).withColumn("_known", F.lit(True))
    ok = F.col("_known").isNotNull() & F.col("type").isin(ACTION_TYPES)
    result = (actions.join(known, "photo_id", "left")
              .withColumn("status", F.when(ok, "applied").otherwise("failed")).drop("_known"))
    valid = actions.filter(F.col("type").isin(ACTION_TYPES)).select("photo_id", "seq", "type", "reason")
    last = latest_per_key(valid, "photo_id", ["seq"]).select(
        F.col("photo_id").alias(id_col), F.col("type").alias("_type"), F.col("reason").alias("_reason"))
    stamp = F.lit(now).cast("timestamp")
    away = F.col("_type").isin("archive", "delete")
    back = F.col("_type") == "restore"
    none_ts = F.lit(None).cast("timestamp")
    updated = photos.join(last, id_col, "left").select(
        *[c for c in photos.columns if c not in ("archive_state", "archived_at", "archive_reason")],
        F.when(F.col("_type") == "archive", "archived").when(F.col("_type") == "delete", "pending_deletion")
        .when(F.col("_type").isNotNull(), "active").otherwise(F.col("archive_state")).alias("archive_state"),
        F.when(away, stamp).when(back, none_ts).otherwise(F.col("archived_at")).alias("archived_at"),
        F.when(away, F.col("_reason")).when(back, F.lit(None).cast("string"))
        .otherwise(F.col("archive_reason")).alias("archive_reason"))
    return updated, result


def action_summary(result: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    total = F.count(F.lit(1))
    text = F.format_string("Some actions failed: %d of %d actions failed to apply", failed, total)
    return result.agg(F.count_if(F.col("status") == "applied").alias("applied"), failed.alias("failed"),
                      (failed == 0).alias("success"), F.when(failed > 0, text).alias("error"))


def set_archive_state(photos: DataFrame, ids: DataFrame, action: str, reason: str | None, now: datetime,
                      id_col="id", check: bool = True) -> DataFrame:
    """Archive or restore the given photos; an unknown id is an error."""
    if check:
        missing = ids.join(photos.select(id_col), id_col, "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"Photo not found: {missing[0][id_col]}")
    actions = ids.select(F.col(id_col).alias("photo_id"), F.lit(action).alias("type"),
                         F.lit(reason).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("seq"))
    return apply_actions(photos, actions, now, id_col)[0]


def undo_last(photos: DataFrame, log: DataFrame, now: datetime, id_col="id") -> tuple[DataFrame, DataFrame]:
    """Photos after undoing the newest entry of ``log(entry_seq, suggestion_id, idx, type, photo_id)``,
    and the suggestion that goes back to pending. Archives are restored, restores archived again."""
    newest = log.agg(F.max("entry_seq").alias("entry_seq"))
    entry = log.join(F.broadcast(newest), "entry_seq")
    inverse = F.when(F.col("type") == "archive", "restore").otherwise("archive")
    # undone from the last action to the first
    actions = entry.select("photo_id", inverse.alias("type"), F.lit("Undo restore").alias("reason"),
                           (-F.col("idx")).cast("bigint").alias("seq"))
    status = entry.select("suggestion_id", F.lit("pending").alias("status")).distinct()
    return apply_actions(photos, actions, now, id_col)[0], status


def suggestion_confidence(groups: DataFrame, confidence="confidence", high=0.85, medium: float | None = 0.7) -> DataFrame:
    """Mean confidence and its level; without ``medium`` there are two levels above an empty input."""
    mean = F.avg(confidence)
    level = confidence_level(mean, high, medium) if medium is not None else (
        F.when(mean.isNull(), "low").when(mean > high, "high").otherwise("medium"))
    return groups.agg(F.count(F.lit(1)).alias("groups"), mean.alias("mean_confidence"), level.alias("level"))


def latest_status(events: DataFrame, keys, order, status="status", initial: str = "pending") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return events.groupBy(*keys).agg(
        F.coalesce(F.max_by(status, F.struct(*order)), F.lit(initial)).alias("status"), F.count(F.lit(1)).alias("changes"))
