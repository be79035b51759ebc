"""Catalog filters. Only the active predicates enter the plan; ``now`` is always an argument."""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quality import estimated_mb
from ..functions.text import any_of, strings


def _ts(value: datetime | None):
    return None if value is None else F.lit(value).cast("timestamp")


def _all(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0] if conditions else F.lit(True)
    for c in conditions[1:]:
        out = out & c
    return out


def in_date_range(ts: Column, start: datetime | None = None, end: datetime | None = None,
                  missing: bool = False) -> Column:
    """Inclusive at both ends. A missing time fails a bounded range unless ``missing``."""
    tests = ([ts >= _ts(start)] if start else []) + ([ts <= _ts(end)] if end else [])
    # plain comparisons, so that a filter on them reaches the scan
    inside = _all(tests)
    return ts.isNull() | inside if missing and tests else inside


def in_size_range(width: Column, height: Column, low: float = 0, high: float = 100) -> Column:
    return estimated_mb(width, height).between(low, high)


def at_least(width: Column, height: Column, min_width: int = 0, min_height: int = 0) -> Column:
    return (F.coalesce(width, F.lit(0)) >= min_width) & (F.coalesce(height, F.lit(0)) >= min_height)


def tag_contains_any(tags: Column, wanted) -> Column:
    return F.coalesce(F.exists(tags, lambda t: any_of(
        [F.lower(t).contains(w.lower()) for w in wanted])), F.lit(False))


def search_text(*parts: Column) -> Column:
    """Lower-case text to search: strings and string arrays joined by spaces, nulls skipped."""
    return F.lower(F.concat_ws(" ", *parts))


def matches_search(text: Column, query: str) -> Column:
    """Every space-separated term of ``query`` is a substring of the lower-case ``text``."""
    return _all([text.contains(t) for t in query.lower().split(" ") if t])


def tags_match(tags: Column, wanted, logic: str = "OR") -> Column:
    """Case-insensitive exact match on all (``AND``) or any (``OR``) wanted tags."""
    low = F.transform(tags, lambda t: F.lower(t))
    want = strings(sorted({w.lower() for w in wanted}))
    if logic == "AND":
        hit = F.size(F.array_except(want, low)) == 0
    elif logic == "OR":
        hit = F.arrays_overlap(F.filter(low, lambda t: t.isNotNull()), want)
    else:
        raise ValueError(f"unknown tag logic: {logic}")
    return F.coalesce(hit & tags.isNotNull(), F.lit(False)) if wanted else F.lit(True)


def has_all(values: Column, wanted) -> Column:
    """The array holds every wanted value, case-sensitive (tag ids, stored tag lists)."""
    return F.coalesce(F.size(F.array_except(strings(list(wanted)), values)) == 0, F.lit(False))


def archive_state_is(state: Column, wanted: str) -> Column:
    return F.coalesce(F.nullif(state, F.lit("")), F.lit("active")) == wanted


def not_archived(state: Column) -> Column:
    return F.coalesce(state != "archived", F.lit(True))


@dataclass(frozen=True)
class Criteria:
    start: datetime | None = None
    end: datetime | None = None
    min_mb: float = 0
    max_mb: float = 100
    min_width: int = 0
    min_height: int = 0
    tags: tuple = ()
    search: str = ""


def preset(name: str, now: datetime) -> Criteria:
    """Named criteria. Fixed values."""
    presets = {
        "high-res": Criteria(min_width=2048, min_height=1536, min_mb=2),
        "recent": Criteria(start=now - timedelta(days=7)),
        "large-files": Criteria(min_mb=5),
        "tagged": Criteria(tags=("important", "progress", "issue")),
    }
    return presets[name]


STAGES = ("date_range", "file_size", "dimensions", "tags", "search")


def stage_predicates(c: Criteria, captured_at="captured_at", width="width", height="height",
                     tags="tags", filename="filename", description="description") -> dict[str, Column]:
    """The active stages of ``c`` in order, cheapest first, with their predicates."""
    out = {}
    if c.start or c.end:
        # records without a readable time are kept by this filter
        out["date_range"] = in_date_range(F.col(captured_at), c.start, c.end, missing=True)
    if c.min_mb > 0 or c.max_mb < 100:
        out["file_size"] = in_size_range(F.col(width), F.col(height), c.min_mb, c.max_mb)
    if c.min_width > 0 or c.min_height > 0:
        out["dimensions"] = at_least(F.col(width), F.col(height), c.min_width, c.min_height)
    if c.tags:
        out["tags"] = tag_contains_any(F.col(tags), c.tags)
    if c.search.strip():
        text = search_text(F.col(filename), F.col(description), F.col(tags))
        out["search"] = matches_search(text, c.search)
    return out


def apply_criteria(df: DataFrame, c: Criteria, **columns) -> DataFrame:
    return df.filter(_all(stage_predicates(c, **columns).values()))


def filter_funnel(df: DataFrame, c: Criteria, **columns) -> DataFrame:
    """One row: rows in, rows left after each active stage (inactive stages report the input)."""
    aggs, passed, n = [F.count(F.lit(1)).alias("total")], F.lit(True), F.count(F.lit(1))
    active = stage_predicates(c, **columns)
    for stage in STAGES:
        if stage in active:
            passed = passed & active[stage]
            aggs.append(F.count_if(passed).alias(stage))
        else:
            aggs.append(n.alias(stage))
    return df.agg(*aggs, F.count_if(passed).alias("matched"))


@dataclass(frozen=True)
class Selection:
    """What an analysis run covers."""
    mode: str = "smart"
    start: datetime | None = None
    end: datetime | None = None
    ids: DataFrame | None = field(default=None, compare=False)
    new_days: int = 7
    force: bool = False
    include_archived: bool = False


def validate_selection(s: Selection) -> str | None:
    """The error text of an invalid selection, else None."""
    if s.mode == "date-range":
        if not s.start or not s.end:
            return "Start date and end date are required for date-range mode"
        if s.start > s.end:
            return "Start date must be before end date"
    if s.mode == "selection" and (s.ids is None or s.ids.isEmpty()):
        return "At least one photo must be selected"
    return None


def describe_selection(s: Selection) -> str:
    archived = " including archived" if s.include_archived else " excluding archived"
    if s.mode == "smart":
        plural = "" if s.new_days == 1 else "s"
        again = " (re-analyzing all)" if s.force else ""
        return f"New photos from last {s.new_days} day{plural}{again}{archived}"
    if s.mode == "date-range":
        if not s.start or not s.end:
            return "Custom date range"
        again = " (re-analyzing all)" if s.force else " (new only)"
        return f"{s.start:%Y-%m-%d} to {s.end:%Y-%m-%d}{again}"
    if s.mode == "all":
        return f"All photos (re-analyzing{archived})" if s.force else f"All unanalyzed photos{archived}"
    if s.mode == "selection":
        n = 0 if s.ids is None else s.ids.count()
        return f"{n} selected photo{'' if n == 1 else 's'}"
    return "Unknown mode"


def needs_analysis(captured: Column, analyzed: Column, cutoff: Column) -> Column:
    """Never analysed, captured after its analysis, or analysed before the cutoff."""
    return analyzed.isNull() | F.coalesce((captured > analyzed) | (analyzed < cutoff), F.lit(False))


def select_for_analysis(df: DataFrame, s: Selection, now: datetime, id_col: str = "id",
                        captured="captured_at", analyzed="analyzed_at",
                        state="archive_state") -> DataFrame:
    cap, done = F.col(captured), F.col(analyzed)
    base = df if s.include_archived else df.filter(not_archived(F.col(state)))
    if s.mode == "smart":
        cutoff = _ts(now - timedelta(days=s.new_days))
        if s.force:
            return base.filter(cap >= cutoff)
        recent = F.coalesce(cap >= cutoff, F.lit(False))
        stale = F.coalesce((cap > done) | (done < cutoff), F.lit(False))
        return base.filter(F.when(done.isNull(), recent).otherwise(stale))
    if s.mode == "date-range":
        if not s.start or not s.end:
            raise ValueError("Start date and end date are required for date-range mode")
        hit = base.filter(in_date_range(cap, s.start, s.end))
        return hit if s.force else hit.filter(done.isNull())
    if s.mode == "all":
        return base if s.force else base.filter(done.isNull())
    if s.mode == "selection":
        if s.ids is None:
            raise ValueError("Selected photo IDs are required for selection mode")
        return base.join(s.ids.select(id_col), id_col, "left_semi")
    raise ValueError(f"Unknown analysis mode: {s.mode}")


def estimate_selection(df: DataFrame, s: Selection, now: datetime, **columns) -> DataFrame:
    """One row ``(n, description)``; an invalid selection counts 0 and gives its error text."""
    try:
        return (select_for_analysis(df, s, now, **columns).agg(F.count(F.lit(1)).alias("n"))
                .withColumn("description", F.lit(describe_selection(s))))
    except ValueError as error:
        return df.sparkSession.createDataFrame([(0, str(error))], "n bigint, description string")


def new_records(df: DataFrame, now: datetime, days: int = 7, captured="captured_at",
                analyzed="analyzed_at") -> DataFrame:
    return df.filter(needs_analysis(F.col(captured), F.col(analyzed), _ts(now - timedelta(days=days))))


def active_notifications(df: DataFrame, now: datetime, due="scheduled_deletion_at",
                         dismissed="dismissed") -> DataFrame:
    return df.filter(~F.col(dismissed) & (F.col(due) >= _ts(now)))


def retained_notifications(df: DataFrame, now: datetime, due="scheduled_deletion_at",
                           dismissed="dismissed", created="created_at") -> DataFrame:
    """Active ones, and dismissed ones created within seven days."""
    live = ~F.col(dismissed) & (F.col(due) > _ts(now))
    recent = F.col(dismissed) & (F.col(created) > _ts(now - timedelta(days=7)))
    return df.filter(live | recent)


def split_by_confidence(groups: DataFrame, threshold: float = 0.85,
                        confidence: str = "confidence") -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col(confidence) >= threshold, F.lit(False))
    return groups.filter(ok), groups.filter(~ok)


def new_suggestions(suggested: Column, existing: Column) -> Column:
    """Suggested tags that are not present yet, compared without case; order and repeats are kept."""
    have = F.transform(F.coalesce(existing, strings([])), lambda t: F.lower(t))
    return F.filter(suggested, lambda t: ~F.array_contains(have, F.lower(t)))


def filter_tasks(df: DataFrame, query: str = "", statuses=(), priorities=(), assignee=None, tags=(),
                 due_start: datetime | None = None, due_end: datetime | None = None) -> DataFrame:
    tests = []
    if query.strip():
        text = search_text(F.col("title"), F.col("description"), F.col("assignee").cast("string"), F.col("tags"))
        tests.append(matches_search(text, query))
    if statuses:
        tests.append(F.col("status").isin(list(statuses)))
    if priorities:
        tests.append(F.col("priority").isin(list(priorities)))
    if assignee is not None:
        tests.append(F.col("assignee") == assignee)
    if tags:
        tests.append(tag_contains_any(F.col("tags"), tags))
    if due_start or due_end:
        tests.append(in_date_range(F.col("due_at"), due_start, due_end))
    return df.filter(_all(tests))


def filter_decisions(df: DataFrame, which: str = "all", decision: str = "decision") -> DataFrame:
    wanted = {"burst_shots": "burst_shot", "unique": "unique"}.get(which)
    return df if wanted is None else df.filter(F.col(decision) == wanted)


def tag_name_contains(tag: Column, query: str) -> Column:
    return F.lower(tag).contains(query.lower())


def tag_filter(df: DataFrame, wanted, logic: str = "OR", show_archived: bool = False,
               tags: str = "tags", state: str = "archive_state", by: str = "value") -> DataFrame:
    """Archive view, then tags by display value (AND / OR) or, with ``by='id'``, all ids present."""
    base = df if show_archived else df.filter(not_archived(F.col(state)))
    hit = has_all(F.col(tags), wanted) if by == "id" and wanted else tags_match(F.col(tags), wanted, logic)
    return base.filter(hit)


def narrowed(c: Criteria, **changes) -> Criteria:
    return replace(c, **changes)
