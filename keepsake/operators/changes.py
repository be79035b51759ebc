"""Summaries of a change log: files per commit, messages, languages, categories."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import file_category, file_extension, file_language, labels, strings


def describe_files(df: DataFrame, path: str = "path") -> DataFrame:
    ext = file_extension(F.col(path))
    return (df.withColumn("extension", ext).withColumn("category", file_category(F.col(path)))
            .withColumn("language", file_language(ext)))


def architecture_signals(files: DataFrame, messages: DataFrame, message: str = "message") -> DataFrame:
    """One row with the labels that commit messages and changed files give."""
    msg = F.lower(F.col(message))
    said = messages.agg(
        F.bool_or(msg.contains("refactor")).alias("refactor"),
        F.bool_or(msg.contains("performance") | msg.contains("optimize")).alias("speed"),
        F.bool_or(msg.contains("test") | msg.contains("tdd")).alias("tests"))
    done = files.agg(
        F.bool_or(F.col("path").contains("api/")).alias("api"),
        F.bool_or((F.col("category") == "component") & F.col("is_new")).alias("parts"),
        F.bool_or(F.col("path").contains("util") & F.col("is_new")).alias("utils"))
    # two one-row aggregates side by side
    both = said.withColumn("_k", F.lit(1)).join(done.withColumn("_k", F.lit(1)), "_k")
    return both.select(labels(
        (F.col("refactor"), "Code refactoring"), (F.col("speed"), "Performance optimization"),
        (F.col("tests"), "Test-driven development"), (F.col("api"), "API development"),
        (F.col("parts"), "New component architecture"), (F.col("utils"), "New utility functions")).alias("signals"))


def change_summary(files: DataFrame, order: str = "path", keys=()) -> DataFrame:
    """Counts, sums, flags, categories and the first three languages per key (or overall)."""
    keys = list(keys)
    new, cat = F.col("is_new"), F.col("category")
    main = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(new).alias("new_files"),
        F.count_if(~new & (F.col("status") == "modified")).alias("modified_files"),
        F.count_if(F.col("status") == "deleted").alias("deleted_files"),
        F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.count_if(cat == "test").alias("test_files"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.bool_or((cat == "component") & new).alias("has_new_components"),
        F.bool_or((cat == "test") & new).alias("has_new_tests"),
        F.bool_or(cat == "api").alias("has_api_changes"),
        F.bool_or(cat.isin("component", "style")).alias("has_ui_changes"))
    seen = (files.filter(F.length("language") > 0).groupBy(*keys, "language").agg(F.min(order).alias("first")))
    if keys:
        rank = Window.partitionBy(*keys).orderBy("first", "language")
        seen = seen.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= 3)
    else:
        seen = seen.orderBy("first", "language").limit(3)
    firsts = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "language"))).alias("l"))
    firsts = firsts.select(*keys, F.transform("l", lambda x: x["language"]).alias("languages"))
    if not keys:
        return main.withColumn("_k", F.lit(1)).join(firsts.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    return main.join(firsts, keys, "left")


def session_progress(commits: DataFrame, start: datetime, ts="ts", message="message", added="added",
                     removed="removed") -> DataFrame:
    """Commits and changed lines after the start mark, with the last three messages; ``-`` counts 0."""
    after = commits.filter(F.col(ts) > F.lit(start).cast("timestamp"))
    lines = lambda c: F.coalesce(F.sum(F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))), F.lit(0))
    totals = after.agg(F.count(F.lit(1)).alias("commits"), lines(added).alias("lines_added"), lines(removed).alias("lines_removed"))
    last = after.orderBy(F.desc(ts), message).limit(3).agg(F.array_sort(F.collect_list(F.struct(ts, message))).alias("m"))
    last = last.select(F.reverse(F.transform("m", lambda x: x[message])).alias("recent"))
    return totals.withColumn("_k", F.lit(1)).join(last.withColumn("_k", F.lit(1)), "_k").drop("_k")


def derived_tags(session_tags: Column, summary: dict[str, Column], limit: int = 6) -> Column:
    """Session tags, flag tags, language tags and defaults: distinct, the first six."""
    langs, cats, signals = summary["languages"], summary["categories"], summary["signals"]
    in_ = lambda arr, v: F.array_contains(arr, v)
    names = F.filter(F.transform(langs, lambda x: F.when(x == "typescript", "TypeScript")
                                 .when(x == "javascript", "JavaScript").when(x == "css", "CSS")), lambda x: x.isNotNull())
    flags = labels((summary["has_new_components"], "React Components"), (summary["has_new_tests"], "Testing"),
                   (summary["has_api_changes"], "API Development"), (summary["has_ui_changes"], "UI/UX"))
    more = labels((in_(cats, "util"), "Utilities"), (in_(signals, "Performance optimization"), "Performance"),
                  (in_(signals, "Test-driven development"), "TDD"))
    every = F.concat(session_tags, flags, names, more, strings(["Development", "Technical Documentation"]))
    return F.slice(F.array_distinct(every), 1, limit)


def summary_sentence(name: Column, s: dict[str, Column]) -> Column:
    signal = F.lower(F.get(s["signals"], F.lit(0)))
    found = F.filter(F.array(
        F.when(s["has_new_components"], F.lit("new React components")),
        F.when(s["has_api_changes"], F.lit("API enhancements")),
        F.when(s["has_new_tests"], F.lit("comprehensive testing")),
        F.when(s["insertions"] > 500, F.lit("extensive code additions")), signal), lambda x: x.isNotNull())
    extra = F.when(F.size(found) > 3, F.format_string(", and %d other improvements", F.size(found) - 3)).otherwise(F.lit(""))
    return F.concat(F.lit("Implementation of "), name, F.lit(" featuring "), F.array_join(F.slice(found, 1, 3), ", "),
                    extra, F.format_string(". Includes %d lines of new code across %d files.", s["insertions"], s["files"]))
