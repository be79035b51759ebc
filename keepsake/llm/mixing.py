"""Mixing sources to target weights by subset-sum budget fitting.

The size of a text is its number of words. Every source gets a target number of words; it is met by
whole passes over the source and, for what remains, by a subset of its documents. The subset is chosen
by length, not by document:

1. count the documents of each source by exact length;
2. take the same share of every length, rounded down, and greedily more of the longest that fit until
   the rest is small; a bounded-knapsack dynamic program over the documents that are left then finds
   the reachable sum nearest to that rest;
3. select, for each length, that many documents by a seeded hash.

The counts are the only thing a source's task holds: one row for each distinct length. The selection
never sorts a whole length: ranges of the hash with a few thousand documents each are counted, and only
the range at the boundary is ranked, so any number of documents may share source and length. The key of
the last document taken then decides for every document on its own. Rows with the same id and text have
one key and so share their fate.

A null text has size 0. A null source is a source, last in order. A document of size 0 is never taken.
If all sizes are 0 every target is 0. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, Workspace, session

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Words left to the dynamic program, and the most lengths it may combine.
REST, LENGTHS = 65_536, 512
BUCKET = 4_096
#: Rows of (source, length) that may be broadcast, about 60 bytes each; more are joined by shuffling.
MOST_CELLS = 500_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Targets of sources in order: weights repeat; the sum is that of the sizes; no target is above
    ``most`` times its source's size, and the excess goes to the others by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = left / sum(own[i] for i in open_)
        above = [i for i in open_ if own[i] * share > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = own[i] * share
            break
        for i in above:
            out[i] = float(most * sizes[i])
            open_.remove(i)
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is the reachable one nearest to ``budget``,
    from below if two are equally near. ``lengths`` are positive and distinct."""
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return take
    limit = budget + int(lengths.min())
    mask = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    for i in range(len(lengths)):
        left, piece = int(min(counts[i], limit // lengths[i])), 1
        while left > 0:  # binary splitting of the bound
            piece = min(piece, left)
            steps.append((i, piece, reach))
            reach |= (reach << (int(lengths[i]) * piece)) & mask
            left, piece = left - piece, piece * 2
        if reach >> budget & 1:
            break
    best = next(budget - d if d <= budget and reach >> (budget - d) & 1 else budget + d
                for d in range(limit + 1)
                if (d <= budget and reach >> (budget - d) & 1) or (budget + d <= limit and reach >> (budget + d) & 1))
    for i, piece, before in reversed(steps):
        if not before >> best & 1:
            take[i] += piece
            best -= int(lengths[i]) * piece
    return take


def plan(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole passes, and how many documents of each length to take once more."""
    total = int((lengths * counts).sum())
    if total <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    passes, rest = divmod(int(round(target)), total)
    take = np.zeros(len(lengths), np.int64)
    take[lengths > 0] = (counts[lengths > 0] * (rest / total)).astype(np.int64)
    rest -= int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= REST:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), (rest - REST) // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    # the dynamic program combines the shortest lengths: they make every small sum reachable
    free = np.flatnonzero((lengths > 0) & (take < counts))
    free = free[np.argsort(lengths[free], kind="stable")][:LENGTHS]
    take[free] += knapsack(lengths[free], (counts - take)[free], rest)
    return passes, take


def _ranked(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """``docs`` with ``size`` and ``key``, by which documents of one source and length are ranked."""
    h = F.xxhash64(F.lit(seed), docs[id_col], docs[text_col])
    key = F.struct(F.shiftrightunsigned(h, 33).alias("h"), h.alias("low"), docs[id_col].cast("string").alias("d"))
    return docs.select("*", size_of(docs[text_col]).alias("size"), key.alias("key"))


def fit_cells(slim: DataFrame, space: Workspace, weights: tuple[float, ...], most: int) -> DataFrame:
    """One row for each source and length of ``slim`` (``source, size, key``): the source's size and
    target, whole passes, and the last key that is taken once more (null: none)."""
    spark = slim.sparkSession
    lengths = space.save(slim.groupBy("source", "size").agg(F.count("*").alias("docs")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words"))
    # one row for each source: ordering them and sharing the excess needs them together
    found = sorted(sources.collect(), key=lambda r: (r["source"] is not None) and (0, r["source"]) or (1, ""))
    wanted = targets([r["words"] for r in found], weights, most)
    goal = spark.createDataFrame([(r["source"], r["words"], float(t)) for r, t in zip(found, wanted)],
                                 "source string, source_size long, target double")
    ahead = lengths.join(goal, lengths["source"].eqNullSafe(goal["source"])).select(
        lengths["source"], "size", "docs", "source_size", "target")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        passes, take = plan(rows["size"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64), float(rows["target"].iloc[0]))
        return rows.assign(passes=passes, more=take)

    fitted = space.save(ahead.groupBy("source").applyInPandas(
        fit, "source string, size long, docs long, source_size long, target double, passes long, more long"), "fitted")

    # the key of rank `more` in each cell: count ranges of the hash, then rank within one range
    s, f = slim.alias("s"), fitted.filter("more > 0").alias("f")
    inside = s.join(f, F.col("s.source").eqNullSafe(F.col("f.source")) & (F.col("s.size") == F.col("f.size"))).select(
        "s.source", "s.size", "key", "more", F.shiftrightunsigned(
            F.col("key.h") * F.ceil(F.col("docs") / BUCKET), 31).cast("long").alias("bucket"))
    counts = inside.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"), F.first("more").alias("more"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("rank", F.col("more") - before).filter("rank BETWEEN 1 AND n").select(
        "source", "size", "bucket", "rank").alias("e")
    i = inside.alias("i")
    near = i.join(edge, F.col("i.source").eqNullSafe(F.col("e.source")) & (F.col("i.size") == F.col("e.size"))
                  & (F.col("i.bucket") == F.col("e.bucket"))).select("i.source", "i.size", "i.bucket", "key", "rank")
    ranks = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("key"))
    last = near.withColumn("at", ranks).filter("at = rank").select("source", "size", F.col("key").alias("last_key")).alias("l")
    f = fitted.alias("f")
    return space.save(f.join(last, F.col("f.source").eqNullSafe(F.col("l.source")) & (F.col("f.size") == F.col("l.size")), "left")
                      .select("f.source", "f.size", "source_size", "target", "passes", "last_key"), "cells")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = 11) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words taken of the document,
    always a multiple of its size. Columns of these names are replaced."""
    spark = session(docs.sparkSession)
    space = Workspace(spark, "mixing")
    # the other columns travel as one struct, so none of them can clash
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    own = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"),
                      docs[source_col].cast("string").alias("source"))
    ranked = _ranked(own, "id", "text", seed)
    slim = space.save(ranked.select("source", "size", "key"), "sizes")
    cells = fit_cells(slim, space, weights, most)
    space.drop("sizes", "lengths", "fitted")
    c = cells.toDF(*[f"_{x}" for x in cells.columns])
    if cells.count() <= MOST_CELLS:
        c = F.broadcast(c)
    joined = ranked.join(c, ranked["source"].eqNullSafe(F.col("_source")) & (ranked["size"] == F.col("_size")))
    times = F.col("_passes") + F.coalesce((F.col("key") <= F.col("_last_key")).cast("long"), F.lit(0))
    return joined.select("row.*", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                         (F.col("size") * times).alias("taken"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, without the columns that ``mix`` added."""
    times = F.when(F.col("taken") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    return mixed.select(*kept, F.explode(F.array_repeat(F.lit(1), times)).alias("_")).select(*kept)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; no column is added, replaced or lost."""
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    return repeat(mix(rows, "id", "text", "source", **options)).select("row.*")
