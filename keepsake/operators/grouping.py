"""Leader grouping: exact, deterministic, and free of unbounded groups.

The rule: walk the rows in order; an ungrouped row becomes a leader and takes every later ungrouped row
similar to it. For a symmetric similarity the leaders are the lexicographically first maximal
independent set of the similarity graph, and every other row joins its smallest adjacent leader, so the
result depends on the order column only and can be computed in parallel rounds.

A node is named by its ``ord`` value: any orderable column that is unique per row (an id, or a struct
of sort key and id). Edges are ``(a, b, ...)`` with ``a < b``.
"""
from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize

log = logging.getLogger(__name__)

# Largest component that one task resolves in sequence; larger ones go on in distributed rounds.
COMPONENT_EDGES = 20_000
# Candidate pairs per blocked row up to which the pairs are listed outright.
PAIRS_PER_ROW = 64
# ... or in all: so few that peeling would not pay.
PAIRS_LISTED = 5_000_000
PEEL_ROUNDS = 8
PARALLEL_ROUNDS = 4


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, by alternating star rounds.

    Each round replaces edges by links to the smallest neighbour (first for the larger neighbours of
    every node, then for the smaller ones), until the edge set no longer changes.
    """
    links = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("m").alias("a"), "b").filter(F.col("a") != F.col("b")).distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        hop = large.join(low, "b")
        small = (hop.select(F.col("m").alias("a"), "b")
                 .union(hop.select(F.col("m").alias("a"), F.col("a").alias("b")))
                 .filter(F.col("a") != F.col("b")).distinct())
        links = materialize(small, "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    members = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return members.union(roots)


def _sequential_members(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of some bounded parts of the graph -> the nodes that some leader takes."""
    pdf = pdf.sort_values(["component", "a_key"])
    taken: set = set()
    for edge in zip(pdf["component"].tolist(), pdf["a_key"].tolist(), pdf["b_key"].tolist()):
        # edges come by their smaller end, so its own fate is settled before it takes anyone
        if edge[:2] not in taken:
            taken.add((edge[0], edge[2]))
    return pd.DataFrame(sorted(taken), columns=["component", "b_key"])


def _batched(df: DataFrame, n: int, size: int) -> DataFrame:
    """``batch`` number per component: many small components share a task call, at about ``size`` rows
    (plus at most one bounded component) each."""
    return df.withColumn("batch", F.pmod("component", F.lit(max(1, -(-n // size)))))


def _walk(tagged: DataFrame, n_edges: int) -> DataFrame:
    """Members (column ``b``) of parts ``(component, a, b)`` that are each small enough for one task."""
    names = (tagged.select("component", F.col("a").alias("node"))
             .union(tagged.select("component", F.col("b").alias("node"))).distinct())
    # positions inside a part stand for the nodes, so the helper sees plain integers
    ranked = names.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("node")))
    keyed = (tagged.join(ranked.select("component", F.col("node").alias("a"), F.col("k").alias("a_key")), ["component", "a"])
             .join(ranked.select("component", F.col("node").alias("b"), F.col("k").alias("b_key")), ["component", "b"])
             .select("component", "a_key", "b_key"))
    keyed = keyed.withColumn("component", F.xxhash64("component"))
    schema = "component bigint, b_key int"
    taken = _batched(keyed, n_edges, COMPONENT_EDGES).groupBy("batch").applyInPandas(_sequential_members, schema)
    names = ranked.select(F.xxhash64("component").alias("component"), F.col("k").alias("b_key"), "node")
    return taken.join(names, ["component", "b_key"]).select(F.col("node").alias("b"))


def _small_components(edges: DataFrame, n_edges: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """Members found inside components of at most ``cap`` edges, and the edges of larger components."""
    comps = connected_components(edges).withColumnRenamed("node", "a")
    tagged = edges.select("a", "b").join(comps, "a")
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = _walk(tagged.join(sizes.filter(F.col("n") <= cap).select("component"), "component"), n_edges)
    large = tagged.join(sizes.filter(F.col("n") > cap), "component").select("a", "b")
    return members, large


def absorbed(edges: DataFrame, rounds: int = PARALLEL_ROUNDS, cap: int = COMPONENT_EDGES) -> DataFrame:
    """The nodes (column ``b``) that are not leaders, from an explicit edge list.

    A round decides every undecided node without a smaller undecided neighbour: it is a leader, and its
    neighbours are members. A few rounds settle most graphs; what is left is mostly chains, whose
    bounded components are walked in sequence, one component per group. Larger components are walked in
    chunks.
    """
    active = edges.select("a", "b")
    found: list[DataFrame] = []
    n, left = 0, active.count()
    while left:
        n += 1
        if left <= cap:
            found.append(_walk(active.withColumn("component", F.lit(0)), left))
            break
        if n == rounds + 1:
            members, large = _small_components(active, left, cap)
            found.append(materialize(members.distinct(), "members"))
            large = materialize(large, "large")
            if not large.isEmpty():
                found.append(_members_in_chunks(large, cap))
            break
        else:
            heads = active.select("a").distinct().join(active.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            members = materialize(active.join(heads, "a", "left_semi").select("b").distinct(), "members")
            found.append(members)
            active = materialize(active.join(members, "b", "left_anti")
                                 .join(members.select(F.col("b").alias("a")), "a", "left_anti"), "active")
        left = active.count()
    log.info("leader grouping took %d rounds", n)
    out = found[0] if found else edges.select("b").limit(0)
    for more in found[1:]:
        out = out.union(more)
    return out


def assign_leaders(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Best edge ``(leader, member, ...)`` of every member: its smallest adjacent leader."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    to_leader = edges.join(members.select(F.col("b").alias("a")), "a", "left_anti")
    row = F.min(F.struct("a", *rest)).alias("_e")
    return to_leader.groupBy("b").agg(row).select(F.col("_e.a").alias("leader"), F.col("b").alias("member"),
                                                 *[F.col(f"_e.{c}").alias(c) for c in rest])


def leader_groups(edges: DataFrame, rounds: int = PARALLEL_ROUNDS, cap: int = COMPONENT_EDGES) -> DataFrame:
    """``(leader, member, scores...)`` from a finished edge list; leaders themselves are not listed."""
    edges = materialize(edges, "edges")
    return assign_leaders(edges, absorbed(edges, rounds, cap))


Score = Callable[[str, str], Column]


def with_rows(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` and the columns of both rows, with the prefixes ``a_`` and ``b_``."""
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns]).withColumnRenamed("a_ord", "a")
    right = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns]).withColumnRenamed("b_ord", "b")
    return pairs.join(left, "a").join(right, "b")


# Codes of the sets that a task compares at a time.
SET_CODES = 1 << 20
# Codes sent at a time, or as many as all sets have if these are more.
SENT_CODES = 1 << 24


def shared_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a_row, b_row, ...)`` with ``n_<column>``, the number of codes that the sets of both rows share, for
    each set column of ``sets(row, load, set...)``; ``load`` is the size of all sets of the row.

    A set travels once to the pairs of a group of near rows, not once a pair: a pair goes to the cell of the
    smallest row that its first row is paired with. Large cells are cut into a grid of bounded chunks, and small
    ones share a task call.
    """
    columns = [c for c in sets.columns if c not in ("row", "load")]
    lowest = pairs.groupBy(F.col("b_row").alias("a_row")).agg(F.min("a_row").alias("low"))
    low = F.coalesce(F.least("low", "a_row"), F.col("a_row"))
    placed = materialize(pairs.join(lowest, "a_row", "left").withColumn("cell", low).drop("low"), "placed")
    loads = sets.select("row", "load")

    def rows_in(df: DataFrame, cell: str) -> DataFrame:
        return df.select(cell, F.col("a_row").alias("row")).union(df.select(cell, F.col("b_row").alias("row"))).distinct()

    weights = materialize(rows_in(placed, "cell").join(loads, "row").groupBy("cell").agg(F.sum("load").alias("load")), "cells")
    total = weights.agg(F.sum("load")).first()[0] or 0
    chunks = weights.select("cell", F.greatest(F.lit(1), F.ceil(F.col("load") / F.lit(SET_CODES))).alias("chunks"))
    chunk = lambda c: F.pmod(F.xxhash64(c), F.col("chunks"))
    batch = F.pmod(F.xxhash64("cell", chunk("a_row"), chunk("b_row")), F.lit(max(1, -(-total // SET_CODES))))
    batched = materialize(placed.join(chunks, "cell").withColumn("batch", batch).drop("cell", "chunks"), "placed")
    asked = materialize(batched.select("batch", "a_row", "b_row").distinct(), "asked")
    sent = materialize(rows_in(batched, "batch").join(loads, "row"), "sent")
    every, total = loads.agg(F.sum("load")).first()[0] or 0, sent.agg(F.sum("load")).first()[0] or 0
    rounds = max(1, -(-total // max(SENT_CODES, every)))

    def count(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        first, second = mine["a_row"].to_numpy(), mine["b_row"].to_numpy()
        out = {"a_row": first, "b_row": second}
        for c in columns:
            own = {row: np.sort(codes) for row, codes in zip(held["row"].tolist(), held[c]) if codes is not None}
            none, n = np.zeros(0, np.int64), np.zeros(len(mine), np.int64)
            for i, (x, y) in enumerate(zip(first.tolist(), second.tolist())):
                short, long = sorted((own.get(x, none), own.get(y, none)), key=len)
                if len(short):
                    at = np.searchsorted(long, short)
                    at[at == len(long)] = 0
                    n[i] = np.count_nonzero(long[at] == short)
            out[f"n_{c}"] = n
        return pd.DataFrame(out)

    schema = ", ".join(["a_row bigint", "b_row bigint", *[f"n_{c} bigint" for c in columns]])
    counted = []
    for k in range(rounds):
        share = F.pmod(F.xxhash64("batch", F.lit(1)), F.lit(rounds)) == k
        held = sent.filter(share).drop("load").join(sets.drop("load"), "row")
        counted.append(materialize(asked.filter(share).groupBy("batch").cogroup(held.groupBy("batch")).applyInPandas(count, schema), "shared"))
    return placed.drop("cell").join(reduce(DataFrame.unionByName, counted), ["a_row", "b_row"])


class Blocked:
    """Rows with block keys and an exact pair test.

    ``rows(ord, ...)`` holds what the score reads; ``blocks(ord, key)`` must place every similar pair
    in a common block. ``score(left_prefix, right_prefix)`` builds the score column of a pair whose
    columns carry those prefixes, ``accept(score)`` the test. ``near(left, right)`` may add a cheap
    test on block columns besides ``key`` and ``ord``, and ``narrow(pairs)`` may drop distinct candidates that
    cannot be accepted before the full rows are fetched for them. With ``sets``, tables ``(row, load, set...)`` of codes
    under the row's own number ``row``, the score reads ``n_<set>``, the numbers of codes that both rows share, and
    no set travels with a pair. Each table comes with a test of the numbers known so far, or none, for the next.
    """

    def __init__(self, rows: DataFrame, blocks: DataFrame, score: Score, accept: Callable[[Column], Column],
                 near: Callable[[str, str], Column] | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None,
                 sets: tuple[tuple[DataFrame, Score | None], ...] = ()):
        self.rows, self.blocks = rows, blocks
        self.score, self.accept, self.near, self.narrow, self.sets = score, accept, near, narrow, sets

    def _side(self, df: DataFrame, prefix: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "key"])

    def candidates(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Distinct pairs ``(a, b)``, ``a < b``, of the given block rows that share a block."""
        pairs = self._side(left, "a_").join(self._side(right, "b_"), "key").filter(F.col("a_ord") < F.col("b_ord"))
        if self.near is not None:
            pairs = pairs.filter(self.near("a_", "b_"))
        return pairs.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")).distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        if self.narrow is not None:
            met = pairs if not self.sets else materialize(pairs, "met")
            pairs = self.narrow(met).distinct()  # an id may come twice in what narrows
        # scored once: a plain filter would be pushed below the score and compute it again
        accepted = F.filter(F.array(self.score("a_", "b_")), self.accept)
        if not self.sets:
            return with_rows(pairs, self.rows).select("a", "b", F.explode(accepted).alias("score"))
        # several rows may have one ord, so sets are named by row
        counted = with_rows(pairs, self.rows.select("ord", "row"))

        def read(df: DataFrame) -> DataFrame:
            for p in ("a_", "b_"):
                df = df.join(self.rows.select(*[F.col(c).alias(f"{p}{c}") for c in self.rows.columns if c != "ord"]), f"{p}row")
            return df

        for sets, possible in self.sets:
            counted = shared_counts(materialize(counted, "candidates"), sets)
            if possible is not None:
                counted = read(counted).filter(possible("a_", "b_")).select(*counted.columns)
        return read(counted).select("a", "b", F.explode(accepted).alias("score"))

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Accepted pairs ``(a, b, score)`` of the given block rows."""
        return self.verify(self.candidates(left, right))

    def edges(self) -> DataFrame:
        """All accepted pairs."""
        return self.pairs(self.blocks, self.blocks)

    def compared(self) -> DataFrame:
        """``total`` rows and the ``compared`` pairs that the blocks put together, each pair once."""
        rows = self.rows.agg(F.count(F.lit(1)).alias("total"))
        return rows.crossJoin(self.candidates(self.blocks, self.blocks).agg(F.count(F.lit(1)).alias("compared")))  # one row each

    def load(self, blocks: DataFrame) -> tuple[int, int]:
        """Candidate pairs (with repeats) and block rows."""
        sizes = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        pairs = F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)
        row = sizes.agg(F.coalesce(pairs, F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return int(row[0]), int(row[1])

    def groups(self, pairs_per_row: float = PAIRS_PER_ROW, peel_rounds: int = PEEL_ROUNDS,
               pairs_listed: int = PAIRS_LISTED) -> DataFrame:
        """``(leader, member, score)`` of every row that joins a leader.

        Sparse blocks are listed pair by pair. Dense blocks (many near copies) are peeled first: the
        first undecided row of all its blocks is certainly a leader, so comparing each block with its
        first row only, a linear number of pairs, removes whole clusters per round.
        """
        blocks = materialize(self.blocks, "blocks")
        pairs, n = self.load(blocks)
        if pairs <= max(pairs_listed, pairs_per_row * n):
            edges = materialize(self.pairs(blocks, blocks), "edges")
            return assign_leaders(edges, absorbed(edges))
        live, taken = blocks, []
        for _ in range(peel_rounds):
            first = live.groupBy("key").agg(F.min("ord").alias("head"))
            tagged = live.join(first, "key")
            heads = materialize(tagged.groupBy("ord").agg(F.min(F.col("ord") == F.col("head")).alias("is_head"))
                                .filter("is_head").select("ord"), "heads")
            star = (tagged.filter(F.col("ord") > F.col("head"))
                    .select(F.col("head").alias("a"), F.col("ord").alias("b")).distinct()
                    .join(heads.select(F.col("ord").alias("a")), "a", "left_semi"))
            hit = materialize(self.verify(star).select("b").distinct(), "members")
            taken.append(hit)
            live = materialize(live.join(heads, "ord", "left_anti")
                               .join(hit.select(F.col("b").alias("ord")), "ord", "left_anti"), "live")
            before, (pairs, n) = pairs, self.load(live)
            log.info("peeling dense blocks: %d candidate pairs left on %d block rows", pairs, n)
            if pairs <= max(pairs_listed, pairs_per_row * n) or pairs > 0.7 * before:
                break
        rest = materialize(self.pairs(live, live), "edges")
        members = absorbed(rest)
        for hit in taken:
            members = members.union(hit)
        members = materialize(members, "members")
        joined = blocks.join(members.select(F.col("b").alias("ord")), "ord", "left_semi")
        leaders = blocks.join(members.select(F.col("b").alias("ord")), "ord", "left_anti")
        return assign_leaders(self.pairs(leaders, joined), members)


def collapse(df: DataFrame, content, ord_: Column, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Equal contents become one node, the smallest ``ord``: copies are adjacent to each other and have
    the same neighbours, so the grouping of the representatives gives that of all rows.

    Returns the representatives ``(content..., ord, n)`` and all rows ``(ord, rep, content...)``. ``where`` tests
    the written contents: a filter before would compute them again.
    """
    content = [content] if isinstance(content, str) else list(content)
    # contents may be costly to compute and are read twice from here
    named = materialize(df.select(ord_.alias("ord"), *content), "contents")
    if where is not None:
        named = named.filter(where)
    reps = named.groupBy(*content).agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("n"))
    rows = named.join(reps.select(*content, "rep"), content).select("ord", "rep", *content)
    return reps.withColumnRenamed("rep", "ord"), rows


def expand(groups: DataFrame, rows: DataFrame, self_score: Column) -> DataFrame:
    """Long form ``(group_id, member_id, is_leader, score)`` for all rows behind the representatives.

    Copies of a leader, and rows whose representative joined a leader, become members. Groups of one
    are dropped.
    """
    of = groups.select(F.col("member").alias("rep"), F.col("leader"), "score")
    joined = rows.select("ord", "rep").join(of, "rep", "left").select(
        F.coalesce("leader", "rep").alias("group_id"), F.col("ord").alias("member_id"),
        F.coalesce("score", self_score).alias("score"))
    sizes = joined.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    out = joined.join(sizes.select("group_id"), "group_id", "left_semi")
    lead = F.col("group_id") == F.col("member_id")
    return out.select("group_id", "member_id", lead.alias("is_leader"), "score")


def summarise(groups: DataFrame) -> DataFrame:
    """Header per group: size and mean leader-member score (also its confidence)."""
    member = ~F.col("is_leader")
    return groups.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(F.when(member, F.col("score"))).alias("similarity"))


# --- groups from directed decisions --------------------------------------------------------------

def _claim_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Some bounded components: seeds in order claim themselves and their related rows not yet claimed."""
    pdf = pdf.sort_values(["component", "pos", "at"])
    taken: set = set()
    seeds, members = [], []

    def settle(seed, claim):
        if seed not in taken:
            free = [m for m in claim if m not in taken]
            if len(free) > 1:
                taken.update(free)
                seeds.extend([seed] * len(free))
                members.extend(free)

    now, claim = None, []
    for seed, member in zip(pdf["seed"].tolist(), pdf["member"].tolist()):
        if seed != now:
            settle(now, claim)
            now, claim = seed, []
        claim.append(member)
    settle(now, claim)
    return pd.DataFrame({"seed": seeds, "member": members}, columns=["seed", "member"])


def _same(df: DataFrame) -> tuple:
    """A fingerprint of the rows."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def _claim_in_chunks(claims: DataFrame, cap: int) -> DataFrame:
    """The same for components of any size: chunks of seeds in order are walked side by side, each with
    what the chunks before it are believed to have taken; chunks are walked again until no belief
    changes. The first chunk is right after one pass, the next after it is, and so on; since claims reach
    only so far and mostly forget where they started, a few passes settle long chains. A chain so regular
    that its phase never fades takes a pass for each chunk.
    """
    n = max(1, -(-claims.count() // cap))
    ranged = materialize(claims.repartitionByRange(n, "pos").withColumn("chunk", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("chunk").orderBy("pos")
    placed = materialize(ranged.withColumn("k", F.dense_rank().over(within)).drop("pos"), "chunks")
    schema = T.StructType([placed.schema["chunk"], claims.schema["seed"], claims.schema["member"]])

    def walk(mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        taken, seeds, members = set(before["member"].tolist()), [], []
        for _, own in mine.sort_values(["k", "at"]).groupby("k", sort=True):
            seed = own["seed"].iloc[0]
            if seed not in taken:
                free = [m for m in own["member"].tolist() if m not in taken]
                if len(free) > 1:
                    taken.update(free)
                    seeds.extend([seed] * len(free))
                    members.extend(free)
        return pd.DataFrame({"chunk": int(mine["chunk"].iloc[0]) if len(mine) else 0, "seed": seeds, "member": members},
                            columns=["chunk", "seed", "member"])

    asked = materialize(placed.select("chunk", "member").distinct(), "asked")
    believed, mark, passes = materialize(asked.limit(0), "believed"), None, 0
    while True:
        passes += 1
        won = materialize(placed.groupBy("chunk").cogroup(believed.groupBy("chunk")).applyInPandas(walk, schema), "won")
        now = _same(won)
        if now == mark:
            log.info("claims in %d chunks took %d passes", n, passes)
            return won.select("seed", "member")
        mark = now
        by = won.select(F.col("chunk").alias("by"), "member")
        believed = materialize(asked.join(by, "member").filter(F.col("by") < F.col("chunk")).select("chunk", "member").distinct(), "believed")


def _members_in_chunks(edges: DataFrame, cap: int) -> DataFrame:
    """Nodes that some leader takes (column ``b``), from edges of components of any size, in the same way:
    chunks of leaders in order, walked again until what earlier chunks take no longer changes."""
    n = max(1, -(-edges.count() // cap))
    ranged = materialize(edges.repartitionByRange(n, "a").withColumn("chunk", F.spark_partition_id()), "ranged")
    names = ranged.select("chunk", F.col("a").alias("node")).union(ranged.select("chunk", F.col("b").alias("node"))).distinct()
    ranks = materialize(names.withColumn("k", F.row_number().over(Window.partitionBy("chunk").orderBy("node"))), "ranks")
    placed = materialize(
        ranged.join(ranks.select("chunk", F.col("node").alias("a"), F.col("k").alias("a_key")), ["chunk", "a"])
        .join(ranks.select("chunk", F.col("node").alias("b"), F.col("k").alias("b_key")), ["chunk", "b"])
        .select("chunk", "a_key", "b_key"), "chunks")

    def walk(mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        given = set(before["k"].tolist())
        taken = set(given)
        for a, b in sorted(zip(mine["a_key"].tolist(), mine["b_key"].tolist())):
            if a not in taken:
                taken.add(b)
        out = sorted(taken - given)
        return pd.DataFrame({"chunk": int(mine["chunk"].iloc[0]) if len(mine) else 0, "k": out}, columns=["chunk", "k"])

    believed, mark, passes = materialize(ranks.select("chunk", "k").limit(0), "believed"), None, 0
    while True:
        passes += 1
        won = materialize(placed.groupBy("chunk").cogroup(believed.groupBy("chunk")).applyInPandas(walk, "chunk int, k int"), "won")
        named = materialize(won.join(ranks, ["chunk", "k"]).select(F.col("chunk").alias("by"), "node"), "named")
        now = _same(named)
        if now == mark:
            log.info("leaders in %d chunks took %d passes", n, passes)
            return named.select(F.col("node").alias("b")).distinct()
        mark = now
        believed = materialize(ranks.join(named, "node").filter(F.col("by") < F.col("chunk")).select("chunk", "k").distinct(), "believed")


def _sure_claims(claims: DataFrame, rounds: int = PARALLEL_ROUNDS) -> tuple[list[DataFrame], DataFrame]:
    """Claims ``(seed, member)`` that are certain to hold, and the claims left undecided.

    A seed that is the first to claim each of its free rows gets them all. Then claims on taken rows, claims of taken
    seeds and of seeds with fewer than two free rows are void. In a crowd where many seeds name the same rows a round
    settles nearly all; in a chain it settles little, and the rounds end.
    """
    found: list[DataFrame] = []
    left = claims.count()
    for _ in range(rounds):
        if not left:
            break
        # written first, so that the claims on a row that many name can be split over tasks
        first = materialize(claims.groupBy("member").agg(F.min("pos").alias("first")), "first")
        leads = claims.join(first, "member", "left").withColumn("leads", F.coalesce(F.col("pos") == F.col("first"), F.lit(False)))
        sure = materialize(leads.groupBy("seed", "pos").agg(F.min("leads").alias("all"), F.count(F.lit(1)).alias("n"))
                           .filter(F.col("all") & (F.col("n") > 1)).select("seed", "pos"), "sure")
        won = materialize(claims.join(sure, ["seed", "pos"], "left_semi").select("seed", "member"), "won")
        found.append(won)
        taken = won.select("member").distinct()
        free = (claims.join(taken, "member", "left_anti")
                .join(taken.select(F.col("member").alias("seed")), "seed", "left_anti"))
        free = materialize(free, "free")
        some = free.groupBy("seed", "pos").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("seed", "pos")
        claims = materialize(free.join(some, ["seed", "pos"], "left_semi").select(*claims.columns), "claims")
        before, left = left, claims.count()
        log.info("sure claims: %d of %d undecided", left, before)
        if left > 0.7 * before:
            break
    return found, claims


def groups_from_decisions(decisions: DataFrame, id_col="id", order_col: str | None = None,
                          cap: int = COMPONENT_EDGES) -> DataFrame:
    """Groups from per-row decisions with related ids, in order: a seed takes itself and its related
    rows that no earlier group took; groups of one are not kept.

    Returns ``(group_id, member_id, type, confidence)``.
    """
    kinds = F.when(F.col("decision") == "duplicate", "exact_duplicate").when(
        F.col("decision") == "burst_shot", "burst_sequence").otherwise("similar_composition")
    # decisions may be costly to compute and are read twice from here; a filter before would compute them again
    own = list(dict.fromkeys([id_col, *([order_col] if order_col else []), "decision", "confidence", "related"]))
    decisions = materialize(decisions.select(*own), "decisions")
    seeds = decisions.filter((F.col("decision") != "unique") & (F.size("related") > 0) & F.col(id_col).isNotNull())
    pos = F.col(id_col) if order_col in (None, id_col) else F.struct(order_col, id_col)
    members = F.array_distinct(F.concat(F.array(F.col(id_col)), F.col("related")))
    claims = materialize(seeds.select(F.col(id_col).alias("seed"), pos.alias("pos"),
                                      F.posexplode(members).alias("at", "member")), "claims")
    settled, claims = _sure_claims(claims)
    comps = connected_components(claims.select(F.least("seed", "member").alias("a"), F.greatest("seed", "member").alias("b")))
    # a seed that meets no other row any more is a component of its own
    tagged = (claims.join(comps.withColumnRenamed("node", "seed"), "seed", "left")
              .withColumn("component", F.coalesce("component", "seed")))
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("component").orderBy("pos")
    # ranks stand for the order values, so the helper sorts plain integers
    small = (tagged.join(sizes.filter(F.col("n") <= cap).select("component"), "component")
             .withColumn("pos", F.dense_rank().over(rank))
             .withColumn("component", F.xxhash64("component")))
    schema = T.StructType([claims.schema["seed"], claims.schema["member"]])
    done = _batched(small, claims.count(), cap).groupBy("batch").applyInPandas(_claim_in_order, schema)
    big = materialize(tagged.join(sizes.filter(F.col("n") > cap).select("component"), "component", "left_semi")
                      .select("seed", "pos", "at", "member"), "large")
    if not big.isEmpty():
        done = done.unionByName(_claim_in_chunks(big, cap))
    for sure in settled:
        done = done.unionByName(sure)
    heads = seeds.select(F.col(id_col).alias("seed"), kinds.alias("type"), "confidence")
    # a ranking reads the groups twice, so the walk is written
    return materialize(done.join(heads, "seed").select(F.col("seed").alias("group_id"), F.col("member").alias("member_id"),
                                                       "type", "confidence"), "groups")
