"""Similarity pair joins by blocking. Every blocking here is lossless: no pair above the threshold is
missed, and each candidate is verified exactly.

Equal contents are collapsed first, so pairs are between distinct contents (named by the smallest row
that has them, with the number of copies): a group of equal rows never multiplies into pairs.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import floor
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_similarity
from ..functions.text import DOMAIN_BOOST, boosted, counted_jaccard, domain_terms, tokens
from ..functions.vectors import cosine, dot
from ..session import discard, materialize
from . import cells
from .grouping import Blocked, collapse, expand, with_rows

HASH_LENGTH = 16
# Rows of one hash block above which the block is split by further positions.
HOT_BLOCK = 5_000
# Rows of hashes that one task repeats for their blocks.
DEALT = 2_000


def _ord(id_col: str, order_col: str | None) -> Column:
    return F.col(id_col) if order_col in (None, id_col) else F.struct(order_col, id_col)


# --- perceptual hashes -------------------------------------------------------------------------

def _picked(positions) -> str:
    """SQL for the characters of ``hash`` at the given positions; one parsed text is much cheaper to
    build than hundreds of column objects."""
    return "concat(" + ", ".join(f"substring(hash, {p + 1}, 1)" for p in positions) + ")"


def further_positions(mask: int, need: int) -> list[int]:
    """Masks that extend ``mask`` so that rows agreeing in ``need`` positions, those of the mask among them, agree
    in all positions of at least one: of the two parts of the rest, one holds its share of the other agreements."""
    rest = [p for p in range(HASH_LENGTH) if not mask >> p & 1]
    more = need - (HASH_LENGTH - len(rest))
    if more <= 0:
        return []
    parts = rest[:len(rest) // 2], rest[len(rest) // 2:]
    share = max(1, min(more, round((more + 1) * len(parts[0]) / len(rest))))
    return [mask | sum(1 << p for p in some)
            for part, many in zip(parts, (share, more + 1 - share)) for some in combinations(part, many)]


def hash_blocks(reps: DataFrame, threshold: float, hot: int = HOT_BLOCK) -> tuple[DataFrame, int | None]:
    """Block keys ``(ord, hash, key)`` for hashes of 16 characters compared by character, and the number of positions
    in a key if no block was split.

    A pair at the threshold agrees in at least ``m`` of 16 positions, so one half of eight positions
    agrees in at least ``ceil(m / 2)``; the key is that half, such a choice of positions and their
    characters. Blocks that are still large are split by further positions (:func:`further_positions`), level by
    level, until they are small, all ``m`` positions are used, so that every pair of a block is a result, or a level
    would not lower the number of pairs. The same positions reached by different ways are one block.
    """
    need = HASH_LENGTH - floor((1 - threshold) * 4 * HASH_LENGTH + 1e-9)
    if need <= 0:
        return reps.select("ord", "hash", F.lit("all").alias("key")), None
    first = min(8, (need + 1) // 2)
    choices = [[p + 8 * half for p in c] for half in (0, 1) for c in combinations(range(8), first)]
    masks = [sum(1 << p for p in c) for c in choices]
    keys = F.expr("array(" + ", ".join(f"struct({m} AS mask, {_picked(c)} AS chars)" for m, c in zip(masks, choices)) + ")")
    n = reps.count()
    # the table is small and its blocks many times larger, so the rows are dealt out before they are repeated
    dealt = reps.select("ord", "hash").repartition(max(1, -(-n // DEALT)))
    level = dealt.select("ord", "hash", F.explode(keys).alias("k")).select("ord", "hash", "k.*")
    own = ["ord", "hash", F.concat_ws("|", "mask", "chars").alias("key")]
    if n <= hot:
        return level.select(own), first
    finished = reps.select("ord", "hash", F.lit("").alias("key")).limit(0)
    before = None  # squares of the sizes of the large blocks one level up
    while True:
        sizes = level.groupBy("mask", "chars").agg(F.count(F.lit(1)).alias("n"))
        big = materialize(sizes.filter((F.col("n") > hot) & (F.bit_count("mask") < need)), "hot-blocks")
        plain = level.select(own)
        pairs = big.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0]
        if before is None and pairs is None:
            return plain, first
        if pairs is None or (before is not None and pairs >= before):
            return finished.unionByName(plain), None
        known = big.select("mask", "chars")
        finished = finished.unionByName(
            level.join(known, ["mask", "chars"], "left_anti").select(own))
        # at most one row for each choice of positions
        used = [r["mask"] for r in known.select("mask").distinct().collect()]
        wider = reps.sparkSession.createDataFrame([(m, further_positions(m, need)) for m in used], "mask int, wider array<int>")
        rows = level.join(known, ["mask", "chars"], "left_semi").join(F.broadcast(wider), "mask")
        rows = rows.select("ord", "hash", F.explode("wider").alias("mask")).distinct()
        letters = F.expr(f"concat_ws('', transform(filter(sequence(0, {HASH_LENGTH - 1}), p -> shiftright(mask, p) % 2 = 1), p -> substring(hash, p + 1, 1)))")
        level, before = materialize(rows.withColumn("chars", letters), "split-blocks"), pairs


def grid_blocks(reps: DataFrame, hot: int = HOT_BLOCK) -> DataFrame:
    """Block keys under which every row meets every other, in blocks of about ``2 * hot`` rows: for thresholds that
    every pair reaches, when all pairs are the result that was asked for."""
    chunks = -(-reps.count() // hot) or 1
    own = F.pmod(F.xxhash64("ord"), F.lit(chunks))
    other = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    both = reps.select("*", own.alias("own"), other.alias("other"))
    return both.select(*reps.columns, F.concat_ws("|", F.least("own", "other"), F.greatest("own", "other")).alias("key"))


def bit_blocks(reps: DataFrame, threshold: float) -> DataFrame:
    """Blocks for bit distance: with ``d`` bits allowed, one of ``d + 1`` segments agrees exactly."""
    allowed = floor((1 - threshold) * 4 * HASH_LENGTH + 1e-9)
    n = min(allowed + 1, 64)
    bits = F.concat(*[F.lpad(F.conv(F.substring("hash", i + 1, 1), 16, 2), 4, "0") for i in range(HASH_LENGTH)])
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    keys = F.array(*[F.concat(F.lit(f"{i}:"), F.substring("bits", cuts[i] + 1, cuts[i + 1] - cuts[i]))
                     for i in range(n)])
    return reps.withColumn("bits", bits).select("ord", "hash", F.explode(keys).alias("key"))


class NearHashes(Blocked):
    """Rows ``(ord, hash)`` in blocks that carry the hash: a pair is scored where it meets, and only accepted pairs
    travel on. ``positions``: the number of positions in every key, if no block was split."""

    def __init__(self, reps: DataFrame, blocks: DataFrame, threshold: float, mode: str, positions: int | None = None):
        score = lambda a, b: hash_similarity(F.col(f"{a}hash"), F.col(f"{b}hash"), mode, HASH_LENGTH)
        super().__init__(reps, blocks, score, lambda s: s >= threshold)
        self.positions = positions

    def met(self, left: DataFrame, right: DataFrame) -> DataFrame:
        # merged: the optimizer takes exploded keys for as small as the rows they come from, and would broadcast them
        return self._side(left, "a_").hint("merge").join(self._side(right, "b_").hint("merge"), "key").filter(
            F.col("a_ord") < F.col("b_ord"))

    def candidates(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return self.met(left, right).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")).distinct()

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        scored = self.met(left, right).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "a_hash", "b_hash", self.score("a_", "b_").alias("score"))
        return scored.filter(self.accept(F.col("score"))).distinct().select("a", "b", "score")

    def compared(self) -> DataFrame:
        """Each pair is counted in the first of its blocks, so pairs need not travel: no position before the last of
        the key agrees besides those of the key, and the first half agrees too seldom if the key is of the second."""
        if self.positions is None:
            return super().compared()
        masks = [(sum(1 << p for p in c), sum(1 << p for p in range(8 * half, max(c)) if p not in c), half == 1)
                 for half in (0, 1) for c in combinations(range(8 * half, 8 * half + 8), self.positions)]
        table = self.rows.sparkSession.createDataFrame(masks, "mask int, others int, second boolean")
        agree = reduce(add, [F.when(F.substring("a_hash", p + 1, 1) == F.substring("b_hash", p + 1, 1), 1 << p).otherwise(0)
                             for p in range(HASH_LENGTH)])
        known = self.blocks.withColumn("mask", F.substring_index("key", "|", 1).cast("int")).join(F.broadcast(table), "mask").drop("mask")
        seldom = F.bit_count(F.col("agree").bitwiseAND(255)) < self.positions
        pairs = self.met(known, self.blocks).select("a_others", "a_second", agree.alias("agree")).filter(
            (F.col("agree").bitwiseAND(F.col("a_others")) == 0) & (~F.col("a_second") | seldom))
        rows = self.rows.agg(F.count(F.lit(1)).alias("total"))
        return rows.crossJoin(pairs.agg(F.count(F.lit(1)).alias("compared")))  # one row each


def blocked_hashes(df: DataFrame, id_col="id", hash_col="hash", threshold=0.85, order_col=None,
                   mode="char", hot: int = HOT_BLOCK) -> tuple[NearHashes, DataFrame]:
    known = df.filter(F.length(hash_col) > 0).withColumnRenamed(hash_col, "hash")
    wrong = F.raise_error(F.concat(F.lit("expected a hash of 16 characters, got "), F.col("hash")))
    known = known.withColumn("hash", F.when(F.length("hash") == HASH_LENGTH, F.col("hash")).otherwise(wrong.cast("string")))
    reps, rows = collapse(known, "hash", _ord(id_col, order_col))
    reps = materialize(reps, "hashes")
    blocks, positions = hash_blocks(reps, threshold, hot) if mode == "char" else (bit_blocks(reps, threshold), None)
    return NearHashes(reps.select("ord", "hash"), blocks, threshold, mode, positions), rows


def hash_pairs(df: DataFrame, id_col="id", hash_col="hash", threshold=0.85, order_col=None,
               mode="char") -> DataFrame:
    """``(id_a, id_b, score)`` of distinct hashes at or above the threshold."""
    blocked, _ = blocked_hashes(df, id_col, hash_col, threshold, order_col, mode)
    if mode == "char" and threshold <= 0.75:  # all 16 characters may differ
        blocked.blocks = grid_blocks(blocked.rows)
    return _named(blocked.edges())


def hash_groups(df: DataFrame, id_col="id", hash_col="hash", threshold=0.85, order_col=None, mode="char",
                **tuning) -> DataFrame:
    blocked, rows = blocked_hashes(df, id_col, hash_col, threshold, order_col, mode)
    # read again by every later step, so computed once
    return materialize(expand(blocked.groups(**tuning), rows, F.lit(1.0)), "groups")


def _named(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "score")


# --- vectors -----------------------------------------------------------------------------------

class NearVectors(Blocked):
    """Rows ``(ord, unit)`` in the cells of :mod:`.cells`, compared as products of chunks."""

    def __init__(self, reps: DataFrame, threshold: float, cell: int = cells.CELL):
        blocks = cells.split_cells(cells.all_home(reps), cells.reach_of(threshold), cell)
        score = lambda a, b: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(f"{a}unit"), F.col(f"{b}unit"))))
        super().__init__(reps, blocks, score, lambda s: s >= threshold, lambda a, b: F.col(f"{a}home"))
        self.threshold, self.basis = threshold, cells.shared_pivots(reps)

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return cells.near_pairs(cells.rows_of(left, self.rows), cells.rows_of(right, self.rows), self.basis, self.threshold)

    def multiplied(self) -> tuple[int, int]:
        """Pairs in common cells, and those of them that were multiplied out."""
        rows = cells.rows_of(self.blocks, self.rows)
        return tuple(cells.near_pairs(rows, rows, self.basis, self.threshold, counts=True).agg(F.sum("possible"), F.sum("compared")).first())

    def load(self, blocks: DataFrame) -> tuple[int, int]:
        sizes = blocks.groupBy("key").agg(F.sum(F.col("home").cast("double")).alias("h"), F.count(F.lit(1)).alias("n"))
        row = sizes.agg(F.coalesce(F.sum(F.col("h") * F.col("n") / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return int(row[0]), int(row[1])


def distinct_vectors(df: DataFrame, id_col="id", vector_col="features", order_col=None, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(ord, unit)`` of the distinct vectors that are not zero, and all rows ``(ord, rep)``."""
    if dim is None:
        first = df.select(F.size(vector_col).alias("d")).filter(F.col(vector_col).isNotNull()).first()
        dim = first["d"] if first else 0
    v = F.transform(vector_col, lambda x: x.cast("double"))
    wrong = F.raise_error(F.lit("vectors must have the same length")).cast("array<double>")
    vecs = (df.filter(F.col(vector_col).isNotNull()).withColumn("vec", F.when(F.col(vector_col).isNull() | (F.size(vector_col) == dim), v).otherwise(wrong)))
    vecs = vecs.withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec")))).filter(F.col("norm") > 0)
    reps, rows = collapse(vecs, "vec", _ord(id_col, order_col))
    # normalised once, so that a pair costs one inner product
    reps = materialize(reps.select("ord", "n", F.sqrt(dot(F.col("vec"), F.col("vec"))).alias("norm"), "vec")
                       .select("ord", F.transform("vec", lambda x: x / F.col("norm")).alias("unit")), "vectors")
    return reps, rows.drop("vec")


def blocked_vectors(df: DataFrame, id_col="id", vector_col="features", threshold=0.98, order_col=None,
                    dim: int | None = None) -> tuple[NearVectors, DataFrame]:
    reps, rows = distinct_vectors(df, id_col, vector_col, order_col, dim)
    return NearVectors(reps, threshold), rows


def vector_pairs(df: DataFrame, id_col="id", vector_col="features", threshold=0.98, order_col=None,
                 dim: int | None = None) -> DataFrame:
    blocked, _ = blocked_vectors(df, id_col, vector_col, threshold, order_col, dim)
    return _named(blocked.edges())


def vector_pairs_approximate(df: DataFrame, id_col="id", vector_col="features", threshold=0.98, order_col=None, dim: int | None = None,
                             recall: float = 0.95, rows: int | None = None, seed: int = 7) -> DataFrame:
    """Most pairs of :func:`vector_pairs`, none wrong: an expected share of ``recall`` of those at the
    threshold, more of those above it.

    Random hyperplanes give every vector a signature in bands; vectors with a band in common are compared
    exactly, in the first such band. Bands follow from the threshold, the recall and the number of rows
    (``rows``, counted if not given). A band's cell with many rows is split like any other, without loss.
    """
    reps, _ = distinct_vectors(df, id_col, vector_col, order_col, dim)
    first = reps.select(F.size("unit").alias("d")).first()
    if first is None:
        return _named(NearVectors(reps, threshold).edges())
    bits, bands = cells.choose_bands(threshold, recall, rows or reps.count())
    live = materialize(cells.banded(reps, bits, bands, first["d"], seed), "bands")
    placed = cells.rows_of(cells.split_cells(live, cells.reach_of(threshold)), reps)
    return _named(cells.near_pairs(placed, placed, cells.shared_pivots(reps), threshold))


def band_comparisons(df: DataFrame, id_col="id", vector_col="features", threshold=0.98, dim: int | None = None,
                     recall: float = 0.95, rows: int | None = None, seed: int = 7) -> DataFrame:
    """``total`` distinct vectors and the pairs ``compared`` in the bands of :func:`vector_pairs_approximate`,
    counted from the sizes of the bands' cells: no pair is formed."""
    reps, _ = distinct_vectors(df, id_col, vector_col, dim=dim)
    first = reps.select(F.size("unit").alias("d")).first()
    bits, bands = cells.choose_bands(threshold, recall, rows or reps.count())
    live = cells.banded(reps, bits, bands, first["d"] if first else 1, seed)
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.coalesce(F.sum(F.expr("n * (n - 1) DIV 2")), F.lit(0)).alias("compared")
    return reps.agg(F.count(F.lit(1)).alias("total")).crossJoin(sizes.agg(pairs))  # one row each


def vector_groups(df: DataFrame, id_col="id", vector_col="features", threshold=0.8, order_col=None,
                  dim: int | None = None, **tuning) -> DataFrame:
    blocked, rows = blocked_vectors(df, id_col, vector_col, threshold, order_col, dim)
    # read again by every later step, so computed once
    return materialize(expand(blocked.groups(**tuning), rows, F.lit(1.0)), "groups")


# --- text --------------------------------------------------------------------------------------

# Rows of a token block above which it is split by a further shared token.
HOT_TOKEN = 256
# Pairs that cost as much as moving a row to one more block.
ROW_COST = 16


# Counters of token frequencies; tokens that share one count as frequent together.
COUNTERS = 1 << 18


def ranked_sets(sets: DataFrame, codes: str = "codes") -> DataFrame:
    """``sets`` with ``(size, ranked)`` in place of the token codes: the codes, rare ones first.

    Any order that all sets share will do, so frequencies are counted in a fixed number of counters, and codes of
    like frequency follow each other by number: no token has to meet its frequency.
    """
    spark = sets.sparkSession
    flat = sets.select(F.explode(codes).alias("tok")).select(F.pmod("tok", F.lit(COUNTERS)).cast("int").alias("counter"))
    seen = flat.groupBy("counter").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most COUNTERS rows
    ranks = np.zeros(COUNTERS, np.int16)
    ranks[seen["counter"].to_numpy(np.int64)] = 8 * np.log2(seen["n"].to_numpy(np.float64))
    sent = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<bigint>")
    def rank(held: pd.Series) -> pd.Series:
        own = [np.asarray(c, np.int64) for c in held]
        return pd.Series([c[np.lexsort((c, sent.value[np.mod(c, len(sent.value))]))] for c in own])

    return sets.select("*", F.size(codes).alias("size"), rank(codes).alias("ranked")).drop(codes)


def token_codes(toks: Column) -> Column:
    """Tokens as 64-bit numbers that stand for them."""
    return F.transform(toks, lambda w: F.xxhash64(w))


# Tokens that a prefix is longer than one meeting asks for, at most and as a share of the tokens to be shared.
SLACK, SLACK_SHARE = 16, 12


def spare(size: Column, least) -> Column:
    """Tokens by which the prefix of a set is longer: near sets share so many more of their first tokens."""
    least = F.lit(least) if isinstance(least, float) else least
    return F.least(F.lit(SLACK), F.floor(F.ceil(size * least - F.lit(1e-9)) / F.lit(SLACK_SHARE))).cast("int")


def prefix_blocks(ranked: DataFrame, least: float, scopes: DataFrame | None = None, hot: int = HOT_TOKEN, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks ``(ord, size, pos, level, last, depth, key)`` in which all sets of overlap (Jaccard) ``least`` meet,
    within each scope they share (``scopes``: ``ord, scope``).

    Two such sets share ``o = ceil(least / (1 + least) (|x| + |y|))`` tokens or more, and so, for every l up
    to o, l tokens among the first ``|x| - ceil(least |x|) + l`` of each. Level 1 has a block for each such
    token. A block of more than ``hot`` rows is split by the next token, as long as its pairs get fewer:
    a pair of the next level shares both. Pairs with ``o`` at the block's level need no other token, and
    having shared that many they are near enough already; they meet in a block marked ``last``.

    Prefixes are longer by :func:`spare` tokens, so near sets meet in several blocks of level 1, or in a block of
    a deeper one (:class:`NearSets`). ``depth`` is the number of levels. Columns to ``carry`` go along.
    """
    need, more = F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)), spare(F.col("size"), least)
    # keys are 64-bit numbers: equal ones of different tokens can only add candidates
    key = F.lit(0).cast("bigint") if scopes is None else F.xxhash64("scope")
    rows = ranked if scopes is None else ranked.join(scopes, "ord")

    def step(df: DataFrame, level: int, start: Column) -> DataFrame:
        """Each row in the blocks of its tokens from number ``start`` to the end of its prefix."""
        end = F.least(F.col("size"), F.col("size") - need + level + more)
        tokens_ = F.slice("ranked", start, F.greatest(F.lit(0), end - start + 1).cast("int"))
        found = df.select("ord", "size", *carry, F.col("key").alias("above"), start.alias("start"), F.posexplode(tokens_).alias("i", "tok"))
        return found.select("ord", "size", *carry, "above", (F.col("i") + F.col("start") - 1).alias("pos"), F.lit(level).alias("level"),
                            F.lit(False).alias("last"), F.xxhash64("above", "tok").alias("key"))

    own = ["ord", "size", "pos", "level", "last", "key", *carry]
    live, done, level, written = step(rows.withColumn("key", key), 1, F.lit(1)), [], 1, []
    pairs = F.col("n").cast("double") * F.col("n")
    while True:
        live = materialize(live, "token-blocks")
        written.append(live)
        # a split makes as many rows as tokens follow, known without making them, and at least a pair of each
        follow = F.greatest(F.lit(0), F.least(F.col("size"), F.col("size") - need + level + 1 + more) - F.col("pos") - 1)
        big = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(follow).alias("follow"))
        big = big.filter((F.col("n") > hot) & ((ROW_COST + 1) * F.col("follow") < 0.5 * pairs)).drop("follow")
        big = materialize(big, "hot-tokens")
        if big.isEmpty():
            break
        hot_rows = live.join(big.select("key"), "key", "left_semi").select("ord", "pos", "key")
        next_ = materialize(step(hot_rows.join(ranked, "ord"), level + 1, F.col("pos") + 2), "next-token")
        written.append(next_)
        after = next_.groupBy("above", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("above").agg(F.sum(pairs).alias("pairs"), F.sum("n").alias("rows"))
        # splitting moves rows and saves pairs; a row costs as much as some pairs
        paying = big.join(after, big["key"] == after["above"], "left").filter(
            F.coalesce(F.col("pairs") + ROW_COST * F.col("rows"), F.lit(0.0)) < 0.5 * pairs).select(big["key"])
        paying = materialize(paying, "split-tokens")
        done.append(live.join(paying, "key", "left_anti").select(own))
        settled = live.join(paying, "key", "left_semi").filter(need <= level)
        done.append(settled.withColumns({"last": F.lit(True), "key": F.xxhash64("key", F.lit("!"))}).select(own))
        live = next_.join(paying.withColumnRenamed("key", "above"), "above", "left_semi")
        level += 1
    if done:
        live = materialize(reduce(lambda x, y: x.unionByName(y), done, live.select(own)), "blocks")
        for table in written:
            discard(table)
    return live.select(*own, F.lit(level).alias("depth"))


def overlap_possible(a: str, b: str, least: Column, besides: Column | int = 0) -> Column:
    """Size and position test: the tokens shared by the block, and those after the last of them, must
    suffice for the least overlap. A pair that reaches it passes at its first shared tokens; in a block
    marked ``last`` the shared ones must be enough. ``besides`` are tokens that may be shared before."""
    c = lambda p, n: F.col(f"{p}{n}")
    needed = least / (F.lit(1.0) + least) * (c(a, "size") + c(b, "size")) - F.lit(1e-6)
    after = F.least(c(a, "size") - c(a, "pos"), c(b, "size") - c(b, "pos")) - 1
    return c(a, "level") + besides + F.when(c(a, "last"), 0).otherwise(after) >= needed


# Pairs in the blocks of a round, or so many times the block rows if these are more; most of them fail the size and
# position test.
MEETINGS, MEETINGS_PER_ROW = 1 << 28, 24


class NearSets(Blocked):
    """Token sets in :func:`prefix_blocks` with a column ``least``, the overlap that a block is made for.

    Sets that share ``o`` tokens share the first ``l`` of them within prefixes that are longer by ``l``, so they meet
    in ``l`` blocks of level 1; or one of those blocks was split, and they meet deeper, if ``o`` is at least ``l``
    and the number of levels together. Pairs that meet less often share some rare tokens and not enough of the others.
    """

    def candidates(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Meetings are counted in rounds, each over a share of the left rows, so that they never lie on disk all at
        once."""
        meetings, rows = self.load(left if left is right else left.unionByName(right))
        rounds = max(1, -(-meetings // max(MEETINGS, MEETINGS_PER_ROW * rows)))

        def met(own: DataFrame) -> DataFrame:
            pairs = self._side(own, "a_").join(self._side(right, "b_"), "key").filter(F.col("a_ord") < F.col("b_ord"))
            # the same for both sides of a block; read from both, so that one shuffle of the blocks may serve both
            for c in ("level", "last", "least", "depth"):
                pairs = pairs.filter(F.col(f"a_{c}") == F.col(f"b_{c}"))
            return frequent_meetings(pairs, F.col("a_least"))

        if rounds == 1:
            return met(left)
        share = F.pmod(F.xxhash64("ord"), F.lit(rounds))
        return reduce(DataFrame.unionByName, [materialize(met(left.filter(share == k)), "met") for k in range(rounds)])


def frequent_meetings(met: DataFrame, least: Column) -> DataFrame:
    """Distinct pairs ``(a, b)`` that meet often enough, from meetings ``a_*, b_*`` in blocks of sets."""
    wanted = F.least(spare(F.col("a_size"), least), spare(F.col("b_size"), least))
    needed = least / (F.lit(1.0) + least) * (F.col("a_size") + F.col("b_size")) - F.lit(1e-6)
    deep = (F.col("a_level") > 1) | F.col("a_last") | (needed < wanted + F.col("a_depth"))
    seen = met.filter(overlap_possible("a_", "b_", least, wanted)).select(
        F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), least.alias("least"), wanted.alias("wanted"), deep.alias("deep"),
        overlap_possible("a_", "b_", least).alias("first"))
    # an ord may stand for several sets: the least that any of them asks for
    often = seen.groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("n"), F.min("wanted").alias("wanted"), F.max("deep").alias("deep"), F.max("first").alias("first"))
    return often.filter(F.col("first") & (F.col("deep") | (F.col("n") >= F.col("wanted")))).select("a", "b").distinct()


# 64-bit words of the parities of a token set.
SIGN_WORDS = 16


def token_signs(ranked: DataFrame, *more: Column) -> DataFrame:
    """``(ord, size, sign, more...)``: every token flips one of ``64 * SIGN_WORDS`` bits, so two sets have at least as many
    tokens apart as their signs have bits."""
    @F.pandas_udf("array<bigint>")
    def fold(codes: pd.Series) -> pd.Series:
        sign = np.zeros((len(codes), SIGN_WORDS), np.int64)
        if len(codes):
            flat = np.concatenate(codes.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(codes)), np.fromiter(map(len, codes), np.int64, len(codes)))
            np.bitwise_xor.at(sign, (row, (flat >> 6) % SIGN_WORDS), np.left_shift(np.int64(1), flat & 63))
        return pd.Series(list(sign))

    return ranked.select("ord", "size", fold("ranked").alias("sign"), *more)


def shared_at_most(a: str, b: str) -> Column:
    """Upper bound of the tokens that two sets share, from their sizes and signs."""
    word = lambda p, i: F.get(F.col(f"{p}sign"), F.lit(i))
    apart = reduce(add, [F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(SIGN_WORDS)])
    return (F.col(f"{a}size") + F.col(f"{b}size") - apart) / F.lit(2.0)


def text_blocks(sets: DataFrame, ranked: DataFrame, threshold: float, hot: int = HOT_TOKEN) -> DataFrame:
    """Blocks for token similarity: plain overlap at the threshold, or a shared domain term and the
    overlap that the boost leaves to reach."""
    plain = prefix_blocks(ranked, threshold, hot=hot).withColumn("least", F.lit(threshold))
    low = max(0.0, threshold - DOMAIN_BOOST)
    termed = sets.select("ord", F.explode("terms").alias("scope"))
    boosted = prefix_blocks(ranked, low, termed, hot).withColumn("least", F.lit(low))
    return plain.unionByName(boosted)


def blocked_texts(df: DataFrame, id_col="id", text_col="description", threshold=0.7,
                  order_col=None, hot: int = HOT_TOKEN) -> tuple[Blocked, DataFrame]:
    if threshold <= DOMAIN_BOOST:
        raise ValueError(f"text blocking needs a threshold above {DOMAIN_BOOST}")
    # tokens hold no space; a digest stands for the set, so that no text is a join key
    sets = df.select(_ord(id_col, order_col).alias("ord"), F.sort_array(tokens(F.col(text_col))).alias("toks"))
    named = materialize(sets.select("ord", F.unhex(F.sha2(F.array_join("toks", " "), 256)).alias("content"), token_codes(F.col("toks")).alias("codes"),
                                    domain_terms(F.col("toks")).alias("terms"), F.monotonically_increasing_id().alias("row")), "contents")
    named = named.filter(F.size("codes") > 0)
    firsts = materialize(named.groupBy("content").agg(F.min("ord").alias("rep"), F.min_by("row", "ord").alias("row")), "first-rows")
    rows = materialize(named.select("ord", "content").join(firsts.drop("row"), "content").select("ord", "rep"), "rows")
    reps = materialize(named.drop("content").join(firsts.select("row"), "row"), "token-sets")
    discard(named)
    ranked = materialize(ranked_sets(reps), "ranked-sets")
    discard(reps)

    def score(a: str, b: str) -> Column:
        return boosted(counted_jaccard(F.col("n_ranked"), F.col(f"{a}size"), F.col(f"{b}size")), F.col(f"{a}terms"), F.col(f"{b}terms"))

    signs = materialize(token_signs(ranked, (F.size("terms") > 0).alias("termed")), "signs")

    def narrow(pairs: DataFrame) -> DataFrame:
        # signs are much shorter than token sets, which then travel for few pairs
        least = F.when(F.col("a_termed") & F.col("b_termed"), threshold - DOMAIN_BOOST).otherwise(threshold)
        needed = least / (F.lit(1.0) + least) * (F.col("a_size") + F.col("b_size")) - F.lit(1e-6)
        return with_rows(pairs, signs).filter(shared_at_most("a_", "b_") >= needed).select("a", "b")

    blocks = text_blocks(ranked.select("ord", "terms"), ranked.select("ord", "size", "ranked"), threshold, hot)
    return NearSets(ranked.drop("ranked"), blocks, score, lambda s: s >= threshold, None, narrow,
                    ((ranked.select("row", F.col("size").alias("load"), "ranked"), None),)), rows


def text_pairs(df: DataFrame, id_col="id", text_col="description", threshold=0.7, order_col=None) -> DataFrame:
    blocked, _ = blocked_texts(df, id_col, text_col, threshold, order_col)
    return _named(blocked.edges())


def text_groups(df: DataFrame, id_col="id", text_col="description", threshold=0.7, order_col=None,
                **tuning) -> DataFrame:
    blocked, rows = blocked_texts(df, id_col, text_col, threshold, order_col)
    # read again by every later step, so computed once
    return materialize(expand(blocked.groups(**tuning), rows, F.lit(1.0)), "groups")


# --- search and look-ups -----------------------------------------------------------------------

QUERY_NUMBERS = 500_000  # numbers of query vectors sent to the tasks at a time
SCORES = 1_000_000  # scores a task holds at a time


def _query_blocks(queries: DataFrame, cols: list[str]):
    """The query table in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in queries.select(*cols).toLocalIterator():
        block.append(row)
        size += len(row[1] or [])
        if size >= QUERY_NUMBERS:
            yield block
            block, size = [], 0
    if block:
        yield block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col="id", vector_col="features",
          filter_col: str | None = None, query_id="query_id", query_vector="query") -> DataFrame:
    """The ``k`` most similar vectors of each query, among those that share its filter value.

    Any number of queries: they go to the tasks in blocks of bounded size, one pass over the vectors for
    each block. An Arrow batch of vectors times a block is one matrix product; only the best ``k`` of
    each batch and query leave it. Zero vectors score 0, missing ones nothing.
    """
    cols = [query_id, query_vector] + ([filter_col] if filter_col else [])
    spark = vectors.sparkSession
    types = dict(vectors.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    schema = f"{query_id} {types[query_id]}, {id_col} {types[id_col]}, score double"
    rows = vectors.select(id_col, vector_col, *([filter_col] if filter_col else []))
    out = None

    def search(sent):
        def run(batches):
            import numpy as np
            import pandas as pd
            block = [q for q in sent.value if q[1] is not None]
            asked = np.array([q[1] for q in block], float)
            lengths = np.linalg.norm(asked, axis=1) if len(block) else np.zeros(0)
            names, wanted = np.array([q[0] for q in block]), np.array([q[2] for q in block]) if filter_col else None
            for batch in batches:
                batch = batch[batch[vector_col].notna()]
                if not len(batch) or not len(block):
                    continue
                own = np.stack([np.asarray(v, float) for v in batch[vector_col]])
                if own.shape[1] != asked.shape[1]:
                    raise ValueError("vectors must have the same length")
                sizes, ids = np.linalg.norm(own, axis=1), batch[id_col].to_numpy()
                width = max(1, SCORES // len(ids))
                for at in range(0, len(block), width):
                    part = slice(at, at + width)
                    scale = lengths[part, None] * sizes[None, :]
                    scores = np.divide(asked[part] @ own.T, scale, out=np.zeros(scale.shape), where=scale > 0)
                    allowed = np.ones(scores.shape, bool) if filter_col is None else wanted[part, None] == batch[filter_col].to_numpy()[None, :]
                    down = np.where(allowed, -scores, np.inf)
                    if k < len(ids):  # all that tie with the last of the best stay for the order by id
                        allowed &= ~(down > np.partition(down, k - 1, axis=1)[:, k - 1:k])
                    q, row = np.nonzero(allowed)
                    order = np.lexsort((ids[row], down[q, row], q))
                    q, row = q[order], row[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < k
                    q, row = q[best], row[best]
                    yield pd.DataFrame({query_id: names[part][q], id_col: ids[row], "score": scores[q, row]})
        return run

    for block in _query_blocks(queries, cols):
        part = rows.mapInPandas(search(spark.sparkContext.broadcast([tuple(r) for r in block])), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def pair_score(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scores of wanted pairs given in either direction; null where a pair was not scored."""
    stored = scores.select(F.least("id_a", "id_b").alias("_lo"), F.greatest("id_a", "id_b").alias("_hi"), "score")
    return (wanted.withColumn("_lo", F.least("id_a", "id_b")).withColumn("_hi", F.greatest("id_a", "id_b"))
            .join(stored, ["_lo", "_hi"], "left").drop("_lo", "_hi"))


def group_of(groups: DataFrame, ids: DataFrame, id_col="id") -> DataFrame:
    return ids.select(F.col(id_col).alias("member_id")).join(groups.select("group_id", "member_id"), "member_id", "left")


def union_all(frames) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
