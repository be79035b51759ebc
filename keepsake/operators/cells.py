"""Near pairs of unit vectors: cells by recursive pivot partition, compared as products of chunks; and
the approximate mode, banded random-hyperplane signatures.

Cells. A cell with too many pairs gets ``FAN`` pivots, picked by hash among its own rows. A row that is at
home in the cell is at home in the part of its closest pivot, and every row is also a guest in each part
whose border is within reach: cosine ``t`` means a distance of at most ``r = sqrt(2 - 2t)``, and a row
within ``r`` of one that prefers pivot p to q satisfies ``x.p - x.q >= -r |p - q|``. So each near pair meets
exactly once in the home of its first row, whatever the data. Parts are split again until their pairs are
few, or until splitting no longer pays: vectors spread evenly in many dimensions have guests everywhere,
and more parts would only multiply rows. Pivots, sizes and rows are tables joined by cell; no list of
pivots goes through the driver.

Products. A cell is a grid of chunks of its home rows times chunks of its members; a task compares one
chunk pair as a matrix product, and many small cells together. Before the whole product, the span of a few
shared pivots bounds a cosine: with P the projection to it, ``x.y <= Px.Py + |x - Px| |y - Py|``. Only
pairs that the bound lets through are multiplied out, if they are a minority.
"""
from __future__ import annotations

from math import acos, ceil, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize

FAN = 16            # parts of a cell that is split
CELL = 2_048        # a cell of this many home rows and members is not split
CHUNK = 4_096       # rows of a side of a grid, at least
WIDEST = 65_536     # and at most
GRID = 16           # chunks of a side, as long as these are not too wide: a row is moved as often
SLICE = 512         # rows of one side in a product
SCORES = SLICE * CHUNK  # scores that a task holds at a time
PAIRS = 32_768      # pairs multiplied out at a time
SMALL = 64          # home rows times members, squared, of a cell that shares a task call with others
SHARED = 16         # shared pivots whose span bounds a cosine
PAIR_COST = 1 / 2048  # of a pair in a product, in moved rows
SLACK = 1e-9


def _stacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else width)


def parts(units: np.ndarray, home: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, parts and home marks: where each row goes when its cell is split."""
    scores = units @ pivots.T
    apart = np.sqrt(np.maximum(0.0, ((pivots[:, None] - pivots[None]) ** 2).sum(-1)))
    inside = np.stack([(scores[:, p:p + 1] - scores + reach * apart[p] >= -SLACK).all(1) for p in range(len(pivots))], 1)
    own = scores.argmax(1)
    at = np.zeros(inside.shape, bool)
    at[np.arange(len(own))[home], own[home]] = True
    rows, to = np.nonzero(inside | at)
    return rows, to, at[rows, to]


def split_cells(live: DataFrame, reach: float, most: int = CELL) -> DataFrame:
    """``(ord, key, home, ...)`` of the rows ``(ord, unit, key, home, ...)`` with every cell ``key`` split as
    far as it pays; the vectors are left out."""
    kept = [c for c in live.columns if c != "unit"]
    done: list[DataFrame] = []
    schema = T.StructType([*[f for f in live.schema if f.name != "key"], T.StructField("key", T.StringType()), T.StructField("parent", T.StringType())])

    def scatter(key, rows: pa.Table, pivots: pa.Table) -> pa.Table:
        units, home = _stacked(rows["unit"], 0), rows["home"].to_numpy(zero_copy_only=False).astype(bool)
        at, to, is_home = parts(units, home, _stacked(pivots["pivot"], units.shape[1]), reach)
        out = rows.drop_columns(["salt", "key"]).take(pa.array(at))
        out = out.set_column(out.column_names.index("home"), "home", pa.array(is_home))
        parent = rows["key"].take(pa.array(at))
        return out.append_column("key", pa.array([f"{p}.{t}" for p, t in zip(parent.to_pylist(), to.tolist())])).append_column("parent", parent)

    depth = 0
    while True:
        pairs = F.col("h").cast("double") * F.col("m")
        sizes = live.groupBy("key").agg(F.sum(F.col("home").cast("bigint")).alias("h"), F.count(F.lit(1)).alias("m"))
        big = materialize(sizes.filter(pairs > float(most) ** 2), "big-cells")
        if big.isEmpty():
            break
        done.append(live.join(big.select("key"), "key", "left_anti").select(*kept))
        hot = live.join(big.select("key", F.ceil(F.col("m") / (4 * CHUNK)).cast("int").alias("salts")), "key")
        hot = hot.withColumn("salt", F.pmod(F.xxhash64("ord"), F.col("salts")).cast("int")).drop("salts")
        mark = F.xxhash64("ord", F.lit(depth))
        picked = hot.filter("home").groupBy("key", F.pmod(mark, F.lit(FAN)).alias("slot")).agg(F.min_by("unit", F.struct(mark, "ord")).alias("unit"))
        pivots = picked.select("key", "unit").join(big, "key").select(
            "key", "unit", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / (4 * CHUNK)) - 1).cast("int"))).alias("salt"))
        pivots = pivots.toDF("cell", "pivot", "share")
        split = materialize(hot.groupBy("key", "salt").cogroup(pivots.groupBy("cell", "share")).applyInArrow(scatter, schema), "split-cells")
        now = split.groupBy("parent", "key").agg(F.sum(F.col("home").cast("bigint")).alias("h"), F.count(F.lit(1)).alias("m"))
        now = now.groupBy("parent").agg((F.sum("m") + PAIR_COST * F.sum(pairs)).alias("cost"))
        before = big.select(F.col("key").alias("parent"), (F.col("m") + PAIR_COST * pairs).alias("before"))
        paying = materialize(now.join(before, "parent").filter("cost < 0.8 * before").select("parent"), "paying-cells")
        done.append(live.join(big.select("key"), "key", "left_semi").join(
            paying.withColumnRenamed("parent", "key"), "key", "left_anti").select(*kept))
        live = split.join(paying, "parent", "left_semi").drop("parent").select(*live.columns)
        depth += 1
    out = live.select(*kept)
    for more in done:
        out = out.unionByName(more)
    return out


def shared_pivots(reps: DataFrame) -> np.ndarray:
    """An orthonormal basis of the span of ``SHARED`` rows picked by hash."""
    picked = [r["unit"] for r in reps.orderBy(F.xxhash64("ord"), "ord").limit(SHARED).select("unit").collect()]
    if not picked:
        return np.zeros((0, 0))
    return np.linalg.qr(np.array(picked, float).T)[0]


def shadow(units: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projections to the span of the basis, and the lengths of what they leave."""
    inside = units @ basis
    return inside, np.sqrt(np.maximum(0.0, 1.0 - (inside * inside).sum(1)))


def close(a: np.ndarray, b: np.ndarray, inside_a: tuple, inside_b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions and cosine of the pairs at or above the threshold, and how many were multiplied out."""
    (pa_, rest_a), (pb, rest_b) = inside_a, inside_b
    may = pa_ @ pb.T + rest_a[:, None] * rest_b[None] >= threshold - SLACK
    count = int(may.sum())
    if 4 * count > may.size:
        scores = a @ b.T
        x, y = np.nonzero(scores >= threshold)
        return x, y, scores[x, y], may.size
    x, y = np.nonzero(may)
    scores = np.concatenate([np.einsum("ij,ij->i", a[x[i:i + PAIRS]], b[y[i:i + PAIRS]]) for i in range(0, len(x), PAIRS)]) if len(x) else np.zeros(0)
    near = scores >= threshold
    return x[near], y[near], scores[near], count


def _several(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float):
    """The same for rows of many small cells, whose numbers are ``left`` and ``right``."""
    order_a, order_b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    first, end = np.searchsorted(right[order_b], left[order_a]), np.searchsorted(right[order_b], left[order_a], "right")
    many = end - first
    xs, ys, found, compared = [], [], [], int(many.sum())
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, compared, PAIRS), "right")
    for low, high in zip(cuts, [*cuts[1:], len(many)]):
        n = many[low:high]
        x = np.repeat(order_a[low:high], n)
        y = order_b[np.repeat(first[low:high], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        scores = np.einsum("ij,ij->i", a[x], b[y])
        near = scores >= threshold
        xs.append(x[near]), ys.append(y[near]), found.append(scores[near])
    if not xs:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(found), compared


def near_pairs(left: DataFrame, right: DataFrame, basis: np.ndarray, threshold: float, counts: bool = False) -> DataFrame:
    """``(a, b, score)``, ``a < b``, of home rows of ``left`` and rows of ``right`` (``ord, key, home, unit``) of
    one cell; each pair once if the cells are those of :func:`split_cells`. Rows with bands (``band``,
    ``bands``) meet in the first band that they share. ``counts``: ``possible`` and ``compared`` pairs instead."""
    left = left.filter("home")
    banded = "bands" in left.columns
    cols = ["ord", "key", "unit", *(["band", "bands"] if banded else [])]
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("h")).join(right.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    sizes = materialize(sizes, "cell-sizes")
    small = F.col("h") * F.col("m") <= SMALL * SMALL
    rows = sizes.filter(small).agg(F.coalesce(F.sum(F.col("h") + F.col("m")), F.lit(0))).first()[0]
    # the wider the chunks, the fewer copies of a row; a large cell has enough pairs of chunks for all tasks
    wide = F.least(F.lit(WIDEST), F.greatest(F.lit(CHUNK), F.ceil(F.greatest("h", "m") / GRID)))
    batch = F.concat(F.lit("+"), F.pmod(F.xxhash64("key"), F.lit(max(1, ceil(rows / (4 * CHUNK))))).cast("string"))
    sizes = sizes.select("key", F.when(small, batch).otherwise(F.concat(F.lit("="), "key")).alias("call"),
                         *[F.when(small, 1).otherwise(F.ceil(F.col(c) / wide)).cast("int").alias(n) for c, n in (("h", "across"), ("m", "down"))])
    of = lambda n: F.pmod(F.xxhash64("ord", F.lit(n)), F.col(n)).cast("int").alias(n)
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n)
    one = left.select(*cols).join(sizes, "key").select("call", *cols, of("across"), to("down"))
    two = right.select(*cols).join(sizes, "key").select("call", *cols, to("across"), of("down"))
    type_ = left.schema["ord"].dataType
    whole = isinstance(type_, T.IntegralType)

    def wanted(x: pa.Table, y: pa.Table, at: np.ndarray, to_: np.ndarray, scores: np.ndarray):
        """Of the pairs found, those in order, in their first common band."""
        if whole and len(at) and not counts:
            down = x["ord"].to_numpy()[at] < y["ord"].to_numpy()[to_]
            at, to_, scores = at[down], to_[down], scores[down]
        if banded and len(at) and not counts:
            p, q, band = _stacked(x["bands"], 0), _stacked(y["bands"], 0), x["band"].to_numpy()[at]
            fresh = np.concatenate([(p[at[i:i + PAIRS]] == q[to_[i:i + PAIRS]]).argmax(1) == band[i:i + PAIRS] for i in range(0, len(at), PAIRS)])
            at, to_, scores = at[fresh], to_[fresh], scores[fresh]
        return at, to_, scores

    def compare(key, x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.rename_columns([c.rstrip("_") for c in y.column_names])
        a, b = _stacked(x["unit"], 0), _stacked(y["unit"], 0)
        if not len(a) or not len(b):
            at, to_, scores, compared, possible = np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0, 0
        elif key[0].as_py().startswith("="):
            possible = len(a) * len(b)
            step, found, compared = max(1, min(SLICE, SCORES // len(b))), [], 0
            (pa_, rest), inside_b = shadow(a, basis), shadow(b, basis)
            for i in range(0, len(a), step):
                at, to_, scores, n = close(a[i:i + step], b, (pa_[i:i + step], rest[i:i + step]), inside_b, threshold)
                compared += n
                found.append(wanted(x, y, at + i, to_, scores))
            at, to_, scores = (np.concatenate(c) for c in zip(*found))
        else:
            names = pa.concat_tables([x.select(["key"]), y.select(["key"])])["key"].combine_chunks().dictionary_encode().indices.to_numpy()
            at, to_, scores, compared = _several(names[:len(a)], names[len(a):], a, b, threshold)
            possible = compared
            at, to_, scores = wanted(x, y, at, to_, scores)
        if counts:
            return pa.table({"possible": [possible], "compared": [compared]})
        return pa.table([x["ord"].take(pa.array(at)), y["ord"].take(pa.array(to_)), pa.array(np.clip(scores, -1.0, 1.0))], ["a", "b", "score"])

    schema = "possible bigint, compared bigint" if counts else T.StructType(
        [T.StructField("a", type_), T.StructField("b", type_), T.StructField("score", T.DoubleType())])
    two = two.toDF(*[f"{c}_" for c in two.columns])  # both sides come from one table
    out = one.groupBy("call", "across", "down").cogroup(two.groupBy("call_", "across_", "down_")).applyInArrow(compare, schema)
    return out if counts or whole else out.filter(F.col("a") < F.col("b"))


# --- approximate mode --------------------------------------------------------------------------

def agreement(threshold: float) -> float:
    """Chance that two vectors at this cosine lie on one side of a random hyperplane."""
    return 1 - acos(max(-1.0, min(1.0, threshold))) / pi


def choose_bands(threshold: float, recall: float, rows: int) -> tuple[int, int]:
    """Hyperplanes of a band, and bands, for an expected recall at the threshold (more above it), with the
    least work: a row is looked up once in each band and meets one in 2 ** bits of unlike rows there."""
    def cost(bits: int) -> float:
        return bands(bits) * (1 + rows / 2 ** bits)

    def bands(bits: int) -> int:
        hit = agreement(threshold) ** bits
        return 1 if hit >= 1 else max(1, ceil(log(1 - recall) / log(1 - hit)))

    best = min(range(4, 31), key=cost)
    return best, bands(best)


def hyperplanes(bits: int, bands: int, dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bands, bits, dim)).round(6)


def signatures(planes: np.ndarray):
    """A function of a vector column: one number for each band."""
    bands, bits, dim = planes.shape
    flat, weight = planes.reshape(bands * bits, dim).T, 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def sign(units: pd.Series) -> pd.Series:
        if not len(units):
            return pd.Series([], dtype=object)
        side = (np.stack(units.to_numpy()) @ flat >= 0).reshape(len(units), bands, bits)
        return pd.Series(list((side * weight).sum(2)))
    return sign


def banded(reps: DataFrame, bits: int, bands: int, dim: int, seed: int = 7) -> DataFrame:
    """``(ord, unit, key, home, band, bands)``: every row at home in one cell of each band."""
    signed = reps.select("ord", "unit", signatures(hyperplanes(bits, bands, dim, seed))("unit").alias("bands"))
    return signed.select("ord", "unit", "bands", F.posexplode("bands").alias("band", "bits")).select(
        "ord", "unit", F.concat_ws(":", "band", "bits").alias("key"), F.lit(True).alias("home"), "band", "bands")


def reach_of(threshold: float) -> float:
    return sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def rows_of(blocks: DataFrame, reps: DataFrame) -> DataFrame:
    return blocks.join(reps.select("ord", "unit"), "ord")


def all_home(reps: DataFrame, key: Column | None = None) -> DataFrame:
    return reps.select("ord", "unit", (F.lit("c") if key is None else key).alias("key"), F.lit(True).alias("home"))
