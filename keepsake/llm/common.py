"""What the operators here share: session settings, intermediate tables, byte-level words."""
from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keepsake.session import configure, shared_dir, ship

#: Arrow batches of few rows, because one row may be a very long text.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


def session(spark: SparkSession) -> SparkSession:
    """The library's settings, and small Arrow batches; workers can import the package."""
    configure(spark)
    ship(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Workspace:
    """Intermediate tables of one run, in the folder that all executors share.

    ``save`` writes a table once and reads it back: it cuts the lineage and survives lost executors.
    ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def remainder_of(doc_id, modulus: int) -> int:
    """The same for one value inside a task."""
    missing = doc_id is None or doc_id != doc_id
    return zlib.crc32(b"" if missing else str(int(doc_id)).encode()) % modulus


# Words are maximal runs of anything but the six ASCII white-space characters, which is what
# bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, from prefix sums of byte x base ** position."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` values, in order; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(count, np.uint64)
        for i in range(n):
            out = out * BASE + hashes[i:i + count]
        return mix(out)


BITS = 1 << 24


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A filter of fixed size over the 64-bit values of the only column of ``hashes``: 64-bit words, one
    bit for each value modulo ``bits``. It may let other values through, never the reverse, so it saves
    shuffling and an exact join decides; when there are very many values it only saves less."""
    places = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(bits)).cast("long").alias("place"))
    words = places.selectExpr("place DIV 64 AS word", "shiftleft(1L, CAST(place % 64 AS INT)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = np.mod(hashes.astype(np.int64), len(words) * 64)
    return (words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """``key, component`` of every key in ``links`` (``a, b``), component being its smallest key.

    Smallest labels spread along links and along labels themselves (a label's label), so paths shorten
    at least by half a round. Every round is a written table.
    """
    both = space.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(
        "a <> b").distinct(), f"{name}-edges")
    labels = space.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "key"), f"{name}-0")
    number = 0
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "key"), "key").select(
            "key", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        other = labels.toDF("component", "jump")
        jumped = spread.join(other, "component", "left").select(
            "key", F.least("component", F.coalesce("jump", "component")).alias("component"), "was")
        number += 1
        after = space.save(jumped, f"{name}-{number}")
        changed = after.filter("component <> was").limit(1).count()
        space.drop(f"{name}-{number - 1}")
        labels = after.select("key", "component")
        if not changed:
            return labels
