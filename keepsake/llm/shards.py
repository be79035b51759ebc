"""Token ids in training order: fixed-stride binary shards.

Texts are tokenised and cut into sequences of ``length`` ids, the last of a text shorter. A sequence is
number i of input split p; of the domain p * CAPACITY + i a keyed Feistel permutation, walked again while
it leaves the domain, gives it a ticket. The order of the tickets is the training order, and a sequence's
global slot is its rank: slots are 0 .. n - 1 without gaps. No random number is drawn or kept, and no
count is needed before the sequences are written, so every text is tokenised once.

Shards are range partitions of the tickets, all ranges equally long, in ticket order inside. A shard has
one record of ``stride(length)`` bytes for each sequence, so record r starts at byte r * stride, and a
reader can start, stop and resume anywhere. The slot of a shard's first record is the number of records
before it, which follows from the shards' sizes. A record is, big-endian: ticket (8 bytes), document id
(8), number of the sequence in its text (4), ids in use (4), ids of 2 bytes padded with zeros, and one
newline, which lets Spark's text writer and its commit protocol write it to any file system. A null id of
a document is written as the smallest 64-bit number.

A ticket depends on the split and place of a row, which a scan of files repeats exactly when an executor
is lost; read the input from a table. A null or empty text has no sequence. Repeated rows are sequences
of their own. The driver and the tasks that read hold eight bytes for each shard.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, session

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LENGTH, SHARD_BYTES, KEY = 256, 16 << 20, "order-1"
HEADER = 24
MISSING = -(1 << 63)
CAPACITY = 1 << 32  # sequences of one input split
COLUMNS = "slot long, shard long, doc_id long, sequence long, n_tokens long, tokens_sha256 string"


def stride(length: int = LENGTH) -> int:
    return HEADER + 2 * length + 1


@lru_cache(2)
def tokenizer(path: str):
    """Byte-level BPE from a vocabulary file of up to 65,536 ids."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) > 0xFFFF:
        raise ValueError("ids must fit in two bytes")
    return tiktoken.Encoding("shards", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def round_keys(key: str, rounds: int = 6) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}/{i}".encode()).digest()[:8], "big") for i in range(rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def permute(numbers: np.ndarray, n: int, key: str = KEY, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 .. n - 1 at ``numbers``, or its inverse."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(key)
    out = np.asarray(numbers).astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        x = out[open_]
        left, right = x >> bits, x & low
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_mix(left, k) & low), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & low)
        out[open_] = left << bits | right
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
          length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: str = KEY) -> None:
    """Write the shards below ``path`` as ``shard=<number>/``."""
    session(docs.sparkSession)
    id_ = F.coalesce(docs[id_col].cast("long"), F.lit(MISSING)).cast("long")
    own = docs.select(id_.alias("doc_id"), docs[text_col].alias("text")).withColumn("split", F.spark_partition_id())
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    domain = max(1, own.rdd.getNumPartitions()) * CAPACITY
    width = -(-domain // shards)

    def encode(batches):
        coder, place = tokenizer(vocabulary), None
        for batch in batches:
            if not len(batch):
                continue
            if place is None:
                place = int(batch["split"].iloc[0]) * CAPACITY
            heads, parts = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not isinstance(text, str) or not text:
                    continue
                ids = np.array(coder.encode_ordinary(text), ">u2").tobytes()
                doc = int(doc_id).to_bytes(8, "big", signed=True)
                for number, start in enumerate(range(0, len(ids), 2 * length)):
                    part = ids[start:start + 2 * length]
                    parts.append(part)
                    heads.append(doc + number.to_bytes(4, "big") + (len(part) // 2).to_bytes(4, "big"))
            tickets = permute(np.arange(place, place + len(parts)), domain, key)
            place += len(parts)
            yield pd.DataFrame({"ticket": tickets, "shard": tickets // width,
                                "record": [t.to_bytes(8, "big") + h + p for t, h, p in zip(tickets.tolist(), heads, parts)]})

    placed = own.mapInPandas(encode, "ticket long, shard long, record binary")
    ranged = placed.repartitionById(int(shards), F.col("shard").cast("int")).sortWithinPartitions("shard", "ticket")
    record = F.rpad("record", stride(length) - 1, F.lit(b"\0"))
    ranged.select("shard", record.cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """``slot, shard, doc_id, sequence, n_tokens, tokens_sha256`` of every record, from the shards. A
    task holds one shard."""
    size = stride(length)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard")
    sizes = files.select(shard, "length").groupBy("shard").agg(F.sum("length").alias("bytes")).toPandas().sort_values("shard")
    numbers = sizes["shard"].to_numpy()
    firsts = (sizes["bytes"].cumsum() - sizes["bytes"]).to_numpy() // size
    sent = spark.sparkContext.broadcast((numbers, firsts))

    def run(batches):
        for batch in batches:
            for number, content in zip(batch["shard"], batch["content"]):
                data = np.frombuffer(content, np.uint8).reshape(-1, size)
                field = lambda a, b, kind: np.ascontiguousarray(data[:, a:b]).view(kind).reshape(-1).astype(np.int64)
                used = field(20, 24, ">u4")
                first = int(sent.value[1][np.searchsorted(sent.value[0], number)])
                yield pd.DataFrame({
                    "slot": np.arange(first, first + len(data)), "shard": number, "doc_id": field(8, 16, ">i8"),
                    "sequence": field(16, 20, ">u4"), "n_tokens": used,
                    "tokens_sha256": [hashlib.sha256(content[r * size + HEADER:r * size + HEADER + 2 * n]).hexdigest()
                                      for r, n in enumerate(used)]})

    return files.select(shard, "content").mapInPandas(run, COLUMNS).withColumn(
        "doc_id", F.when(F.col("doc_id") != MISSING, F.col("doc_id")))


def materialise(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Write shards to the shared folder and read back what they hold."""
    spark = session(docs.sparkSession)
    path = Workspace(spark, "shards").path("out")
    write(docs, path, length=length, **options)
    try:
        return read(spark, path, length)
    except AnalysisException:  # no text has a sequence, so there is no file
        return spark.createDataFrame([], COLUMNS)
