"""Similarity join on word n-grams with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles (lower-cased A-Z); two documents link if the Jaccard
similarity of their sets is at least ``PERCENT`` / 100. Shingles are 64-bit hashes.

Method. All sets are ordered alike: by a table of shingle counts, rare first, then by hash. If two sets
of sizes m and n link, then for every l their first ``n - ceil(t n) + l`` shingles (the l-prefixes) share
at least l shingles. l = 1 gives the shortest prefixes and the most candidates; a larger l costs more
prefix shingles but asks for more matches. Each document picks its own l: it doubles l until the
candidates to be expected, the documents that have its prefix shingles divided by l, are few, or the
prefix has grown by a sixteenth of the set. A pair is held to the smaller l of the two. Of l or more
shared shingles the rarest is not among the l - 1 most frequent of either prefix, so those lists are not
paired at all; the pairs that remain must share l shingles before their sets are compared.

What a pair must share in its prefixes follows from both sizes: the sets must have
``t / (1 + t) (m + n)`` shingles in common, and what lies behind the prefix of the set whose prefix ends
first holds ``n - p`` of them at most. For sets of one size that is far more than l, so pairs are counted
before any list is fetched, then compared by whole prefixes, and few but true pairs have their sets read.
The same bound holds at each match: what is ahead of it in both prefixes and in other documents too, and what
is behind it (in the prefix that ends first, again what other documents have), must be enough; so documents that share a passage after much text of their own do not meet.

Documents with equal sets are one node, so copies never meet. Large groups of near copies would still
give pairs by the square, so most links are found in rounds before: every prefix shingle names one node
as its head, every component proposes to join the head that most shingles of one of its nodes name, and the
proposals, at most one for each component, are verified. The first heads are the nodes with the smallest
part of their set ahead of the shingle: copies with the fewest edits, which most others link to. Then the
heads change from round to round, so a node that is too far from one member of a group meets another. Links
of a round join the components of the rounds before, each one node by then. When a round brings little, all pairs of different
components that the prefixes allow are verified. No link between components can be missed, and links inside
a component cannot change it.

The count table has a fixed size: shingles are counted by hash modulo ``COUNTERS``, over all documents,
and kept as one byte each, an eighth of a power of two a step. It decides the order only, so it cannot
lose a link. What leaves a task unreduced is prefix shingles and
sets of candidates, never texts.

A null text, or one without words, has an empty set, links to nothing and is a component of its own. A
text of one to four words has one shingle, the whole. Repeated rows are members of one node. A null id
never names a component unless no member has another.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, bitmap, components, in_bitmap, mix, session, windows, word_hashes, word_spans

WORDS, PERCENT = 5, 80
COUNTERS, CHUNK = 1 << 24, 1 << 16
BLOCK = 1 << 18  # bytes of texts hashed at once, or one longer text
FEW = 8  # expected candidates of a document that make its prefix short enough


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return np.unique(windows(word_hashes(data, starts, ends), min(words, len(starts))))


def shingle_sets(texts, words: int = WORDS) -> list[np.ndarray]:
    """:func:`shingles` of each text, hashed ``BLOCK`` bytes of texts at a time."""
    out, block, size = [], [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "replace").lower()
        block.append(data)
        size += len(data) + 1
        if size >= BLOCK:
            out += block_sets(block, words)
            block, size = [], 0
    return out + block_sets(block, words)


def block_sets(block: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(block), np.uint8)  # no word holds white space, so none joins two texts
    starts, ends = word_spans(data)
    hashes = word_hashes(data, starts, ends)
    runs = windows(hashes, words)
    edges = np.searchsorted(starts, np.cumsum([0, *[len(x) + 1 for x in block]]))  # the words of each text
    out = []
    for at, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if end - at >= words:
            found = np.sort(runs[at:end - words + 1])
            new = found[1:] != found[:-1]
            out.append(found if new.all() else found[np.concatenate([[True], new])])
        else:
            out.append(windows(hashes[at:end], end - at) if end > at else np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> list[int]:
    """One 64-bit value for each set."""
    sizes = np.array([len(found) for found in sets], np.int64)
    sums = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    with np.errstate(over="ignore"):
        if len(full):
            mixed = mix(np.concatenate(sets) + np.uint64(0x5851F42D4C957F2D))
            sums[full] = np.add.reduceat(mixed, (np.cumsum(sizes) - sizes)[full], dtype=np.uint64)
        return mix(sums ^ (sizes.astype(np.uint64) << np.uint64(32))).view(np.int64).tolist()


def set_key(found: np.ndarray) -> int:
    return set_keys([found])[0]


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def with_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text; a null id goes to the tasks as 0 with a mark, because pandas has no null integer."""
    id_ = docs[id_col].cast("long")
    return docs.select(F.coalesce(id_, F.lit(0)).cast("long").alias("doc_id"), id_.isNull().alias("no_id"), docs[text_col].alias("text"))


def packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max(initial=0))).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, f"<u{len(raw) // CHUNK}").astype(np.int64)


def read_documents(own: DataFrame, space: Workspace) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, key, n`` of every row, and the count table, from one pass."""
    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            sets = shingle_sets(batch["text"])
            keys, sizes = set_keys(sets), [len(found) for found in sets]
            if sets:
                place, times = np.unique(np.concatenate(sets) & np.uint64(COUNTERS - 1), return_counts=True)
                counts[place.astype(np.int64)] += times.astype(np.uint32)
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"], "no_id": batch["no_id"], "key": keys, "n": sizes, "counts": None})
        for at in range(0, COUNTERS, CHUNK):
            part = counts[at:at + CHUNK]
            if part.any():
                yield pd.DataFrame({"kind": [1], "doc_id": [0], "no_id": [True], "key": [at], "n": [0],
                                    "counts": [packed(part)]})

    read = space.save(own.mapInPandas(run, "kind int, doc_id long, no_id boolean, key long, n long, counts binary"), "read", "kind")

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for part in parts["counts"]:
            total += unpacked(part)
        return pd.DataFrame({"at": [parts["key"].iloc[0]], "counts": [packed(total)]})

    def steps(parts: pd.DataFrame) -> pd.DataFrame:
        out = add(parts)
        return out.assign(counts=[np.floor(8 * np.log2(1 + unpacked(out["counts"][0]))).clip(0, 255).astype(np.uint8).tobytes()])

    # the parts of one chunk are first added in groups, so that no task gets all of them
    chunks = read.filter("kind = 1").select("key", "counts")
    grouped = chunks.groupBy("key", F.pmod(F.xxhash64("counts"), F.lit(64))).applyInPandas(
        lambda p: add(p).rename(columns={"at": "key"}), "key long, counts binary")
    table = np.zeros(COUNTERS, np.uint8)
    for row in grouped.groupBy("key").applyInPandas(steps, "at long, counts binary").collect():  # COUNTERS / CHUNK rows
        table[row["at"]:row["at"] + CHUNK] = np.frombuffer(row["counts"], np.uint8)
    return read.filter("kind = 0").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "key", "n"), table


def reach(n: int) -> int:
    """The largest l of a set."""
    return 1 + n // 16


def choose(counts: np.ndarray, places: np.ndarray, n: int, percent: int) -> int:
    """The l of a set: ``counts`` other documents have its prefix shingles at ``places``."""
    base, l = n - least_overlap(n, percent), 1
    while counts[places < base + l].sum() > FEW * l and 2 * l <= reach(n):
        l *= 2
    return l


def nodes_of(own: DataFrame, table: np.ndarray, space: Workspace, percent: int) -> DataFrame:
    """``key, n, tokens`` of every distinct set that can link to another: its longest prefix in order."""
    spark = own.sparkSession
    sent = spark.sparkContext.broadcast(table)  # COUNTERS bytes

    def run(batches):
        counts = sent.value
        done: set[int] = set()
        for batch in batches:
            rows = []
            sets = shingle_sets(batch["text"])
            for found, key in zip(sets, set_keys(sets)):
                n = len(found)
                if least_overlap(n + 1, percent) > n:  # no larger set is near enough, nor a smaller one
                    continue
                if key in done:
                    continue
                if len(done) < 1 << 20:
                    done.add(key)
                # the set is in order of hashes, which a stable sort keeps among like counts
                order = np.argsort(counts[(found & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                rows.append((key, n, found[order[:n - least_overlap(n, percent) + reach(n)]].view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "n", "tokens"])

    made = own.mapInPandas(run, "key long, n long, tokens array<long>")
    return space.save(made.groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "nodes")


def verify(pairs: DataFrame, own: DataFrame, members: DataFrame, space: Workspace, name: str, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are near enough."""
    spark = own.sparkSession
    needed = space.save(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), f"{name}-needed")
    # the texts to read again: one row with each needed set, found by its id; the key decides
    rows = members.join(needed, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("ids"))
    rows = space.save(rows, f"{name}-rows")
    keys = spark.sparkContext.broadcast(bitmap(needed))
    ids = spark.sparkContext.broadcast(bitmap(rows.select(F.xxhash64("doc_id"))))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(ids.value, hashes.to_numpy(np.int64)))

    def read(batches):
        done: set[int] = set()
        for batch in batches:
            out = []
            sets = shingle_sets(batch["text"])
            for found, key in zip(sets, set_keys(sets)):
                if key not in done and in_bitmap(keys.value, np.array([key]))[0]:
                    if len(done) < 1 << 20:
                        done.add(key)
                    out.append((key, found.tobytes()))
            yield pd.DataFrame(out, columns=["key", "shingles"])

    asked = own.filter(maybe(F.xxhash64(F.when(~F.col("no_id"), F.col("doc_id")))))
    made = asked.mapInPandas(read, "key long, shingles binary")
    sets = space.save(made.join(needed, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles")), f"{name}-sets")
    first, second = sets.toDF("a", "shingles_a"), sets.toDF("b", "shingles_b")
    both = pairs.join(first, "a").join(second, "b")

    def compare(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch["shingles_a"], batch["shingles_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.loc[near, ["a", "b"]]

    links = space.save(both.mapInPandas(compare, "a long, b long"), f"{name}-links")
    space.drop(f"{name}-needed", f"{name}-rows", f"{name}-sets")
    return links


def near_sizes(m, n, percent: int):
    return F.lit(100) * F.least(m, n) >= F.lit(percent) * F.greatest(m, n)


def with_component(live: DataFrame, labels: DataFrame | None, number: int) -> DataFrame:
    """Postings with their nodes' components, only of shingles that several components have. The head of a
    shingle is the first of its nodes in the order of round ``number``."""
    marked = live.withColumn("component", F.col("key")) if labels is None else live.join(labels, "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    turn = F.xxhash64(F.lit(number), "component") if number else F.col("place") / F.col("n")
    order = F.struct(turn.alias("turn"), F.xxhash64(F.lit(number), "key").alias("place"), "component", "key", "n")
    heads = marked.groupBy("token").agg(F.min(order).alias("head"), F.min("component").alias("low"), F.max("component").alias("top"))
    return marked.join(heads.filter("low < top").select("token", F.struct("head.component", "head.key", "head.n").alias("head")), "token")


def must_share(m: Column, n: Column, percent: int) -> Column:
    """Shingles that sets of sizes m and n have in common if they link."""
    return F.ceil(F.lit(percent) * (m + n) / F.lit(100 + percent))


def behind(n: Column, l: Column | int, percent: int) -> Column:
    """Shingles of a set that lie behind its l-prefix."""
    return F.greatest(F.ceil(n * percent / 100) - l, F.lit(0))


def prefixes_share(m: Column, n: Column, l: Column, percent: int) -> Column:
    """Shingles that the l-prefixes of sets of sizes m and n have in common if they link: what lies behind the
    prefix that ends first is all that they may share elsewhere. Never under l."""
    return must_share(m, n, percent) - F.greatest(behind(m, l, percent), behind(n, l, percent))


def linkable(live: DataFrame, percent: int) -> DataFrame:
    """Postings of the nodes that may link, of the shingles that several nodes have. A node that links with one of
    size m has at least as many such shingles as their longest prefixes share, and each also occurs in
    a set of size m; sizes are known as a range for each shingle."""
    sizes = live.groupBy("token").agg(F.count("*").alias("documents"), F.min("n").alias("low"), F.max("n").alias("top"))
    met = live.join(sizes.filter("documents > 1"), "token")
    n, longest = F.col("n"), lambda m: F.lit(1) + F.floor(F.least(m, F.col("n")) / 16)
    low, top = F.greatest("low", F.ceil(n * percent / 100)), F.least("top", F.floor(n * 100 / percent))
    # what is shared grows with m up to n, then falls, but for one by rounding
    least = F.least(prefixes_share(low, n, longest(low), percent), prefixes_share(top, n, longest(top), percent) - F.when(top > n, 1).otherwise(0))
    lists = met.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(least.alias("least"), "place", "token"))).alias("list"))
    enough = F.exists(F.transform("list", lambda x, i: x["least"] <= i + 1), lambda x: x)
    return lists.filter(enough).select("key", "n", F.explode("list").alias("one")).select("key", "n", "one.place", "one.token")


def proposals(marked: DataFrame, percent: int) -> DataFrame:
    """For each component at most one pair ``a, b``: the node and head with the most common shingles, if
    they are a twentieth of the smaller set. Pairs left out are met in the last step."""
    named = marked.filter((F.col("component") != F.col("head.component")) & near_sizes(F.col("n"), F.col("head.n"), percent))
    counted = named.groupBy("component", F.col("key").alias("a"), F.col("head.key").alias("b")).agg(
        F.count("*").alias("times"), F.first(F.least("n", "head.n")).alias("n"))
    best = counted.filter("20 * times >= n").groupBy("component").agg(F.max(F.struct("times", "a", "b")).alias("best"))
    return best.select(F.least("best.a", "best.b").alias("a"), F.greatest("best.a", "best.b").alias("b")).distinct()


def from_here(x: str, y: str, percent: int) -> Column:
    """The most matches from a shingle of ``x`` and ``y`` on, itself included, if the longest prefix of ``x`` ends
    first: in it only shingles that other components have can match, behind it and in ``y`` all may."""
    own, other = (lambda name: F.col(f"{x}.{name}")), (lambda name: F.col(f"{y}.{name}"))
    beyond = F.greatest(F.ceil(own("n") * percent / 100) - F.lit(1) - F.floor(own("n") / 16), F.lit(0))
    return F.least(own("live") - own("before") + beyond, other("n") - other("place"))


def candidates_of(marked: DataFrame, space: Workspace, percent: int) -> DataFrame:
    """All pairs ``a, b`` of nodes of different components whose prefixes share enough."""
    counts = marked.groupBy("token").agg(F.count("*").alias("documents"))
    lists = marked.join(counts, "token").groupBy("key").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.collect_list(F.struct("documents", "token", "place")).alias("list"))

    def rank(batches):
        for batch in batches:
            parts = []
            for key, n, component, own in zip(batch["key"], batch["n"], batch["component"], batch["list"]):
                own = sorted(((r["documents"], r["token"], r["place"]) for r in own), reverse=True)  # the most frequent first
                places = np.array([p for _, _, p in own])
                l = choose(np.array([d - 1 for d, _, _ in own]), places, n, percent)
                parts.append(pd.DataFrame({"key": key, "n": n, "l": l, "component": component, "token": [t for _, t, _ in own],
                                           "place": places, "before": np.searchsorted(np.sort(places), places), "live": len(own),
                                           "rank": np.arange(1, len(own) + 1)}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    ranked = space.save(lists.mapInPandas(rank, "key long, n long, l int, component long, token long, place int, before int, live int, rank int"), "ranked")
    x, y, l = ranked.alias("x"), ranked.alias("y"), F.least("x.l", "y.l")
    share = prefixes_share(F.col("x.n"), F.col("y.n"), l, percent)
    prefix = lambda s: F.col(f"{s}.place") < F.col(f"{s}.n") - F.ceil(F.col(f"{s}.n") * percent / 100) + l
    met = x.join(y, "token").filter(
        (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.rank") >= share) & (F.col("y.rank") >= share)
        & near_sizes(F.col("x.n"), F.col("y.n"), percent) & prefix("x") & prefix("y")
        # ahead of this shingle only those that other components have can match
        & (F.least("x.before", "y.before") + F.greatest(from_here("x", "y", percent), from_here("y", "x", percent))
           >= must_share(F.col("x.n"), F.col("y.n"), percent)))
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), l.alias("l")).distinct()


def share_enough(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b, l`` whose l-prefixes share l shingles, and whose longest ones enough."""
    spark = nodes.sparkSession
    keys = spark.sparkContext.broadcast(bitmap(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()))

    @F.pandas_udf("boolean")
    def maybe(found: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(keys.value, found.to_numpy(np.int64)))

    own = nodes.filter(maybe("key"))
    both = pairs.join(own.toDF("a", "n_a", "tokens_a"), "a").join(own.toDF("b", "n_b", "tokens_b"), "b")

    def compare(batches):
        for batch in batches:
            good = []
            for l, m, n, x, y in zip(batch["l"], batch["n_a"], batch["n_b"], batch["tokens_a"], batch["tokens_b"]):
                low = [size - least_overlap(size, percent) + l for size in (m, n)]
                near = len(np.intersect1d(x[:low[0]], y[:low[1]], assume_unique=True)) >= l
                shared = len(np.intersect1d(x, y, assume_unique=True)) if near else 0
                need = -(-percent * (m + n) // (100 + percent))
                good.append(near and shared + max(m - len(x), n - len(y)) >= need)
            yield batch.loc[good, ["a", "b"]]

    return both.mapInPandas(compare, "a long, b long")


def merged(labels: DataFrame | None, found: DataFrame, space: Workspace, name: str) -> DataFrame:
    """``key, component`` after the links ``a, b`` found. A component of before is one node, named by its
    smallest key, so links of earlier rounds are not followed again."""
    if labels is None:
        return components(found, space, name)
    for end in ("a", "b"):
        found = found.join(labels.toDF(end, "of"), end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    joined = components(found.distinct(), space, name)
    now = labels.join(joined.toDF("component", "now"), "component", "left").select("key", F.coalesce("now", "component").alias("component"))
    return space.save(now.unionByName(joined.join(labels, "key", "left_anti")), f"{name}-merged")


def link_components(docs: DataFrame, space: Workspace, id_col: str, text_col: str, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, n`` of every row, and ``key, component`` of the nodes that link to others."""
    own = with_sets(docs, id_col, text_col)
    members, table = read_documents(own, space)
    nodes = nodes_of(own, table, space, percent)
    postings = nodes.select("key", "n", F.posexplode("tokens").alias("place", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("documents")).filter("documents > 1").select("token")
    live = space.save(postings.join(shared, "token"), "shared")
    live, last = space.save(linkable(live, percent), "postings"), "postings"
    space.drop("shared")

    labels, first, number = None, None, 0
    while True:
        marked = space.save(with_component(live, labels, number), f"marked-{number}")
        space.drop(last)
        # a shingle of one component stays one, so the next round needs no others
        live, last = marked.select("key", "n", "place", "token"), f"marked-{number}"
        asked = space.save(proposals(marked, percent).withColumn("l", F.lit(1)), f"asked-{number}")
        asked = space.save(share_enough(asked, nodes, percent), f"proposals-{number}")
        found = verify(asked, own, members, space, f"round-{number}", percent)
        many = found.count()
        first = many if first is None else first
        if many:
            labels = merged(labels, found, space, f"labels-{number}")
        space.drop(f"asked-{number}", f"proposals-{number}")
        number += 1
        if 50 * many <= first:
            break
    live = space.save(linkable(live, percent), "left")
    marked = space.save(with_component(live, labels, number), "marked")
    space.drop(last, "left")
    rest = space.save(candidates_of(marked, space, percent), "met")
    space.drop("marked", "ranked")
    rest = space.save(share_enough(rest, nodes, percent), "candidates")
    space.drop("nodes", "met")
    found = verify(rest, own, members, space, "rest", percent)
    labels = merged(labels, found, space, "labels")
    space.drop("candidates")
    return members, labels


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = session(docs.sparkSession)
    space = Workspace(spark, "similar")
    members, labels = link_components(docs, space, id_col, text_col, percent)
    named = members.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(labels, "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    named = space.save(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(least, "component").select("key", "component_id")
    out = members.join(final, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns of ``docs``. Rows with
    the same id and the same words count as one document and stay or go together; rows with a null id go
    if another member has an id."""
    spark = session(docs.sparkSession)
    space = Workspace(spark, "similar")
    members, labels = link_components(docs, space, id_col, text_col, percent)
    placed = members.filter("n > 0").join(labels, "key", "left").select("doc_id", "key", F.coalesce("component", "key").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    gone = space.save(placed.join(least, "component").filter(
        F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("least")))).select("doc_id", "key").distinct(), "gone")
    # rows whose id is in no way among those that go need no join, so their texts are not shuffled
    sent = spark.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("doc_id"))))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(sent.value, hashes.to_numpy(np.int64)))

    @F.pandas_udf("long")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series(set_keys(shingle_sets(t if isinstance(t, str) else None for t in texts)), dtype="int64")

    # the rows travel as one struct, so no column of theirs can clash
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    hit = maybe(F.xxhash64("doc_id"))
    sure = rows.filter(~hit)
    asked = rows.filter(hit).withColumn("key", key_of("text"))
    left = asked.join(gone, asked["doc_id"].eqNullSafe(gone["doc_id"]) & (asked["key"] == gone["key"]), "left_anti")
    return sure.select("row").unionByName(left.select("row")).select("row.*")
