"""Exact repeats of at least ``LENGTH`` bytes, removed with suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts anywhere else goes: elsewhere in the same
text, or in another. Strings are judged on the input. Matches do not cross texts.

Bringing suffixes together. A suffix array of all texts is one global order, so the suffixes are first
brought to where their partners are. Each text is winnowed: of every LENGTH-byte string, the GRAM-byte
gram with the smallest hash is its anchor, so two equal strings have equal anchors at equal places. The
bytes around an anchor that such strings can reach are its context. Texts with one hash are one text;
contexts with one hash are one context, and if it occurs twice all of it is repeated. Contexts of an
anchor that occur once go to the suffix arrays with one context of every other kind.

Suffix arrays. A task takes the contexts of whole anchors, about ``BLOCK`` bytes at a time, and builds the
array in two stages: suffixes smaller than their successor are sorted directly, by eight bytes at a time
and only as deep as LENGTH; all others are induced by one scan over the buckets of first bytes. Common
prefixes of neighbours, up to LENGTH, then show which strings occur twice. Only places where a string may
start, and the few that they are induced from, enter the array.

Cores and hot anchors. Strings that start in one part of the places around an anchor share a core, the
bytes common to every one of them, so contexts are grouped by their core: equal strings stay together.
Contexts equal over a whole part are resolved and one of them goes on. An anchor may be in a third of all
texts with as many different contexts. Such a group is split again by where the string starts, in halves.
Halving ends at one start, where equal cores are equal strings, so every group becomes small and no pair
of equal strings is ever parted.

A null text is empty. Texts shorter than LENGTH keep all. Repeated rows are repeats of each other. An
empty table gives an empty result. Hashes have 64 bits and include lengths.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import BASE_INVERSE, BASE, Workspace, bitmap, in_bitmap, mix, powers, session

LENGTH, GRAM = 400, 64
BLOCK = 1 << 20
GROUP = 2_048  # contexts of a group that one task may hold
PARTS = 4  # of the places around an anchor where a string may start


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Of each run of ``width`` values, the least or greatest (``best`` is np.minimum or np.maximum)."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    fill = np.iinfo(x.dtype).max if best is np.minimum else 0
    padded = np.full(blocks * width, fill, x.dtype)
    padded[:n] = x
    ahead = best.accumulate(padded.reshape(blocks, width), axis=1).reshape(-1)
    back = best.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: places, gram hashes, context hashes, and bytes of context from the place on."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        back = powers(BASE_INVERSE, n + 1)
        grams = mix((sums[gram:] - sums[:-gram]) * back[:n - gram + 1])
        width = length - gram + 1
        least = sliding(grams, width, np.minimum)
        # a gram is an anchor if it is the least of some string: pad so that every gram has `width` strings
        around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        around[width - 1:width - 1 + len(least)] = least
        at = np.flatnonzero(sliding(around, width, np.maximum) == grams)
        start, end = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
        context = (sums[end] - sums[start]) * back[start]
        context = mix(context ^ (((at - start) << 32) + (end - at)).astype(np.uint64))
    return at, grams[at].view(np.int64), context.view(np.int64), end - at


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` in the order of their first ``depth`` bytes; ``words`` holds eight bytes from each place."""
    first = words[at]
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    # segments of suffixes not told apart yet, named by the place of the first one, so that names are in order
    active = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = first[1:] != first[:-1]
    segment = np.maximum.accumulate(np.where(new, active, 0))
    for d in range(8, depth, 8):
        # keep suffixes that still have an equal neighbour
        same = np.zeros(len(active) + 1, bool)
        same[1:-1] = segment[active[1:]] == segment[active[:-1]]
        active = active[same[1:] | same[:-1]]
        if not len(active):
            break
        mine = segment[active]
        word = words[np.minimum(at[active] + d, len(words) - 1)]
        uneven = (mine[1:] == mine[:-1]) & (word[1:] != word[:-1])
        if not uneven.any():
            continue
        touched = np.isin(mine, mine[1:][uneven])
        part, seg, w = active[touched], mine[touched], word[touched]
        order = np.lexsort((w, seg))
        at[part] = at[part[order]]
        seg, w = seg[order], w[order]
        fresh = np.ones(len(part), bool)
        fresh[1:] = (seg[1:] != seg[:-1]) | (w[1:] != w[:-1])
        segment[part] = part[np.maximum.accumulate(np.where(fresh, np.arange(len(part)), 0))]
    return at


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` in the order of at least their first ``depth`` bytes, in two stages.

    ``wanted`` marks the suffixes asked for (default: all). Only they, and the successors that they are
    induced from, up to the next one that is sorted directly, take part.
    """
    n = len(text)
    smaller = np.zeros(n, bool)  # than its successor; equal bytes pass the type on from the right
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    last = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(last[::-1])[::-1]
    smaller[:-1] = (following < n) & (step[np.minimum(following, n - 2)] > 0)
    if wanted is None:
        needed = np.ones(n, bool)
    else:
        # a place is needed if a wanted one stands before it with no directly sorted one from there on
        at = np.arange(n)
        asked = np.maximum.accumulate(np.where(wanted, at, -1))
        sorted_before = np.concatenate([[-1], np.maximum.accumulate(np.where(smaller, at, -1))[:-1]])
        needed = wanted | (asked > sorted_before)
    chosen = np.flatnonzero(smaller & needed)
    direct = sort_directly(words, chosen, depth)
    direct = direct[np.argsort(text[direct], kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    induced_ones = needed & ~smaller
    out = [np.zeros(0, np.int64)]
    for c in range(256):
        induced = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        whole, front = [induced], induced
        while len(front):  # a run of one byte induces within its own bucket
            before = front[front > 0] - 1
            front = before[(text[before] == c) & induced_ones[before]]
            whole.append(front)
        bucket = np.concatenate([*whole, direct[bounds[c]:bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & induced_ones[before]]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            chars, starts = np.unique(text[before], return_index=True)
            for char, part in zip(chars, np.split(before, starts[1:])):
                waiting[char].append(part)
    return np.concatenate(out)


def eight_bytes(text: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[:len(text)] = text
    out = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        out[:-1] = out[:-1] << np.uint64(8) | padded[i:len(text) + i]
    return out


def repeated_starts(contexts: list[bytes], low: np.ndarray, high: np.ndarray, group: np.ndarray, origin: np.ndarray,
                    length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes that two different places of one group have, as context numbers and
    starts. Only starts from ``low`` to ``high`` of a context count; ``origin`` names the place in the
    corpus where a context begins, and place p of it is ``origin + p``."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)  # no UTF-8 has this byte
    words = eight_bytes(text)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    inside = np.arange(len(text)) - begins[owner]
    valid = (inside >= low[owner]) & (inside <= np.minimum(high, sizes - length)[owner])
    order = suffix_array(text, words, length, valid)
    order = order[valid[order]]
    none = np.zeros(0, np.int64)
    if len(order) < 2:
        return none, none
    # neighbours with a common prefix of `length` bytes
    alike = np.arange(len(order) - 1)
    for d in range(0, length - length % 8, 8):
        alike = alike[words[order[alike] + d] == words[order[alike + 1] + d]]
    for d in range(length - length % 8, length):
        alike = alike[text[order[alike] + d] == text[order[alike + 1] + d]]
    joined = np.zeros(len(order), bool)
    joined[alike + 1] = True
    run = np.cumsum(~joined)
    mine = owner[order]
    _, kind = np.unique(run * (int(group.max()) + 1) + group[mine], return_inverse=True)
    with np.errstate(over="ignore"):
        place = origin[mine] + inside[order].astype(np.uint64)
    by = np.argsort(kind.reshape(-1), kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(kind.reshape(-1)[by])) + 1])
    twice = np.minimum.reduceat(place[by], cuts) != np.maximum.reduceat(place[by], cuts)
    hit = np.sort(order[by][np.repeat(twice, np.diff([*cuts, len(by)]))])
    return owner[hit], inside[hit]


def _search(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Covered stretches ``fp, ctx, low, high`` of the contexts of whole groups, relative to the anchor."""
    if not len(rows):
        return pd.DataFrame({"fp": [], "ctx": [], "low": [], "high": []}).astype("int64")
    back = rows["back"].to_numpy(np.int64)
    _, group = np.unique(rows["grp"].to_numpy(), return_inverse=True)
    with np.errstate(over="ignore"):
        origin = mix(rows["key"].to_numpy(np.int64).view(np.uint64)) + (rows["at"].to_numpy(np.int64) - back).view(np.uint64)
    who, start = repeated_starts(rows["context"].tolist(), rows["low"].to_numpy(np.int64) + back,
                                 rows["high"].to_numpy(np.int64) + back, group.reshape(-1), origin, length)
    if not len(who):
        return pd.DataFrame({"fp": [], "ctx": [], "low": [], "high": []}).astype("int64")
    # starts of one context, merged where their strings touch
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (start[1:] > start[:-1] + length)
    begin = np.flatnonzero(fresh)
    end = np.concatenate([begin[1:], [len(who)]]) - 1
    w = who[begin]
    return pd.DataFrame({"fp": rows["fp"].to_numpy()[w], "ctx": rows["ctx"].to_numpy()[w],
                         "low": start[begin] - back[w], "high": start[end] + length - back[w]})


def search_groups(contexts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += sum(map(len, batch["context"]))
            if size >= BLOCK:
                rows = pd.concat(held, ignore_index=True)
                done = (rows["grp"] != rows["grp"].iloc[-1]).to_numpy()  # the last group may go on
                if done.any():
                    yield _search(rows[done].reset_index(drop=True), length)
                    held = [rows[~done]]
                    size = sum(map(len, held[0]["context"]))
        if held:
            yield _search(pd.concat(held, ignore_index=True), length)

    return contexts.repartition("grp").sortWithinPartitions("grp").mapInPandas(run, "fp long, ctx long, low long, high long")


def split_hot(hot: DataFrame, space: Workspace, length: int, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups of at most ``group`` contexts, and stretches already known to be repeated, from larger ones."""
    ready, known, number = [], [], 0
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        halves = hot.withColumn("half", F.explode(F.array(
            F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b"))))).filter("half.a <= half.b")
        # strings of this half start at a .. b; of those, a context has the ones from x to y
        x = F.greatest("half.a", -F.col("back"))
        y = F.least("half.b", F.length("context") - F.col("back") - length)
        halves = halves.withColumn("x", x).withColumn("y", y).filter("x <= y")
        piece = lambda a, b: F.substring("context", (F.col("back") + a + 1).cast("int"), (b - a).cast("int"))
        named = halves.withColumn("grp", F.xxhash64("grp", "half.a", "half.b", piece(F.col("half.b"), F.col("half.a") + length))).withColumn(
            "whole", F.xxhash64("x", "y", piece(F.col("x"), F.col("y") + length))).select(
            "grp", "fp", "ctx", "key", "at", "back", "context", F.col("half.a").alias("low"), F.col("half.b").alias("high"), "x", "y", "whole")
        number += 1
        named = space.save(named, f"halves-{number}")
        counted = named.groupBy("grp", "whole").agg(F.count("*").alias("n"), F.min(F.struct("fp", "ctx")).alias("least"))
        again = named.join(counted.filter("n > 1"), ["grp", "whole"])
        known.append(space.save(again.select("fp", "ctx", F.col("x").alias("low"), (F.col("y") + length).alias("high")), f"known-{number}"))
        sizes = counted.groupBy("grp").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        one = named.join(counted, ["grp", "whole"]).filter((F.col("least.fp") == F.col("fp")) & (F.col("least.ctx") == F.col("ctx")))
        left = space.save(one.join(sizes, "grp").select("grp", "fp", "ctx", "key", "at", "back", "context", "low", "high", "kinds"), f"left-{number}")
        space.drop(f"halves-{number}")
        ready.append(left.filter(F.col("kinds") <= group).drop("kinds"))
        hot = left.filter(F.col("kinds") > group).drop("kinds")
        if hot.limit(1).count() == 0:
            return ready, known


def by_core(contexts: DataFrame, space: Workspace, length: int, reach: int, group: int) -> tuple[DataFrame, list[DataFrame]]:
    """Groups for the suffix arrays, and stretches that need none.

    The places where a string may start are cut into ``PARTS``; the strings of one part share a core. Only
    hashes are grouped here: contexts with a core of their own drop out, contexts equal over a whole part
    are repeated there, and of each kind one goes on, with the bytes of that part alone.
    """
    cuts = [-reach + (reach + 1) * i // PARTS for i in range(PARTS + 1)]
    parts = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b - 1).cast("long").alias("b"))
                                for a, b in zip(cuts, cuts[1:]) if a < b]))
    piece = lambda a, b: F.substring("context", (F.col("back") + a + 1).cast("int"), (b - a).cast("int"))
    cut = contexts.withColumn("part", parts).withColumn("x", F.greatest("part.a", -F.col("back"))).withColumn(
        "y", F.least("part.b", F.length("context") - F.col("back") - length)).filter("x <= y")
    slim = cut.select(F.xxhash64("fp", "part.a", piece(F.col("part.b"), F.col("part.a") + length)).alias("grp"),
                      F.xxhash64("x", "y", piece(F.col("x"), F.col("y") + length)).alias("whole"), "fp", "ctx", "x", "y",
                      F.col("part.a").alias("a"), F.col("part.b").alias("b"))
    counted = space.save(slim.groupBy("grp", "whole").agg(F.count("*").alias("n"), F.min(F.struct("fp", "ctx")).alias("one"),
                                                          *[F.first(c).alias(c) for c in ("x", "y", "a", "b")]), "cores")
    again = counted.filter("n > 1").select("grp", "whole")
    known = [space.save(slim.join(again, ["grp", "whole"]).select("fp", "ctx", F.col("x").alias("low"), (F.col("y") + length).alias("high")), "known")]
    sizes = counted.groupBy("grp").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    on = counted.join(sizes, "grp").select("grp", "one.*", "x", "y", "a", "b", "kinds")
    ready = space.save(on.join(contexts, ["fp", "ctx"]).select(
        "grp", "fp", "ctx", "key", "at", (-F.col("x")).alias("back"), piece(F.col("x"), F.col("y") + length).alias("context"),
        F.col("a").alias("low"), F.col("b").alias("high"), "kinds"), "ready")  # of the part, alike for the whole group
    space.drop("cores")
    small, hot = ready.filter(F.col("kinds") <= group).drop("kinds"), ready.filter(F.col("kinds") > group).drop("kinds")
    if hot.limit(1).count():
        more, other = split_hot(hot, space, length, group)
        known += other
        for part in more:
            small = small.unionByName(part)
    return small, known


def covered(docs: DataFrame, space: Workspace, text_col: str, length: int, gram: int, group: int) -> DataFrame:
    """``key, spans`` of texts with repeats; key is the text's hash, spans are sorted and disjoint."""
    spark = docs.sparkSession
    reach = length - gram
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= length)

    @F.pandas_udf("array<struct<at: int, fp: long, ctx: long, ahead: int>>")
    def anchors_of(column: pd.Series) -> pd.Series:
        out = []
        for text in column:
            found = anchors(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), length, gram)
            out.append([{"at": a, "fp": f, "ctx": c, "ahead": e} for a, f, c, e in zip(*[x.tolist() for x in found])])
        return pd.Series(out, dtype=object)

    places = space.save(texts.select("key", F.explode(anchors_of("text")).alias("a")).select("key", "a.*"), "anchors")
    place = F.xxhash64("key", "at")
    # written first: a join back to an aggregate of its own stage is not split when one anchor is hot
    shared = space.save(places.groupBy("fp").agg(F.min(place).alias("one"), F.max(place).alias("other")).filter("one <> other").select("fp"), "shared")
    live = space.save(places.join(shared, "fp"), "live")
    space.drop("anchors", "shared")

    kinds = space.save(live.groupBy("fp", "ctx").agg(
        F.min(F.struct("key", "at", "ahead")).alias("rep"), (F.min(place) < F.max(place)).alias("again")), "kinds")
    low, high = -F.least("rep.at", F.lit(reach)), F.col("rep.ahead")
    whole = kinds.filter("again").select("fp", "ctx", low.cast("long").alias("low"), high.cast("long").alias("high"))
    several = space.save(kinds.groupBy("fp").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("fp"), "several")
    sought = space.save(kinds.join(several, "fp").select("fp", "ctx", "rep.*"), "sought")
    space.drop("several")

    # the contexts' bytes: only texts that have one of them are shuffled
    sent = spark.sparkContext.broadcast(bitmap(sought.select("key")))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(sent.value, hashes.to_numpy(np.int64)))

    wanted = sought.groupBy("key").agg(F.collect_list(F.struct("fp", "ctx", "at", "ahead")).alias("wanted"))
    once = texts.filter(maybe("key")).groupBy("key").agg(F.first("text").alias("text"))
    rows = once.join(wanted, "key").select("key", F.col("text").cast("binary").alias("text"), F.explode("wanted").alias("w"))
    back = F.least("w.at", F.lit(reach))
    contexts = space.save(rows.select(
        "w.fp", "w.ctx", "key", "w.at", back.cast("long").alias("back"),
        F.substring("text", F.col("w.at") - back + 1, back + F.col("w.ahead")).alias("context")), "contexts")
    small, known = by_core(contexts, space, length, reach, group)
    found = whole.unionByName(search_groups(small, length))
    for part in known:
        found = found.unionByName(part)
    found = space.save(found, "found")
    space.drop("contexts", "sought", "kinds")

    hits = live.join(found, ["fp", "ctx"]).select("key", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("end"))
    copies = docs.select(F.xxhash64(text_col).alias("key"), F.octet_length(text_col).alias("n")).filter(F.col("n") >= length)
    copies = copies.groupBy("key").agg(F.count("*").alias("rows"), F.max("n").alias("n")).filter("rows > 1")
    hits = hits.unionByName(copies.select("key", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end")))
    return space.save(hits.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("hits")), "hits")


def merged(hits) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted((h["start"], h["end"]) for h in hits):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def remove(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes, instead of the
    text. Columns of these names are replaced."""
    spark = session(docs.sparkSession)
    space = Workspace(spark, "repeats")
    hits = covered(docs, space, text_col, length, gram, group)
    sent = spark.sparkContext.broadcast(bitmap(hits.select("key")))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(sent.value, hashes.to_numpy(np.int64)))

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, mine in zip(texts, found):
            data = (text or "").encode("utf-8", "replace")
            spans = merged(mine) if mine is not None else []
            kept, at = [], 0
            for start, end in spans:
                kept.append(data[at:start])
                at = end
            rows.append((sum(e - s for s, e in spans), len(spans), b"".join([*kept, data[at:]])))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    # the other columns travel as one struct, so none of them can clash
    others = F.struct(*[docs[c] for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "kept")])
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    base = docs.select(others.alias("row"), docs[text_col].alias("text"), size.alias("n_bytes"), F.xxhash64(docs[text_col]).alias("key"))
    plain = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    asked = maybe("key")
    sure = base.filter(~asked).select("row.*", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), plain.alias("kept"))
    joined = base.filter(asked).join(hits, "key", "left")
    done = joined.select("row", "n_bytes", cut("text", "hits").alias("cut")).select("row.*", "n_bytes", "cut.*")
    return sure.unionByName(done)
