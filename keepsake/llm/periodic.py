"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, REPEATS * q)``
words that no neighbouring word extends keeping q: a phrase said four times or more in a row.

Method. A basic factor is a stretch of 2 ** k words. The dictionary names the factors of every k, equal
ones alike: a factor of the next k is named by the names of its two halves. Factors that occur once in
their text get no name, and no longer one that holds them does. For every k, each factor is paired with
the next place where it occurs. Neighbouring places with the same distance q, at most 2 * 2 ** k, whose
occurrences go on at that distance (i, i + q, i + 2 q: an arithmetic progression) propose the period q.
A proposal is extended to both sides with the dictionary, from its longest factors to its shortest, so in
a logarithmic number of steps. The same stretch proposed with several periods keeps the smallest.

Nothing is lost: in a run of period q take the 2 ** k in [q, 2 q). The next occurrence of a factor inside
the run is exactly q words on, or the run would have a smaller period; and as the run has 4 q words, more
than q neighbouring places have that distance.

The texts of an Arrow batch are worked on together, in arrays over up to ``TOGETHER`` words or one longer
text; names hold the text's number, so nothing crosses texts. No text leaves its task, and nothing is
shuffled.

A null or empty text has no word and no run, and its collapsed text is empty. Repeated rows get the same
result each; a null id is allowed. Two runs may overlap or share a start; they are listed by start, then
period. An empty table gives an empty result. Other columns of the input are not carried, so their names
cannot clash.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import session

LEAST, REPEATS = 6, 4
TOGETHER = 1 << 20  # words in one set of arrays, unless one text has more
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def word_numbers(texts: list[list[bytes]]) -> np.ndarray:
    """A number for every word of the texts; equal only for equal words of one text."""
    out = np.empty(sum(map(len, texts)), np.int32)
    at = first = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out[at:at + len(words)] = [seen.setdefault(w, first + len(seen)) for w in words]
        at, first = at + len(words), first + len(seen)
    return out


def named(places: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names (-1: occurs once) of the factors at ``places`` with ``keys``, those of them with a later
    occurrence, ascending, and the distance to it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    again = np.zeros(len(order) + 1, bool)
    again[1:-1] = ordered[1:] == ordered[:-1]
    group = np.cumsum(~again[:-1]) - 1
    several = again[:-1] | again[1:]
    names = np.full(size + 1, -1, np.int32)
    names[places[order[several]]] = group[several]
    here = places[order[:-1][again[1:-1]]]
    there = places[order[1:][again[1:-1]]]
    ascending = np.argsort(here)
    return names, here[ascending], (there - here)[ascending]


def extended(levels: list[np.ndarray], here: np.ndarray, distance: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretch around ``here`` in which words ``distance`` apart are equal."""
    left, right = here.copy(), here.copy()
    for k in reversed(range(len(levels))):
        names, step = levels[k], 1 << k
        while True:  # more than twice only on the highest level
            a, b = names[np.minimum(right, size)], names[np.minimum(right + distance, size)]
            same = (a >= 0) & (a == b)
            if not same.any():
                break
            right[same] += step
        while True:
            before = left - step
            ok = np.maximum(before, 0)
            a, b = names[ok], names[np.minimum(ok + distance, size)]
            same = (before >= 0) & (a >= 0) & (a == b)
            if not same.any():
                break
            left[same] = before[same]
    return left, right + distance


def find_runs(numbers: np.ndarray, longest: int, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """``start, end, period`` rows of all runs, by start, then period. ``longest``: words of the longest text."""
    size, levels, proposed, length = len(numbers), [], [], 1
    places, keys = np.arange(size, dtype=np.int64), numbers.astype(np.int64)
    while len(places):
        names, here, distance = named(places, keys, size)
        levels.append(names)
        near = distance <= 2 * length
        here, distance = here[near], distance[near]
        if len(here):
            fresh = np.ones(len(here), bool)
            fresh[1:] = (here[1:] != here[:-1] + 1) | (distance[1:] != distance[:-1])
            at = np.flatnonzero(fresh)
            going_on = np.diff(np.append(at, len(here))) > distance[at]
            proposed.append(np.stack([here[at[going_on]], distance[at[going_on]]], 1))
        if length * repeats >= longest:
            break
        places = np.flatnonzero(names[:-1] >= 0)
        places = places[places + length < size]
        second = names[places + length]
        places, second = places[second >= 0], second[second >= 0]
        keys = names[places].astype(np.int64) * (size + 1) + second
        length *= 2
    rows = np.unique(np.concatenate(proposed), axis=0) if proposed else np.zeros((0, 2), np.int64)
    start, end = extended(levels, rows[:, 0], rows[:, 1], size)
    long = end - start >= np.maximum(least, repeats * rows[:, 1])
    found = np.unique(np.stack([start, end, rows[:, 1]], 1)[long], axis=0)  # the smallest period of a stretch is its first
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def work(texts: list[list[bytes]], least: int, repeats: int) -> list[tuple]:
    """Runs, number of words and collapsed text of each text."""
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes)
    found = find_runs(word_numbers(texts), int(sizes.max(initial=0)), least, repeats)
    change = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    dropped = np.cumsum(change) > 0
    cuts = np.searchsorted(found[:, 0], np.append(0, ends))
    out = []
    for i, words in enumerate(texts):
        first = int(ends[i] - sizes[i])
        own = found[cuts[i]:cuts[i + 1]]
        kept = words
        if len(own):
            gone = dropped[first:first + len(words)].tolist()
            kept = [w for w, g in zip(words, gone) if not g]
        out.append(([{"start": int(s) - first, "length": int(e - s), "period": int(q)} for s, e, q in own.tolist()],
                    len(words), b" ".join(kept).decode("utf-8", "replace")))
    return out


def in_batch(texts: list[str | None], least: int, repeats: int) -> list[tuple]:
    out, waiting, words = [], [], 0
    for text in texts:
        own = text.encode("utf-8", "replace").split() if text else []
        if waiting and words + len(own) > TOGETHER:
            out += work(waiting, least, repeats)
            waiting, words = [], 0
        waiting.append(own)
        words += len(own)
    return out + work(waiting, least, repeats)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row. ``runs`` is an array of ``start`` (number of the
    first word), ``length`` and ``period``; ``collapsed`` has the words, joined by one space, without those
    that any run contains after its first period. ``repeats`` below 4 is refused: the method proposes all
    runs of four periods or more."""
    if repeats < 4:
        raise ValueError("runs of fewer than four periods are not all proposed")
    session(docs.sparkSession)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            found, n_words, collapsed = zip(*in_batch(batch.column("text").to_pylist(), least, repeats)) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, RUNS),
                                              pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def looped(text: Column, doc_id: Column) -> Column:
    """Text whose words repeat from some place on, for one in ten ids; others as they are.

    With h the crc32 of the id (a missing one counts as an empty text) and g = floor(h / 10): if 10
    divides h, each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(own: Column) -> Column:
        n = F.size(own)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(own, place(i))), " ")

    # the words are bound once, or every use would split the text again
    changed = F.element_at(F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, loop(own)).otherwise("")), 1)
    return F.when(h % 10 == 0, changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest of them, and digests of all runs and of the collapsed text."""
    least = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", "runs", "collapsed", least.alias("top")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.floor(F.col("top.length") * 1000 / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
