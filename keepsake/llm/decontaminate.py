"""Benchmark decontamination by pigeonhole edit matching.

A text leaks a test item if some stretch of it is within ``k`` edits of the whole item, where k is
``error_rate`` of the item's length. The item is cut into k + 1 pieces; k edits cannot touch all of them,
so at least one piece occurs unchanged, near the place where it belongs. Pieces are found exactly with
one automaton for all items; around each hit a stretch of item length plus k on either side is verified
with Myers' bit-parallel distance. Stretches of one item that overlap are verified once. The same
count spares nearly all chance hits: the item cut into ``GRAM`` characters each has only k parts that the
edits can touch, so a stretch without that many of the others needs no verification.

Both sides are compared lower-cased, as words of letters and digits with one space between them;
positions are code points of that form. Each row of the test set is an item; an item or text that is
null or has no letter or digit matches nothing. Repeated rows give repeated results.

The test set is a stated query set. It goes to the tasks in blocks of at most ``BLOCK`` characters, one
pass over the texts for each block, so what is broadcast is bounded. Texts are never shuffled.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import session

RATE = 0.1
BLOCK = 4_000_000
GRAM = 5
WORDS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(WORDS.findall(text.lower())) if isinstance(text, str) else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 parts of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Least edit distance, if at most ``k``, between the item and any stretch of ``text``, and where the
    first such stretch ends. One step per character, all rows of the table in one integer."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp = minus | (~(d0 | plus) & full)
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full  # a stretch may start anywhere: no 1 comes in
        plus = hn | (~(d0 | hp) & full)
        minus = hp & d0
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


class Items:
    """One block of test items, made ready for search."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick
        self.items, where = [], {}
        for item_id, text in items:
            k = int(len(text) * rate)
            number = len(self.items)
            grams = [text[i:i + GRAM] for i in range(0, len(text) - GRAM + 1, GRAM)]
            self.items.append((item_id, len(text), k, character_masks(text), grams))
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """Of each item that the normalised text leaks: id, distance, end of the first best stretch."""
        spans: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                _, m, k, _, _ = self.items[number]
                start = last + 1 - length - offset - k
                mine = spans.setdefault(number, [])
                # hits come in order of their ends, so starts are nearly sorted
                if mine and start <= mine[-1][1] and start + m + 2 * k >= mine[-1][0]:
                    mine[-1] = [min(start, mine[-1][0]), max(start + m + 2 * k, mine[-1][1])]
                else:
                    mine.append([start, start + m + 2 * k])
        for number, mine in sorted(spans.items()):
            item_id, m, k, masks, grams = self.items[number]
            least = len(grams) - k
            found = []
            for a, b in mine:
                a = max(0, a)
                stretch = text[a:b]
                if sum([gram in stretch for gram in grams]) < least:
                    continue
                hit = best_match(masks, m, stretch, k)
                if hit:
                    found.append((hit[0], a + hit[1]))
            if found:
                yield item_id, *min(found)


_prepared: dict[int, Items] = {}


def prepared(sent, rate: float) -> Items:
    """The items of a broadcast block, made ready once in each worker."""
    key = id(sent.value)
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = Items(sent.value, rate)
        _prepared[key].source = sent.value  # keeps the id from being used again
    return _prepared[key]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The normalised test set in blocks; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        text = normal(row[1])
        if text:
            block.append((row[0], text))
            size += len(text)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def finder(sent, rate: float):
    @F.pandas_udf("array<struct<item_id: long, distance: long, end: long>>")
    def find(texts: pd.Series) -> pd.Series:
        ready = prepared(sent, rate)
        return pd.Series([[dict(zip(("item_id", "distance", "end"), hit)) for hit in ready.find(normal(t))] for t in texts], dtype=object)
    return find


def free_of(sent, rate: float):
    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        ready = prepared(sent, rate)
        return pd.Series([next(ready.find(normal(t)), None) is None for t in texts], dtype=bool)
    return free


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, end``: one row for each text and each item that it leaks."""
    spark = session(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema, out = "doc_id long, item_id long, distance long, end long", None
    for block in item_blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        part = own.select("doc_id", F.explode(finder(sent, rate)("text")).alias("hit")).select("doc_id", "hit.*")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    spark = session(docs.sparkSession)
    kept = docs
    for block in item_blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        kept = kept.filter(free_of(sent, rate)(kept[text_col]))
    return kept
