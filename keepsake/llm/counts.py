"""Token counts without tokens: byte-pair merging on a heap and a linked list.

A word starts as its symbols, the byte-level characters of its UTF-8 form, the last one marked as the
word's end. All adjacent pairs that can merge lie on a heap by rank, then place. The lowest is popped, its
right symbol is taken out of the linked list, and the pairs with the new neighbours are pushed; a popped
pair whose symbols have changed meanwhile is passed over. When the heap is empty, the number of tokens is
the initial symbols less the merges. No identifier is made. A word of n symbols takes O(n log n).

Normal form, division into words and special strings are those of the vocabulary file, taken from the
tokenizer library's own parts for it: a special string inside a text is one token, then each rest is
normalised and divided. None of this reaches across ASCII white space, so counts are remembered for each
stretch between white space, in a table of bounded size.

A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each; a null id is allowed. Texts
of any length are counted whole, without truncation. Equal ranks do not exist; of equal pairs the left
one merges first. An empty table gives an empty result. Columns other than id and text are not carried.
"""
from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import session

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
REMEMBERED, LONGEST = 1 << 20, 64  # stretches a worker keeps (some 150 MB), and the bytes of the longest one kept


class Merges:
    """Symbols as small numbers; the rank of each pair that merges, and what each rank makes."""

    def __init__(self, merges: list, word_end: str):
        symbols: dict[str, int] = {}
        number = lambda s: symbols.setdefault(s, len(symbols))
        pairs, self.made = [], []
        for pair in merges:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append((number(left), number(right)))
            self.made.append(number(left + right))
        self.base = len(symbols) + 1  # a pair is left * base + right; no pair with -1, for no symbol, is equal to one that merges
        self.rank = {left * self.base + right: rank for rank, (left, right) in enumerate(pairs)}
        self.symbols, self.word_end = symbols, word_end

    def count(self, word: str) -> int:
        """Tokens of one word."""
        symbols, rank, base, made = self.symbols, self.rank, self.base, self.made
        size = len(word)
        if size < 2:
            return size
        own = [symbols.get(c, -1) for c in word]
        own[-1] = symbols.get(word[-1] + self.word_end, -1)
        none = len(made)
        heap = [r * size + i for i in range(size - 1) if (r := rank.get(own[i] * base + own[i + 1], none)) < none]
        heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), size)
            j = after[i]
            if j == size or rank.get(own[i] * base + own[j]) != r:
                continue  # one of the two has merged with another
            x = own[i] = made[r]
            own[j] = -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if (r := rank.get(x * base + own[k], none)) < none:
                    heappush(heap, r * size + i)
            h = before[i]
            if h >= 0 and (r := rank.get(own[h] * base + x, none)) < none:
                heappush(heap, r * size + h)
            merges += 1
        return size - merges


class Counter(dict):
    """Tokens of a stretch of bytes without white space, remembered if short."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        own = model["model"]
        if own["type"] != "BPE" or own.get("continuing_subword_prefix") or own.get("ignore_merges") or own.get("byte_fallback"):
            raise ValueError("the vocabulary is not of plain byte pairs")
        special = [t["content"] for t in model["added_tokens"]]
        if any(re.search(r"\s", s) for s in special):
            raise ValueError("a special string holds white space")
        self.merges = Merges(own["merges"], own.get("end_of_word_suffix") or "")
        library = Tokenizer.from_file(path)
        self.normal, self.divide = library.normalizer, library.pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def rest(self, text: str) -> int:
        normal = self.normal.normalize_str(text) if self.normal else text
        return sum(self.merges.count(word) for word, _ in self.divide.pre_tokenize_str(normal)) if normal else 0

    def __missing__(self, stretch: bytes) -> int:
        text = stretch.decode("utf-8", "replace")
        parts = self.special.split(text) if self.special else [text]
        count = len(parts) - 1 + sum(map(self.rest, parts))
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = count
        return count

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, text.encode("utf-8", "replace").split())) if isinstance(text, str) else 0


@lru_cache(2)
def counter(vocabulary: str) -> Counter:
    """Of a file of the public tokenizers, or of any path."""
    import os

    import public_tokenizers
    return Counter(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    session(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = counter(vocabulary)
        return pd.Series([own.count(text) for text in texts], dtype="int64")

    counted = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"),
                          count(docs[text_col]).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
