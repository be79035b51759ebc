import random

import pytest

from keepsake.llm import counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(counts.VOCABULARY))


def test_documents_against_the_library(docs, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in counts.token_counts(docs).collect()}
    for row in docs.collect():
        text = row["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert got[row["doc_id"]] == (len(text.encode()), n, n > 2048)


def test_strange_characters(library):
    rnd, own = random.Random(3), counts.counter(counts.VOCABULARY)
    some = [" ", "\n", "\x1c", "\x85", "́", "Σ", "İ", "'s", "'LL", "<|startoftext|>", "<|endoftext|>", "\x00", " ", "ﬁ"]
    for _ in range(1500):
        text = "".join(rnd.choice([rnd.choice(some), chr(rnd.randrange(32, 127)), chr(rnd.randrange(0x250)), chr(rnd.randrange(1, 0xD800)),
                                   chr(rnd.randrange(0xE000, 0x110000))]) for _ in range(rnd.randrange(50)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_merges_against_a_plain_loop():
    rnd, own = random.Random(4), counts.counter(counts.VOCABULARY).merges
    rank = {}
    for number, pair in enumerate(zip(["a", "b", "ab", "a", "c"], ["b", "c</w>", "c</w>", "a", "ab"])):
        rank[pair] = number
    small = counts.Merges([list(p) for p in rank], "</w>")
    for _ in range(300):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 14)))
        symbols = [*word[:-1], word[-1] + "</w>"]
        while found := [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]:
            _, i = min(found)
            symbols[i:i + 2] = ["".join(symbols[i:i + 2])]
        assert small.count(word) == len(symbols)
    assert own.count("") == 0


def test_long_words_and_forgetting(library, monkeypatch):
    own = counts.Counter(__import__("public_tokenizers").path(counts.VOCABULARY))
    long = "abcde" * 20_000
    assert own.count(long) == len(library.encode(long, add_special_tokens=False).ids)
    monkeypatch.setattr(counts, "REMEMBERED", 3)
    text = "one two three four five six one two three " * 5
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids) and len(own) <= 3


def test_odd_rows(odd):
    rows = counts.token_counts(odd).collect()
    assert len(rows) == odd.count()
    assert [tuple(r) for r in rows if r["doc_id"] == 2] == [(2, 0, 0, False)]
    assert [tuple(r) for r in rows if r["doc_id"] == 3] == [(3, 0, 0, False)]
    assert [tuple(r) for r in rows if r["doc_id"] == 10] == [(10, 2, 1, False)] * 2
    assert [r["over_limit"] for r in rows if r["doc_id"] == 6] == [True]
    assert counts.token_counts(odd.limit(0)).count() == 0
