import hashlib
import random
import zlib

import numpy as np
import pytest

from keepsake.llm import periodic


def brute(words):
    """All runs by comparing words at every distance."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(6, 4 * q):
                out.setdefault((start, end + q), q)  # periods ascend, so the smallest stays
            start = end + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def rows_of(words, doc_id):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n, words = h // 10, len(words), list(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randrange(1, 5)):
            words = []
            while len(words) < rnd.randrange(0, 90):
                words += [rnd.choice("abcde"[:letters]) for _ in range(rnd.randrange(1, 9))] * rnd.choice([1, 1, 4, 6])
            texts.append([w.encode() for w in words])
        got = [[tuple(r.values()) for r in runs] for runs, _, _ in periodic.work(texts, 6, 4)]
        assert got == [brute(words) for words in texts]


def test_long_periods_and_nested_runs():
    rnd = random.Random(1)
    inner = [str(i).encode() for i in range(700)] + [b"x"] * 40
    words = [b"a", b"b"] * 50 + inner * 5 + [str(rnd.random()).encode() for _ in range(300)] + [b"b"] * 6
    assert [tuple(r.values()) for r in periodic.work([words], 6, 4)[0][0]] == brute(words)
    many = np.zeros(100_000, np.int32)
    assert periodic.find_runs(many, len(many)).tolist() == [[0, 100_000, 1]]


def test_documents_against_brute_force(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in periodic.digest(periodic.runs(docs.select(
        "doc_id", periodic.looped(docs["text"], docs["doc_id"]).alias("text")))).collect()}
    wanted = {r["doc_id"]: rows_of((r["text"] or "").encode().split(), r["doc_id"]) for r in docs.collect()
              if r["text"] is None or len(r["text"]) < 6000}
    assert len(wanted) > 100 and {k: got[k] for k in wanted} == wanted


def test_odd_rows(spark, odd):
    found = periodic.runs(odd.select("doc_id", periodic.looped(odd["text"], odd["doc_id"]).alias("text")))
    got = sorted((tuple(r) for r in periodic.digest(found).collect()), key=repr)
    wanted = sorted(((r["doc_id"], *rows_of((r["text"] or "").encode().split(), r["doc_id"])) for r in odd.select("doc_id", "text").collect()
                     if not (r["text"] or "").startswith("word0")), key=repr)
    assert [g for g in got if g[0] != 6] == wanted
    assert periodic.runs(odd).count() == odd.count()  # clashing names are not carried
    assert periodic.runs(odd.limit(0)).count() == 0
    null = [r for r in periodic.runs(odd).collect() if r["doc_id"] == 2][0]
    assert (null["runs"], null["n_words"], null["collapsed"]) == ([], 0, "")
    with pytest.raises(ValueError):
        periodic.runs(odd, repeats=3)
