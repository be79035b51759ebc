import hashlib
from collections import Counter

import numpy as np
import pytest

from keepsake.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    key = lambda d, i: hashlib.blake2b(d[i:i + length], digest_size=12).digest()
    seen = Counter(key(d, i) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[key(d, i)] > 1:
                cover[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(cover)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((len(d), sum(cover), spans, bytes(b for b, c in zip(d, cover) if not c)))
    return out


def check(docs, **options):
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove(docs, **options).collect()]
    want = brute([r.text for r in docs.collect()], options.get("length", repeats.LENGTH))
    assert sorted(got) == sorted(want)
    return got


def test_suffix_array():
    draw = np.random.default_rng(1)
    for _ in range(300):
        text = np.concatenate([draw.integers(97, 97 + draw.integers(1, 4), draw.integers(1, 60)), [255]]).astype(np.uint8)
        raw = text.tobytes()
        assert repeats.suffix_array(text, repeats.eight_bytes(text), 64).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_documents(docs, group):
    assert sum(r[1] > 0 for r in check(docs, group=group)) > 10


@pytest.mark.parametrize("group", [1_000, 2])
def test_hot_passage_and_periods(spark, group):
    draw = np.random.default_rng(2)
    word = lambda n: "".join(draw.choice(list("abcdé "), n))
    passage = word(70)
    texts = [word(int(draw.integers(0, 60))) + passage[int(draw.integers(0, 9)):int(draw.integers(45, 70))] + word(int(draw.integers(0, 60))) for _ in range(40)]
    texts += ["ab" * 40, "a" * 90, "a" * 41, "ab" * 33 + "c", None, "", passage, passage]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=40, gram=8, group=group)


def test_odd_rows(odd):
    check(odd)
    assert repeats.remove(odd.limit(0)).count() == 0


def test_clashing_columns_keep_their_values(clashing):
    own = [c for c in clashing.columns if c not in ("text", "kept")]
    got = repeats.remove(clashing).select(*own).collect()
    order = lambda rows: sorted(map(repr, rows))
    assert order(got) == order(clashing.select(*own).collect())
