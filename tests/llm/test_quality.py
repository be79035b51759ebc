import random

import numpy as np

from keepsake.llm import quality


def brute(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, dup, earlier = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_features_against_brute_force(docs):
    rng = random.Random(1)
    texts = [r.text for r in docs.collect()] + [None, "", " \n \n", "a\x0bb\x1cc d", "x\nx\nx y\n\n\n"]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    for text in texts:
        assert quality.features_of(text)[:5] == brute(text)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.5
    true = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((20_000, 4)) < true, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    accuracy, posterior = quality.fit(patterns.astype(float), counts.astype(float))
    assert np.abs(accuracy - true).max() < 0.05
    assert (posterior[(patterns == 1).all(axis=1)] > 0.99).all()


def test_labels_and_odd_rows(spark, docs, odd):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    fair = [(got[r.doc_id].kept, r.quality) for r in labels if not got[r.doc_id].base_failed]
    assert np.mean([k == bool(q) for k, q in fair]) > 0.95
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count() and all(r.kept is not None and r.base_failed is not None for r in rows)
    assert quality.judge(odd.limit(0)).count() == 0
