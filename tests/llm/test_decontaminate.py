import random

from keepsake.llm import decontaminate as d


def brute(item, text, k):
    """Least edit distance between the item and any stretch of the text, if at most k."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
        row = new
    best = min(row)
    return (best, row.index(best)) if best <= k else None


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcde ")
        elif kind == 1:
            text.insert(at, rng.choice("abcde"))
        else:
            del text[at]
    return "".join(text)


def test_distance_and_search_against_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, sentence(rng.randrange(2, 14))) for i in range(25)]
    ready = d.Items(items, d.RATE)
    for _ in range(60):
        item = rng.choice(items)[1]
        text = d.normal(sentence(20) + " " + edited(rng, item, rng.randrange(0, 7)) + " " + sentence(20))
        want = {(i, *hit) for i, t in items if (hit := brute(t, text, int(len(t) * d.RATE)))}
        assert set(ready.find(text)) == want
        masks = d.character_masks(item)
        assert d.best_match(masks, len(item), text, 5) == brute(item, text, 5)


def test_planted_and_clean(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    text = items.first().text
    made = spark.createDataFrame([(1, "before " + text.upper() + " after"), (2, "nothing of the kind"), (3, None), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in d.leaks(made, items).collect()) == [(0, 0, 0), (1, 0, 0)]
    assert [r.doc_id for r in d.clean(made, items).collect()] == [2, 3]
    known = {r.doc_id for r in d.leaks(docs, items).collect()}
    exact = {r.doc_id for r in docs.collect() for i in items.collect() if i.text in r.text}
    assert exact <= known


def test_blocks_and_odd_rows(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (None, "orphan text"), (2, None), (3, ""), (4, "!!")], "item_id long, text string")
    one = sorted(map(str, d.leaks(odd, items).collect()))
    monkeypatch.setattr(d, "BLOCK", 5)
    assert sorted(map(str, d.leaks(odd, items).collect())) == one and len(one) == 3
    assert d.clean(odd, items).count() == odd.count() - 3
    assert d.leaks(odd, items.limit(0)).count() == 0 and d.leaks(odd.limit(0), items).count() == 0
