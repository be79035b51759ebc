import itertools
import re

import numpy as np

from keepsake.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [300 * 5 / 8, 300 * 2 / 8, 300 / 8]
    got = mixing.targets([10, 1000, 1000, 10])
    assert got[0] == 30 and got[3] == 30 and abs(sum(got) - 2020) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_knapsack_against_all_subsets():
    draw = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(draw.choice(np.arange(1, 30), 4, replace=False))
        counts, budget = draw.integers(0, 4, 4), int(draw.integers(0, 90))
        take = mixing.knapsack(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {int(np.dot(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])}
        best = min(abs(x - budget) for x in sums if x <= budget + lengths.min())
        assert abs(int(take @ lengths) - budget) == best


def test_documents(docs):
    rows = mixing.mix(docs).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["size"] == words[r.doc_id] and r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    names = sorted(by)
    want = dict(zip(names, mixing.targets([sum(r["size"] for r in by[s]) for s in names])))
    for s in names:
        assert {r.source_size for r in by[s]} == {sum(r["size"] for r in by[s])}
        assert abs(by[s][0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in by[s]) - want[s]) <= 0.02 * want[s] + 5
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in rows)
    assert mixing.repeat(mixing.mix(docs)).count() == sum(r.taken // r["size"] for r in rows if r["size"])


def test_many_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b c' AS text", "CASE WHEN id < 2900 THEN 'x' ELSE 'y' END AS source")
    total = {r.source: r.t for r in mixing.mix(docs).groupBy("source").sum("taken").toDF("source", "t").collect()}
    assert total == {"x": 8700, "y": 300} or all(abs(total[s] - t) <= 3 for s, t in zip("xy", mixing.targets([8700, 300])))


def test_odd_rows(odd):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.select("taken").filter("taken IS NULL OR taken < 0").count() == 0
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.repeat(mixing.mix(odd.limit(0))).count() == 0
