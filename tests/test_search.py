"""Searches with many queries, against a sort of all scores."""
import numpy as np
import pytest

import __spark_entry__ as entry
from keepsake.operators import pairs


def brute(rows, asked, k, by_label=False):
    out = {}
    for q, v, label in asked:
        scored = [(-float(np.dot(v, f) / d) if (d := np.linalg.norm(v) * np.linalg.norm(f)) else 0.0, i) for i, f, own in rows if not by_label or own == label]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("by_label", [False, True])
def test_several_blocks_of_queries(spark, monkeypatch, by_label):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)], int(draw.integers(0, 3))) for i in range(400)]
    asked = [(i, v, label) for i, v, label in rows if i % 10 == 0]
    vectors = spark.createDataFrame(rows, "id long, features array<double>, label long").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, query array<double>, label long")
    monkeypatch.setattr(pairs, "QUERY_NUMBERS", 28)  # seven queries a block
    assert len(list(pairs._query_blocks(queries, ["query_id", "query"]))) == 6
    got = {}
    for r in pairs.top_k(vectors, queries, 7, filter_col="label" if by_label else None).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    assert {q: [found[n + 1] for n in range(len(found))] for q, found in got.items()} == brute_rounded(rows, asked, 7, by_label, got)


def brute_rounded(rows, asked, k, by_label, got):
    """Scores that differ in the last bits only may change places; equal scores to ten digits count as one."""
    want = brute(rows, asked, k, by_label)
    cos = {(q, i): (float(np.dot(v, f) / d) if (d := np.linalg.norm(v) * np.linalg.norm(f)) else 0.0) for q, v, _ in asked for i, f, _ in rows}
    for q, ids in want.items():
        mine = [got[q][n + 1] for n in range(len(got[q]))]
        if len(mine) == len(ids) and all(abs(cos[q, a] - cos[q, b]) < 1e-10 for a, b in zip(mine, ids)):
            want[q] = mine
    return want


def test_a_registered_search_asks_every_hundredth_row(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    want = {i for i in ids if i % 100 == 0} | {i + 1_000_000 for i in ids if i % 100 == 0}
    assert {r["query_id"] for r in entry.queries()["j9_top_k_hundredth"](spark, sf).select("query_id").collect()} == want
