"""Token blocks: hot tokens are split by further shared ones, without loss and without listing a block."""
import random

import pytest
from pyspark.sql import functions as F

from keepsake.functions.text import DOMAIN_TERMS
from keepsake.operators import pairs


def similarity(x, y):
    terms = set(DOMAIN_TERMS)
    tx, ty = x & terms, y & terms
    boost = 0.3 * len(tx & ty) / max(len(tx), len(ty)) if tx and ty else 0.0
    return min(1.0, len(x & y) / len(x | y) + boost)


@pytest.mark.parametrize("hot, threshold", [(2, 0.7), (3, 0.5), (300, 0.7)])
def test_pairs_of_short_texts(spark, hot, threshold, monkeypatch):
    monkeypatch.setattr(pairs, "ROW_COST", 0)
    rnd = random.Random(hot)
    common = [f"common{i}" for i in range(5)]
    texts = []
    for i in range(260):
        own = rnd.sample(common, rnd.randrange(0, 4)) + [f"word{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 9))]
        own += rnd.sample(DOMAIN_TERMS[:3], rnd.randrange(0, 3))
        texts.append(" ".join(own) if own else "it")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, description string").repartition(3)
    blocked, _ = pairs.blocked_texts(df, threshold=threshold, hot=hot)
    assert hot == 300 or blocked.blocks.agg(F.max("level")).first()[0] > 1
    got = {(r["a"], r["b"]) for r in blocked.edges().collect()}
    first = {}
    for i, text in enumerate(texts):
        own = frozenset(w for w in text.split() if len(w) > 2)
        if own:
            first.setdefault(own, i)
    sets = sorted((i, s) for s, i in first.items())
    want = {(i, j) for n, (i, x) in enumerate(sets) for j, y in sets[n + 1:] if similarity(x, y) >= threshold - 1e-12}
    assert got == want


def test_unlike_rows_with_one_common_term(spark):
    """20,000 rows that share one domain term and nothing else: few pairs are compared."""
    n = 20_000
    df = spark.range(n).select("id", F.concat(F.lit("roof "), F.concat_ws(" ", *[
        F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(200_000)).cast("string")) for k in range(8)])).alias("description"))
    blocked, _ = pairs.blocked_texts(df)
    left = blocked.candidates(blocked.blocks, blocked.blocks)
    listed, rows = blocked.load(blocked.blocks)
    print(f"{n} rows: {rows} block rows, {listed} pairs listed, {left.count()} candidates")
    assert listed < 20 * n


def test_signs_spare_token_sets(spark):
    """Candidates that share too little are dropped by their signs, and no pair of the result is."""
    rnd = random.Random(8)
    base = [f"word{i}" for i in range(40)]
    texts = [" ".join(rnd.sample(base, 25) + [f"own{i}x{j}" for j in range(10)]) for i in range(120)]
    texts += [" ".join(t.split()[1:] + ["extra"]) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, description string")
    blocked, _ = pairs.blocked_texts(df, threshold=0.7)
    met = blocked.candidates(blocked.blocks, blocked.blocks).collect()
    kept = {tuple(r) for r in blocked.narrow(spark.createDataFrame([tuple(r) for r in met], "a long, b long")).collect()}
    sets = [frozenset(t.split()) for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if similarity(sets[a], sets[b]) >= 0.7}
    assert want and want <= kept and len(kept) < max(len(met), len(want) + 1)
    assert {(r["a"], r["b"]) for r in blocked.edges().collect()} == want
