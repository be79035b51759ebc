"""Grouping and pair joins against brute force on small crowded fixtures."""
import math
import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import grouping, pairs
from keepsake.operators.curation import ranked


def sequential(n, adjacent):
    leader = {}
    for i in range(n):
        if i in leader:
            continue
        leader[i] = i
        for j in range(i + 1, n):
            if j not in leader and adjacent(i, j):
                leader[j] = i
    return leader


def as_map(groups):
    return {r["member_id"]: r["group_id"] for r in groups.collect()}


def expected_groups(leader):
    size = {}
    for v in leader.values():
        size[v] = size.get(v, 0) + 1
    return {m: v for m, v in leader.items() if size[v] > 1}


@pytest.mark.parametrize("rounds,cap", [(4, 20_000), (4, 0), (1, 10), (0, 6)])
def test_leader_groups_match_the_loop(spark, rounds, cap):
    """All three ways: one walk, rounds only, components of which some are too large."""
    rnd = random.Random(rounds * 100 + cap)
    n = 40
    edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.06} | {(i, i + 1) for i in range(25, 36)}
    df = spark.createDataFrame([(a, b, float(a + b)) for a, b in edges], "a long, b long, score double")
    got = {r["member"]: (r["leader"], r["score"]) for r in grouping.leader_groups(df, rounds, cap).collect()}
    want = {m: (v, float(m + v)) for m, v in sequential(n, lambda i, j: (i, j) in edges).items() if m != v}
    assert got == want


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (11, 9), (20, 21)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in grouping.connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 9, 10: 9, 11: 9, 20: 20, 21: 20}


def hashes(n, seed, near=0.6):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < near:
            h = list(rnd.choice(out))
            for p in rnd.sample(range(16), rnd.choice([0, 0, 1, 3, 8, 9, 10, 11])):
                h[p] = rnd.choice("0123456789abcdef")
            out.append("".join(h))
        else:
            out.append("".join(rnd.choice("0123456789abcdef") for _ in range(16)))
    return out


def chars(a, b):
    return sum(x != y for x, y in zip(a, b))


@pytest.mark.parametrize("hot,peel", [(5_000, False), (2, True)])
def test_hash_groups(spark, hot, peel):
    hs = hashes(60, 7)
    df = spark.createDataFrame(list(enumerate(hs)), "id long, hash string").orderBy(F.rand(3)).repartition(5)
    blocked, rows = pairs.blocked_hashes(df, hot=hot)
    tuning = {"pairs_listed": 0, "pairs_per_row": 0} if peel else {}
    got = as_map(grouping.expand(blocked.groups(**tuning), rows, F.lit(1.0)))
    assert got == expected_groups(sequential(60, lambda i, j: chars(hs[i], hs[j]) <= 9))


@pytest.mark.parametrize("hot", [5_000, 2])
def test_hash_pairs_are_complete(spark, hot):
    hs = sorted(set(hashes(80, 11)))
    df = spark.createDataFrame(list(enumerate(hs)), "id long, hash string")
    blocked, _ = pairs.blocked_hashes(df, hot=hot)
    got = {(r["a"], r["b"]) for r in blocked.edges().collect()}
    assert got == {(i, j) for i in range(len(hs)) for j in range(i + 1, len(hs)) if chars(hs[i], hs[j]) <= 9}


def test_hash_pairs_by_bit(spark):
    hs = sorted(set(hashes(40, 5)))
    rows = spark.createDataFrame(list(enumerate(hs)), "id long, hash string")
    got = {(r["id_a"], r["id_b"]) for r in pairs.hash_pairs(rows, mode="bit").collect()}
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert got == {(i, j) for i in range(len(hs)) for j in range(i + 1, len(hs)) if bits(hs[i], hs[j]) <= 9}


@pytest.mark.parametrize("threshold", [0.3, 0.98])
@pytest.mark.parametrize("peel", [False, True])
def test_vector_groups(spark, threshold, peel):
    rnd = random.Random(int(threshold * 1000))
    vs = []
    for i in range(70):
        if vs and rnd.random() < 0.6:
            base, noise = rnd.choice(vs), rnd.choice([0, 0.001, 0.02, 0.1, 0.4])
            vs.append([x + rnd.gauss(0, noise) for x in base])
        else:
            vs.append([rnd.gauss(0, 1) for _ in range(6)])
    vs[9] = [0.0] * 6
    cos = lambda a, b: (sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
                        if any(a) and any(b) else 0.0)
    df = spark.createDataFrame(list(enumerate(vs)), "id long, features array<double>").repartition(3)
    tuning = {"pairs_listed": 0, "pairs_per_row": 0} if peel else {}
    got = as_map(pairs.vector_groups(df, threshold=threshold, **tuning))
    # equal vectors have a cosine of 1 within rounding
    assert got == expected_groups(sequential(70, lambda i, j: vs[i] == vs[j] and any(vs[i]) or cos(vs[i], vs[j]) >= threshold))


def test_wrong_lengths_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, features array<double>")
    with pytest.raises(Exception, match="same length"):
        pairs.vector_groups(df).collect()
    bad = spark.createDataFrame([(1, "abc")], "id long, hash string")
    with pytest.raises(Exception, match="16 characters"):
        pairs.hash_groups(bad).collect()


def test_text_pairs(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i:03d}" for i in range(40)] + ["roof", "repair", "hvac", "siding"]
    texts = []
    for i in range(60):
        if texts and rnd.random() < 0.6:
            t = rnd.choice(texts).split(" ")
            t = [w for w in t if rnd.random() > 0.15] + rnd.sample(vocabulary, rnd.choice([0, 0, 1, 3]))
        else:
            t = rnd.sample(vocabulary, rnd.randint(1, 14))
        texts.append(" ".join(t))
    sets = [frozenset(t.split()) for t in texts]
    domain = {"roof", "repair", "hvac", "siding"}

    def sim(a, b):
        da, db = a & domain, b & domain
        boost = 0.3 * len(da & db) / max(len(da), len(db)) if da & db else 0
        return min(1.0, (len(a & b) / len(a | b) if a | b else 0) + boost)

    df = spark.createDataFrame(list(enumerate(texts)), "id long, description string")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    reps = sorted(i for s, i in first.items() if s)
    got = {(r["id_a"], r["id_b"]) for r in pairs.text_pairs(df).collect()}
    assert got == {(i, j) for i in reps for j in reps if i < j and sim(sets[i], sets[j]) >= 0.7 - 1e-12}
    groups = as_map(pairs.text_groups(df, pairs_listed=0, pairs_per_row=0))
    assert groups == expected_groups(sequential(60, lambda i, j: bool(sets[i]) and sim(sets[i], sets[j]) >= 0.7 - 1e-12))


def test_ranking_across_tasks(spark):
    rows = [(g, i, (i * 7) % 5) for g, n in ((1, 500), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, id long, q long")
    order = [F.desc("q"), F.col("id")]
    want = {(r["g"], r["id"]): r["rank"] for r in ranked(df, ["g"], order).collect()}
    got = {(r["g"], r["id"]): r["rank"] for r in ranked(df, ["g"], order, limit=50).collect()}
    assert got == want


@pytest.mark.parametrize("cap", [20_000, 3])
def test_groups_from_decisions(spark, cap):
    rnd = random.Random(cap)
    rows = []
    for i in range(60):
        kind = rnd.choice(["unique", "burst_shot", "duplicate", "similar"])
        rows.append((i, kind, 0.8, [] if kind == "unique" else rnd.sample([j for j in range(max(0, i - 3), min(60, i + 4)) if j != i], rnd.randint(1, 3))))
    taken, want = set(), set()
    for i, kind, _, rel in rows:
        if i in taken or kind == "unique":
            continue
        free = [m for m in [i, *rel] if m not in taken]
        if len(free) > 1:
            taken.update(free)
            want |= {(i, m) for m in free}
    df = spark.createDataFrame(rows, "id long, decision string, confidence double, related array<long>").repartition(4)
    got = {(r["group_id"], r["member_id"]) for r in grouping.groups_from_decisions(df, cap=cap).collect()}
    assert got == want
