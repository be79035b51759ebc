"""Near pairs of vectors: exact cells and the approximate mode against all products."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import cells, pairs


def frame(spark, vectors, parts=3):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, features array<double>").repartition(parts)


def brute(vectors, threshold):
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = units @ units.T >= threshold
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j}


def clusters(n, dim, spread, many, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((many, dim))
    return centres[draw.integers(0, many, n)] + spread * draw.standard_normal((n, dim))


@pytest.mark.parametrize("threshold, spread", [(0.98, 0.1), (0.9, 0.3), (0.5, 0.5)])
def test_small_cells_lose_and_repeat_nothing(spark, threshold, spread, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK", 40)
    monkeypatch.setattr(cells, "SMALL", 12)
    monkeypatch.setattr(cells, "PAIR_COST", 1.0)
    vectors = clusters(700, 16, spread, 9)
    vectors[:300] = vectors[0] + 0.02 * np.random.default_rng(1).standard_normal((300, 16))  # one hot cell
    reps, _ = pairs.distinct_vectors(frame(spark, vectors))
    near = pairs.NearVectors(reps, threshold, cell=30)
    assert threshold == 0.5 or near.blocks.select("key").distinct().count() > 9  # 0.5 reaches across every border
    got = [(r["a"], r["b"]) for r in near.edges().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(vectors, threshold)


def test_names_that_are_structs(spark):
    vectors = clusters(120, 8, 0.2, 4)
    df = frame(spark, vectors).withColumn("at", -F.col("id"))
    got = {(r["id_a"]["id"], r["id_b"]["id"]) for r in pairs.vector_pairs(df, threshold=0.9, order_col="at").collect()}
    assert got == {(b, a) for a, b in brute(vectors, 0.9)}


def test_groups_by_cells(spark):
    vectors = clusters(400, 8, 0.15, 6, seed=4)
    near, taken = brute(vectors, 0.95), {}
    for i in range(len(vectors)):
        if i not in taken:
            taken[i] = i
            for j in range(i + 1, len(vectors)):
                if j not in taken and (i, j) in near:
                    taken[j] = i
    got = {r["member_id"]: r["group_id"] for r in pairs.vector_groups(frame(spark, vectors), threshold=0.95).collect()}
    sizes = np.bincount(list(taken.values()), minlength=len(vectors))
    assert got == {m: g for m, g in taken.items() if sizes[g] > 1}


def test_spread_vectors_compare_few_pairs(spark):
    """3,000 random directions in 64 dimensions, where no cell is selective: the shared pivots are."""
    vectors = np.random.default_rng(5).standard_normal((3000, 64))
    vectors[1::300] = vectors[::300] + 0.01
    reps, _ = pairs.distinct_vectors(frame(spark, vectors))
    near = pairs.NearVectors(reps, 0.98)
    assert {(r["a"], r["b"]) for r in near.edges().collect()} == brute(vectors, 0.98)
    possible, compared = near.multiplied()
    share = compared / (3000 * 2999)
    print(f"spread vectors: {possible} pairs in cells, {compared} multiplied out, {share:.4%} of all")
    assert share < 0.02


@pytest.mark.parametrize("threshold, spread", [(0.98, 0.12), (0.9, 0.3)])
def test_recall_of_the_approximate_mode(spark, threshold, spread):
    vectors = clusters(1500, 32, spread, 120, seed=2)
    want = brute(vectors, threshold)
    got = [(r["id_a"], r["id_b"]) for r in pairs.vector_pairs_approximate(frame(spark, vectors), threshold=threshold).collect()]
    recall = len(set(got) & want) / len(want)
    print(f"recall at {threshold}: {recall:.3f} of {len(want)}")
    assert len(got) == len(set(got)) and set(got) <= want and recall >= 0.9


def test_a_hot_band_is_split(spark, monkeypatch):
    monkeypatch.setattr(cells, "PAIR_COST", 1.0)
    vectors = clusters(600, 16, 0.05, 1, seed=3)
    df = frame(spark, vectors)
    want = brute(vectors, 0.995)
    reps, _ = pairs.distinct_vectors(df)
    live = cells.banded(reps, 4, 12, 16)
    placed = cells.rows_of(cells.split_cells(live, cells.reach_of(0.995), 20), reps)
    got = [(r["a"], r["b"]) for r in cells.near_pairs(placed, placed, cells.shared_pivots(reps), 0.995).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want)


def test_empty_zero_and_missing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "id long, features array<double>")
    assert pairs.vector_pairs(df, dim=2).count() == 0
    assert pairs.vector_pairs_approximate(df, dim=2).count() == 0
    assert cells.choose_bands(0.98, 0.95, 10 ** 9)[0] > cells.choose_bands(0.98, 0.95, 100)[0]


def test_rows_of_a_large_cell_are_moved_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK", 10)
    monkeypatch.setattr(cells, "SMALL", 2)
    monkeypatch.setattr(cells, "GRID", 4)
    vectors = clusters(600, 8, 0.3, 5, seed=2)
    reps, _ = pairs.distinct_vectors(frame(spark, vectors))
    rows = cells.rows_of(cells.all_home(reps).drop("unit"), reps)
    calls = cells.near_pairs(rows, rows, cells.shared_pivots(reps), 0.98, counts=True).collect()
    assert len(calls) <= 16 and sum(r["possible"] for r in calls) == 600 * 600  # 3,600 calls with chunks of ten
    got = {(r["a"], r["b"]) for r in cells.near_pairs(rows, rows, cells.shared_pivots(reps), 0.98).collect()}
    assert got == brute(vectors, 0.98)
