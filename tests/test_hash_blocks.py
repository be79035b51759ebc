"""Hash blocks: repeated splits lose no pair and stay small where a half of the hash is dense."""
import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import pairs

HEX = "0123456789abcdef"


def hashes(n, seed, dense=""):
    rnd = random.Random(seed)
    return sorted({dense + "".join(rnd.choice(HEX) for _ in range(16 - len(dense))) for _ in range(n)})


@pytest.mark.parametrize("need", range(1, 17))
def test_further_positions_lose_nothing(need):
    rnd = random.Random(need)
    for _ in range(200):
        agreed = rnd.sample(range(16), rnd.randrange(need, 17))
        mask, all_agreed = sum(1 << p for p in agreed[:rnd.randrange(0, need)]), sum(1 << p for p in agreed)
        while wider := pairs.further_positions(mask, need):
            mask = next(m for m in wider if m & all_agreed == m)
        assert bin(mask).count("1") >= need


def test_one_dense_half(spark):
    texts = hashes(2_000, 1, "deadbeef") + hashes(200, 2)
    texts += [t[:8] + t[8:12] + "0000" for t in texts[:50]]
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, hash string").repartition(4)
    blocked, _ = pairs.blocked_hashes(df, threshold=0.93, hot=50)  # 12 of 16 characters agree
    sizes = blocked.blocks.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"))
    most, met = sizes.agg(F.max("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    assert most <= 150 and met < len(texts) ** 2 / 4
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
            if sum(map(str.__eq__, texts[i], texts[j])) >= 12}
    assert {(r["id_a"], r["id_b"]) for r in pairs._named(blocked.edges()).collect()} == want and len(want) > 50


def test_threshold_that_every_pair_reaches(spark, monkeypatch):
    texts = hashes(120, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, hash string")
    reps = df.select(F.col("id").alias("ord"))
    assert pairs.grid_blocks(reps, 20).groupBy("key").count().agg(F.max("count")).first()[0] < 80
    assert pairs.grid_blocks(reps.limit(0), 20).count() == 0
    blocks = pairs.grid_blocks
    monkeypatch.setattr(pairs, "grid_blocks", lambda rows: blocks(rows, 20))
    assert pairs.hash_pairs(df, threshold=0.7).count() == 120 * 119 // 2
    assert pairs.hash_groups(df, threshold=0.7).select("group_id").distinct().count() == 1


@pytest.mark.parametrize("hot", [pairs.HOT_BLOCK, 40])
def test_pairs_of_blocks_are_counted_once_without_a_broadcast(spark, hot):
    texts = hashes(150, 4, "dead") + hashes(150, 5)
    blocked, _ = pairs.blocked_hashes(spark.createDataFrame(list(enumerate(texts)), "id long, hash string"), hot=hot)
    assert (blocked.positions is None) == (hot == 40)
    assert hot == 40 or "BroadcastHashJoin" not in blocked.edges()._jdf.queryExecution().executedPlan().toString()
    agree = lambda x, y, half: sum(map(str.__eq__, x[half * 8:half * 8 + 8], y[half * 8:half * 8 + 8]))
    met = sum(max(agree(x, y, 0), agree(x, y, 1)) >= 4 for n, x in enumerate(texts) for y in texts[:n])
    if blocked.positions:
        assert tuple(blocked.compared().first()) == (len(texts), met) and met > 100
    near = sum(agree(x, y, 0) + agree(x, y, 1) >= 7 for n, x in enumerate(texts) for y in texts[:n])
    assert blocked.edges().count() == near


def test_rows_of_a_small_table_are_dealt_out_before_they_are_repeated(spark):
    texts = hashes(5_000, 6)
    reps = spark.createDataFrame(list(enumerate(texts)), "ord long, hash string").coalesce(1)
    blocks, _ = pairs.hash_blocks(reps, 0.85, hot=len(texts))
    tasks = blocks.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) <= 2 * 140 * pairs.DEALT
    assert blocks.count() == 140 * len(texts)
