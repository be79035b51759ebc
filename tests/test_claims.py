"""Groups from decisions in a crowd: settled without components, decisions computed once."""
import logging

from pyspark.sql import functions as F

from keepsake.operators import grouping, neighbors


def claim(seeds):
    """The plain loop: seeds ``(id, related)`` in order."""
    taken, want = set(), []
    for i, related in sorted(seeds):
        free = [m for m in (i, *related) if m not in taken]
        if i not in taken and len(free) > 1:
            taken.update(free)
            want.extend((i, m) for m in free)
    return sorted(want)


def decided(spark, seeds):
    return spark.createDataFrame([(i, "similar", 0.9, r) for i, r in seeds], "id long, decision string, confidence double, related array<long>")


def test_crowd_is_settled_in_rounds(spark, caplog):
    # 40 rows of each instant name the same first rows, as the nearest in time do
    seeds = [(t * 40 + i, [t * 40 + j for j in range(5) if j != i][:4]) for t in range(50) for i in range(40)]
    with caplog.at_level(logging.INFO, logger="keepsake.operators.grouping"):
        got = grouping.groups_from_decisions(decided(spark, seeds)).collect()
    assert sorted((r.group_id, r.member_id) for r in got) == claim(seeds)
    assert any("sure claims: 0 of" in r.getMessage() for r in caplog.records)


def test_uneven_claims_match_the_loop(spark):
    seeds = [(i, sorted({(i * 7919 + d * d * 31) % 900 for d in range(1, 2 + i % 4)} - {i})) for i in range(900)]
    for cap in (5, 20_000):
        got = grouping.groups_from_decisions(decided(spark, seeds), cap=cap).collect()
        assert sorted((r.group_id, r.member_id) for r in got) == claim(seeds)


def test_costly_decisions_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    rows = decided(spark, [(i, [i + 1] if i % 2 == 0 else []) for i in range(100)])
    costly = F.udf(counted, "string")
    got = grouping.groups_from_decisions(rows.withColumn("decision", costly("decision"))).collect()
    assert len(got) == 100
    assert calls.value == 100


def test_nearest_of_repeated_rows(spark):
    # copies of a row are no neighbours of it, and must not push others out of the list
    rows = [(1, 0)] * 4 + [(2, 1), (3, 2), (4, 3), (5, 4), (6, 40)]
    df = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("captured_at"))
    got = {r["id"]: [n["id"] for n in r["near"]] for r in neighbors.nearest_in_time(df).collect()}
    assert got[1] == [2, 3, 4, 5]
    assert got[5] == [4, 3, 2, 1]
    assert got[6] == []
