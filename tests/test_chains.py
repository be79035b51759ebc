"""Long chains: one component far larger than a task may hold, equal to the plain loop, passes counted."""
import logging
import re

from pyspark.sql import functions as F

from keepsake.operators import grouping


def passes(caplog):
    return [int(m.group(1)) for m in (re.search(r"took (\d+) passes", r.getMessage()) for r in caplog.records) if m]


def claim(n, related):
    taken, want = set(), set()
    for i in range(n):
        free = [m for m in (i, *related(i)) if m not in taken]
        if i not in taken and len(free) > 1:
            taken.update(free)
            want.update((i, m) for m in free)
    return want


def test_uneven_chain_forgets_where_it_started(spark, caplog):
    n = 10_000
    reach = [1 + (i * 7919 % 1_009) % 3 for i in range(n)]
    related = lambda i: [m for m in (*range(i - reach[i], i), *range(i + 1, i + reach[i] + 1)) if 0 <= m < n]
    rows = spark.createDataFrame([(i, "similar", 0.9, related(i)) for i in range(n)], "id long, decision string, confidence double, related array<long>")
    with caplog.at_level(logging.INFO, logger="keepsake.operators.grouping"):
        got = {(r.group_id, r.member_id) for r in grouping.groups_from_decisions(rows, cap=4_000).collect()}
    assert got == claim(n, related)
    assert passes(caplog) and max(passes(caplog)) <= 6


def test_regular_chain(spark, caplog):
    # every chunk depends on the phase in which the one before it ends: at most one pass a chunk, and one more
    n, cap = 4_000, 4_000
    rows = spark.range(n).select("id", F.lit("similar").alias("decision"), F.lit(0.9).alias("confidence"),
                                 F.filter(F.array(*[F.col("id") + d for d in (-2, -1, 1, 2)]), lambda x: x.between(0, n - 1)).alias("related"))
    with caplog.at_level(logging.INFO, logger="keepsake.operators.grouping"):
        got = {(r.group_id, r.member_id) for r in grouping.groups_from_decisions(rows, cap=cap).collect()}
    assert got == claim(n, lambda i: [m for m in (i - 2, i - 1, i + 1, i + 2) if 0 <= m < n])
    assert max(passes(caplog)) <= 5 * n // cap + 2


def test_leader_chain(spark, caplog):
    n = 8_000
    edges = spark.range(n).select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 1 + F.col("id") * 7919 % 1009 % 3)).alias("b")).filter(F.col("b") < n).distinct()
    rows = sorted((r.a, r.b) for r in edges.collect())
    with caplog.at_level(logging.INFO, logger="keepsake.operators.grouping"):
        got = {r.b for r in grouping.absorbed(edges, rounds=1, cap=3_000).collect()}
    want = set()
    for a, b in rows:
        if a not in want:
            want.add(b)
    assert got == want
    assert passes(caplog) and max(passes(caplog)) <= 7
