"""What lies on disk: files of ended steps, rows that meet nobody, sets that travel with pairs."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keepsake.operators import neighbors, pairs
from keepsake.operators.grouping import shared_counts
from keepsake.session import configure, materialize


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if str(files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark):
    configure(spark)
    before = shuffle_files(spark)
    table = materialize(spark.range(50_000).groupBy(F.col("id") % 1_000).count())
    assert table.count() == 1_000
    assert shuffle_files(spark) <= before


def test_rows_without_a_neighbouring_cell_do_not_travel(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(i, t0 + timedelta(seconds=100 * i), 40 + i * .01, -74.0, 1, 1) for i in range(50)]
    rows += [(100 + i, t0 + timedelta(seconds=130 * i), 50.0, -74.0 + i * .0006, 1, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, t timestamp, latitude double, longitude double, project_id long, creator_id long")
    nodes = df.withColumns({"t": F.unix_micros("t"), "n": F.lit(1).cast("bigint"), "spot": neighbors.Place(.05).cell(F.col("latitude"), F.col("longitude"))})
    met = neighbors.between_cells(nodes, (["project_id"], 300, 0.05), None)
    assert {(r["a_id"], r["b_id"]) for r in met.collect()} >= {(100 + i, 101 + i) for i in range(3)}
    sides = met._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in sides


def test_shared_counts(spark):
    rnd = random.Random(3)
    sets = [sorted(rnd.sample(range(-60, 60), rnd.randrange(0, 40))) for _ in range(40)]
    held = spark.createDataFrame([(i, len(s), s, s[:2] or None) for i, s in enumerate(sets)], "row long, load int, x array<long>, y array<long>")
    asked = spark.createDataFrame([(i, j) for j in range(40) for i in range(40) if i != j and rnd.random() < .3], "a_row long, b_row long")
    got = {(r["a_row"], r["b_row"]): (r["n_x"], r["n_y"]) for r in shared_counts(asked, held).collect()}
    assert got == {(r["a_row"], r["b_row"]): (len(set(sets[r["a_row"]]) & set(sets[r["b_row"]])), len(set(sets[r["a_row"]][:2]) & set(sets[r["b_row"]][:2])))
                   for r in asked.collect()}


def test_sets_that_share_some_rare_tokens_are_no_candidates(spark):
    """300 long texts: any two share three rare tokens of the front, near copies nearly all."""
    rnd = random.Random(4)
    texts = []
    for i in range(300):
        own = [f"own{i}x{j}" for j in range(220)] + rnd.sample([f"some{j}" for j in range(60)], 14)
        texts.append(" ".join(own))
    texts += [" ".join(t.split()[1:]) for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, description string")
    blocked, _ = pairs.blocked_texts(df)
    met = {tuple(r) for r in blocked.candidates(blocked.blocks, blocked.blocks).collect()}
    near = {(i, 300 + i) for i in range(10)}
    assert near <= met and len(met) < 100
    assert {(r["a"], r["b"]) for r in blocked.edges().collect()} == near
