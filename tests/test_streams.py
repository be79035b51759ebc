"""Keyed state with timers over several batches: what is given out, and that state is released."""
from datetime import datetime, timedelta, timezone
from tempfile import mkdtemp

import pytest

from keepsake import streaming as S
from keepsake.session import configure

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, ts timestamp, session_id string, feedback string"


def run(spark, batches, job, name):
    """Rows given out, and the rows of state after each batch."""
    configure(spark)
    base = mkdtemp(prefix=f"keepsake-{name}-")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{k}")
    stream = S.read_stream(spark, f"{base}/in/*", spark.read.parquet(f"{base}/in/0").schema, files_per_batch=1)
    query = S.write_stream(job(stream), f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(f"{base}/out").collect(), held


def at(days, seconds=0):
    return T0 + timedelta(days=days, seconds=seconds)


def test_interaction_log_over_four_batches(spark):
    batches = [
        [(1, at(0), "a", "x"), (2, at(1), "a", "y"), (3, at(1), "a", "z"), (4, at(0), None, "n")],  # 2 and 3 at one time
        [(5, at(2), "b", "p"), (6, at(1.99), "a", "before"), (7, at(7), "b", "q")],  # within 7 days of each other
        [(8, at(16), "b", "r"), (9, at(16.001), "a", "s")],  # both came back after more than 7 days
        [(10, at(40), "c", "t"), (11, at(40.5), "c", "u")]]
    got, held = run(spark, batches, lambda s: S.interaction_log(s, context="feedback"), "log")
    rows = sorted(((r["session_id"] or "", r["interactions"], r["last_context"], (r["last_updated"].replace(tzinfo=timezone.utc) - T0).days) for r in got))
    assert rows == [("", 1, "n", 0), ("a", 1, "s", 16), ("a", 4, "before", 1), ("b", 1, "r", 16), ("b", 2, "q", 7)]
    assert held[-1] == 1 and max(held) == 3  # only the open session of c is left


def test_closed_months_release_their_state(spark):
    batches = [[(i, at(d), "a", kind) for i, (d, kind) in enumerate([(0, "positive"), (30.9, "negative"), (31, "edit"), (30.99, None)])],
               [(10, at(58), "a", "positive"), (11, at(59.5), "b", "negative")],  # February has 28 days
               [(20, at(100), "b", "edit")]]
    got, held = run(spark, batches, lambda s: S.closed_months(s, keys=("session_id",)), "months")
    rows = sorted((r["session_id"], r["period_start"].month, r["positive"], r["negative"], r["edits"], r["total"]) for r in got)
    assert rows == [("a", 1, 1, 1, 0, 3), ("a", 2, 1, 0, 1, 2), ("b", 3, 0, 1, 0, 1)]
    assert held[-1] == 1 and max(held) > 1


def test_intervals_of_no_fixed_length_are_refused(spark):
    with pytest.raises(ValueError):
        S.interaction_log(spark.createDataFrame([], SCHEMA).withColumnRenamed("feedback", "context"), idle="1 month")


def test_ties_of_a_session_window(spark):
    batches = [[(1, at(0), "a", "x"), (3, at(0), "a", "z"), (2, at(0), "a", "y")], [(9, at(30), "b", "w")]]
    got, _ = run(spark, batches, lambda s: S.interaction_sessions(s, context="feedback"), "window")
    assert [(r["interactions"], r["last_context"]) for r in got] == [(3, "z")]


@pytest.mark.parametrize("files", [1, 3])
def test_first_arrivals_of_a_table_of_one_or_many_files(spark, files, tmp_path):
    from bindings import QUERIES
    rows = spark.createDataFrame([(i, f"text {i // 2}") for i in range(12)], "doc_id long, text string").repartition(files)
    rows.write.parquet(f"{tmp_path}/documents.parquet" if files > 1 else f"{tmp_path}/written")
    if files == 1:  # the table itself is a file
        next(tmp_path.glob("written/*.parquet")).rename(tmp_path / "documents.parquet")
    got = QUERIES["s6_first_arrivals"](spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r["n"] for r in got} == {1}


def test_arrivals_are_dealt_to_more_files_as_the_table_grows(spark, tmp_path, monkeypatch):
    from bindings import streams
    from bindings.registry import Tables
    rows = [(i, at(0, i * 60), i % 5, "click") for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    paths = []
    monkeypatch.setattr(streams, "fresh_path", lambda spark, name: paths.append(f"{tmp_path}/{name}") or paths[-1])
    streams._events(Tables(spark, str(tmp_path)))
    files = [len(list((tmp_path / "arrivals" / str(k)).glob("*.parquet"))) for k in range(3)]
    assert files == [6, 6, 6] and spark.read.parquet(f"{paths[0]}/*").count() == 600


def test_stretches_keep_missing_keys_and_the_newest_context():
    import pandas as pd
    from keepsake.streaming.jobs import joined_stretches
    rows = pd.DataFrame({"s": ["a", None, "a", "a", None], "first": [0, 5, 3, 100, 6], "last": [0, 5, 3, 100, 6],
                         "n": [1] * 5, "id": [1, 2, 4, 3, 9], "context": ["x", "y", "z", None, "w"]})
    got = joined_stretches(rows, ["s"], 10)
    assert [tuple(r) for r in got[["first", "last", "n", "id"]].itertuples(index=False)] == [(0, 3, 2, 4), (100, 100, 1, 3), (5, 6, 2, 9)]
    assert got["context"].tolist()[::2] == ["z", "w"] and got["s"].isna().tolist() == [False, False, True]
