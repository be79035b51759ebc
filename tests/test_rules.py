"""Published cases of single rules, errors, and streams in several batches."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake import functions as K
from keepsake import streaming as S
from keepsake.operators import activity, catalog, curation, feedback, filters
from keepsake.session import fresh_path
from keepsake.sources import readers
from keepsake.sources.snapshots import KeyedTable, Snapshots

NOW = datetime(2025, 1, 10)


def test_photo_fixture(spark):
    rows = [("photo-1", "project-1", "user-1", datetime(2025, 1, 1, 10), 40.7128, -74.0060, "Roofing progress photo", ["roofing", "progress"]),
            ("photo-2", "project-1", "user-1", datetime(2025, 1, 1, 10, 5), 40.7129, -74.0061, "Roofing progress photo - different angle", ["roofing", "progress"]),
            ("photo-3", "project-2", "user-2", datetime(2025, 1, 2, 14), 40.75, -73.98, "HVAC installation", ["hvac", "installation"])]
    df = K.prepare(spark.createDataFrame(rows, "id string, project_id string, creator_id string, captured_at timestamp, latitude double, longitude double, description string, tags array<string>"))
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    got = {(r["a_id"][-1], r["b_id"][-1]): r["s"] for r in a.join(b, F.col("a_id") <= F.col("b_id")).select("a_id", "b_id", K.photo_similarity().alias("s")).collect()}
    assert got["1", "2"]["temporal"] > 0.8 and got["1", "3"]["temporal"] < 0.3 and got["1", "1"]["temporal"] == 1
    assert got["1", "2"]["spatial"] > 0.9 and got["1", "3"]["spatial"] < 0.5
    assert got["1", "2"]["overall"] > 0.6 and got["1", "3"]["overall"] < 0.4 and got["1", "1"]["overall"] == 1
    none = df.select(K.spatial_proximity(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("x")).first()["x"]
    assert none == 0


def test_tag_merge(spark):
    photos = spark.createDataFrame([("p", "text"), ("q", None)], "id string, description string")
    tags = spark.createDataFrame([("p", [("1", "Roofing", "roofing")])], "id string, tags array<struct<id:string,display_value:string,value:string>>")
    ai = spark.createDataFrame([("p", None, ["roofing", "  valid-tag  ", "", "   ", "another-tag"])], "id string, ai_description string, accepted_ai_tags array<string>")
    out = {r["id"]: r for r in catalog.enrich(photos, tags, ai).collect()}
    assert [(t["display_value"], t["is_ai"]) for t in out["p"]["tags"]] == [("Roofing", True), ("valid-tag", True), ("another-tag", True)]
    assert out["p"]["description"] == "text" and out["q"]["tags"] == []


def test_recommendation_order(spark):
    rows = [(0.6, 0.9, 100), (0.9, 0.1, 100), (0.9, 0.1, 10), (0.1, 0.9, 49)]
    df = spark.createDataFrame(rows, "s double, e double, n long")
    got = [r["x"] for r in df.select(feedback.recommendation(F.col("s"), F.col("e"), F.col("n")).alias("x")).collect()]
    assert got == ["evolve", "maintain", "maintain", "maintain"]


def test_period_edges(spark):
    ts = [datetime(2025, 1, 5), datetime(2025, 1, 4, 23, 59, 59), datetime(2025, 2, 28, 23), datetime(2025, 3, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    week = [r["x"] for r in df.select(feedback.period_start(F.col("ts"), "week").alias("x")).collect()]
    assert week == [datetime(2025, 1, 5), datetime(2024, 12, 29), datetime(2025, 2, 23), datetime(2025, 2, 23)]
    end = [r["x"] for r in df.select(feedback.period_end(F.date_trunc("month", "ts"), "month").alias("x")).collect()]
    assert end == [datetime(2025, 2, 1), datetime(2025, 2, 1), datetime(2025, 3, 1), datetime(2025, 4, 1)]


def test_trend_rules(spark):
    rows = [("up", i, v) for i, v in enumerate([1.0, 1.0, 2.0])] + [("nan", i, v) for i, v in enumerate([1.0, None, 9.0])] + [("one", 0, 1.0)] + [("down", i, v) for i, v in enumerate([4.0, 4.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "prompt_id string, period_start int, v double")
    got = {r["prompt_id"]: r["v_trend"] for r in feedback.trends(df, {"v": F.col("v")}).collect()}
    assert got == {"up": "improving", "nan": "stable", "one": "stable", "down": "declining"}


def test_selection_errors(spark):
    df = spark.createDataFrame([], "id long, captured_at timestamp, analyzed_at timestamp, archive_state string")
    for s in (filters.Selection("date-range"), filters.Selection("selection"), filters.Selection("other")):
        with pytest.raises(ValueError):
            filters.select_for_analysis(df, s, NOW)
    assert filters.validate_selection(filters.Selection("date-range", NOW, NOW - timedelta(1))) == "Start date must be before end date"
    assert filters.estimate_selection(df, filters.Selection("selection"), NOW).first()["n"] == 0


def test_tag_filter_cases(spark):
    df = spark.createDataFrame([(1, ["Roofing"]), (2, ["Repair"]), (3, ["Roofing", "Repair"]), (4, None), (5, []), (6, [None, "repair"])], "id long, tags array<string>")
    ids = lambda c: [r["id"] for r in df.filter(c).orderBy("id").collect()]
    assert ids(filters.tags_match(F.col("tags"), ["ROOFING", "repair"], "AND")) == [3]
    assert ids(filters.tags_match(F.col("tags"), ["repair"], "OR")) == [2, 3, 6]
    assert ids(filters.tags_match(F.col("tags"), [], "OR")) == [1, 2, 3, 4, 5, 6]


def test_archive_errors_and_messages(spark):
    photos = spark.createDataFrame([(1, None, None, None)], "id long, archive_state string, archived_at timestamp, archive_reason string")
    with pytest.raises(ValueError, match="not found"):
        curation.set_archive_state(photos, spark.createDataFrame([(2,)], "id long"), "archive", "x", NOW)
    empty = spark.createDataFrame([], "group_id long, type string, size long, keep_count long, minutes_saved double")
    assert curation.summary_message(curation.rollup(empty)).first()["message"] == curation.NOTHING_FOUND
    one = spark.createDataFrame([(1, "retry_shots", 5, 2, 1.5)], empty.schema)
    text = curation.summary_message(curation.rollup(one)).first()["message"]
    assert text.startswith("I noticed 5 photos") and text.endswith("about 2 minutes during photo reviews.")
    none = curation.apply_actions(photos, spark.createDataFrame([], "photo_id long, type string, reason string, seq long"), NOW)[1]
    assert curation.action_summary(none).first()["success"]


def test_hash_edge_cases(spark):
    df = spark.createDataFrame([("00" * 8, "ff" * 8)], "a string, b string")
    row = df.select(K.hamming(F.col("a"), F.col("b"), "bit").alias("bits"), K.hash_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert (row["bits"], row["s"]) == (64, 0.75)
    with pytest.raises(Exception, match="same length"):
        df.select(K.hamming(F.col("a"), F.lit("ab"))).collect()
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(K.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == 0


def test_files(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    assert readers.hash_files(spark, str(tmp_path)).count() == 2
    assert readers.has_more(spark.range(5), 4) and not readers.has_more(spark.range(4), 4)


def test_rollback(spark):
    log = spark.createDataFrame([("p", i, f"text {i}") for i in range(1, 13)], "key string, seq long, text string")
    history = activity.versions(log, "key", ["seq"])
    assert sorted(r["version"] for r in history.collect()) == list(range(3, 13))
    wanted = spark.createDataFrame([("p", 5)], "key string, target_version long")
    found, missing = activity.rollback(history, wanted, "key", "text", NOW)
    row = found.first()
    assert (row["version"], row["text"]) == (13, "text 5") and missing.count() == 0
    assert activity.rollback(history, spark.createDataFrame([("p", 1)], wanted.schema), "key", "text", NOW)[1].count() == 1


def test_streams_in_batches(spark, tmp_path):
    """Three files, one batch each: late rows, duplicates over batches, upserts, and a repeated run."""
    src = str(tmp_path / "in")
    t = lambda h: datetime(2025, 1, 1) + timedelta(hours=h)
    schema = "id long, ts timestamp, key string, hash string"
    files = [[(1, t(0), "a", "x"), (2, t(5), "b", "y")], [(3, t(1), "a", "x"), (4, t(5.5), "b", "z")], [(5, t(9), "a", "y"), (6, t(8.5), "c", "")]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = lambda: S.read_stream(spark, f"{src}/*", spark.createDataFrame([], schema).schema, files_per_batch=1)
    base = fresh_path(spark, "test-stream")
    for _ in range(2):  # the second run finds nothing new
        S.route_late(stream(), f"{base}/ok", f"{base}/late", Snapshots(spark, f"{base}/marks"), timedelta(hours=1), f"{base}/c1").awaitTermination(300)
    assert [r["id"] for r in spark.read.parquet(f"{base}/late").collect()] == [3]
    assert spark.read.parquet(f"{base}/ok").count() == 5
    store = KeyedTable(spark, f"{base}/store", "key")
    S.upsert_stream(stream(), store, ["ts", "id"], f"{base}/c2").awaitTermination(300)
    assert {r["key"]: r["id"] for r in store.current().collect()} == {"a": 5, "b": 4, "c": 6}
    S.write_stream(S.first_arrivals(stream(), ts="ts"), f"{base}/first", f"{base}/c3").awaitTermination(300)
    assert {r["id"] for r in spark.read.parquet(f"{base}/first").collect()} == {1, 2, 4, 6}


def test_untouched_buckets_keep_their_files(spark):
    table = KeyedTable(spark, fresh_path(spark, "keyed"), "key", buckets=8)
    merge = lambda old, new: new if old is None else old.join(new, "key", "left_anti").unionByName(new)
    rows = lambda keys, v: spark.createDataFrame([(k, v) for k in keys], "key long, v long")
    table.change(rows(range(100), 0), "000", merge)
    files = lambda: {f for f in table.read().inputFiles()}
    before = files()
    for i in range(1, 5):
        table.change(rows([7], i), f"{i:03d}", merge)
    table.change(rows([7], 9), "004", merge)  # a repeated version replaces itself
    assert len(before & files()) >= len(before) * 7 // 8 - 1
    assert {r.key: r.v for r in table.read().collect()} == {**dict.fromkeys(range(100), 0), 7: 9}
    assert max(len(v) for v in table.listing().values()) == 2 and table.read("004").filter("key = 7").first().v == 3


def test_rank_type_and_file_names(spark, tmp_path):
    df = spark.range(30).selectExpr("id % 2 AS g", "id")
    small, large = (curation.ranked(df, ["g"], ["id"], limit=n) for n in (100, 5))
    assert small.dtypes == large.dtypes and sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    (tmp_path / "c.Jpg").write_bytes(b"x")
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path)).collect()] == ["c.Jpg"]
    assert readers.hash_files(spark, str(tmp_path)).count() == 1


def test_first_byline_only_and_tags_in_order(spark):
    text = spark.createDataFrame([("*by Abby Gatsby Jones • *\nhello",)], "t string")
    row = text.select(K.heading_metadata(F.col("t"), F.lit("f"), default_date="none").alias("m")).first().m
    assert (row.author, row.date) == ("Abby Gatsby Jones", "none")
    log = spark.createDataFrame([
        (1, 1, "replace", ["b", "a", "b", " "], None, None, "x"), (1, 2, "add", None, "c", None, None), (1, 3, "remove", None, "a", None, "y"),
        (1, 4, "add", None, "a", None, None), (1, 5, "add", None, "b", None, None), (1, 6, "clear", None, None, None, "z"), (2, 1, "remove", None, "a", None, "y")],
        "photo_id long, seq long, op string, tags array<string>, tag string, text string, source string")
    out = catalog.fold_enhancements(log).collect()
    assert [(r.photo_id, r.accepted_ai_tags, r.suggestion_source) for r in out] == [(1, ["b", "b", "c", "a"], "x")]


def test_missing_times(spark):
    df = spark.createDataFrame([(1, None), (2, datetime(2025, 1, 5)), (3, datetime(2025, 2, 5))], "id long, captured_at timestamp")
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert ids(filters.apply_criteria(df, filters.Criteria(start=datetime(2025, 2, 1)))) == [1, 3]
    assert ids(df.filter(filters.in_date_range(F.col("captured_at"), end=datetime(2025, 1, 5)))) == [2]
    assert ids(filters.apply_criteria(df, filters.Criteria())) == [1, 2, 3]


def test_composite_pairs_of_rows_that_come_twice(spark):
    """No text travels to the pairs, and a repeated id does not multiply the pairs once more."""
    from datetime import datetime
    from keepsake.operators import composite
    rows = [(i, datetime(2025, 1, 1, 0, i), 40.0, -74.0, 1, 2, "roof repair at the north side", ["x"]) for i in range(6)]
    schema = "id long, captured_at timestamp, latitude double, longitude double, project_id long, creator_id long, description string, tags array<string>"
    blocked, _ = composite.composite(spark.createDataFrame(rows, schema))
    assert "description" not in blocked.rows.columns
    met = blocked.candidates(blocked.blocks, blocked.blocks)
    assert blocked.narrow(met).distinct().count() == met.count() == 15 == blocked.edges().count()
    light = blocked.narrow
    blocked.narrow = lambda pairs: light(pairs).union(light(pairs))
    assert blocked.edges().count() == 15


def test_description_similarity_splits_each_text_once(spark):
    df = spark.createDataFrame([(1, "roof repair north", "roof repair south"), (2, None, "roof"), (3, "", "x"), (4, "the one", "the one")], "id long, a string, b string")
    out = df.select("id", K.description_similarity(F.col("a"), F.col("b")).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert [round(r["s"], 6) for r in out.orderBy("id").collect()] == [0.8, 0.0, 0.0, 1.0]
