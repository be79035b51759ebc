"""Page and tag indexes: the same rows as without them, and only what is needed is read."""
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.session import fresh_path
from keepsake.sources import indexes, readers


def files_read(df):
    """Files that the scans of ``df`` really opened for rows."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.fixture(scope="module")
def photos(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 97 == 0 else start + timedelta(minutes=i // 3), ["all"] + ([None, f"T{i % 50}"] if i % 4 else [f"T{i % 50}", "rare", "rare"]) if i % 11 else None)
            for i in range(3_000)]
    return spark.createDataFrame(rows, "id long, ts timestamp, tags array<string>").repartition(7)


def test_pages(spark, photos):
    path = fresh_path(spark, "test-pages")
    indexes.write_pages(photos, path, "ts", ranges=32)
    for number, size in [(1, 10), (7, 33), (60, 50), (61, 50), (2, 1_900), (150, 20)]:
        want = [r.id for r in readers.page(photos, number, size, "ts").collect()]
        assert [r.id for r in indexes.read_page(spark, path, number, size, "ts").collect()] == want
    deep = indexes.read_page(spark, path, 140, 20, "ts")
    plan = deep._jdf.queryExecution().executedPlan().toString()
    kept = re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan).group(1)
    assert "page_range" in kept
    ranges = set(re.findall(r"\b\d+\b", kept.split("page_range", 1)[1].split("#", 1)[1].split(" ", 1)[1]))
    assert 1 <= len(ranges) <= 2  # twenty rows lie in two of the 32 ranges at most
    with pytest.raises(ValueError):
        indexes.read_page(spark, path, 0, 20, "ts")


def test_pages_of_an_empty_table_and_equal_rows(spark, photos):
    path = fresh_path(spark, "test-pages")
    indexes.write_pages(photos.limit(0), path, "ts")
    assert indexes.read_page(spark, path, 1, 10, "ts").count() == 0
    path, same = fresh_path(spark, "test-pages"), photos.filter("id < 100").withColumn("ts", F.lit(None).cast("timestamp"))
    indexes.write_pages(same.unionByName(same), path, "ts", ranges=8)
    assert [r.id for r in indexes.read_page(spark, path, 3, 10, "ts").collect()] == [i // 2 for i in range(20, 30)]


@pytest.mark.parametrize("any_case", [False, True])
def test_tags(spark, photos, any_case):
    path = fresh_path(spark, "test-tags")
    indexes.write_tags(photos, path, any_case=any_case)
    rows = [(r.id, {(t.lower() if any_case else t) for t in r.tags or [] if t}) for r in photos.collect()]
    for wanted in (["rare"], ["T8", "rare"], ["t8", "rare"], ["all"], ["T3", "T4"], ["none"]):
        own = {w.lower() if any_case else w for w in wanted}
        assert sorted(r.id for r in indexes.tagged(photos, path, wanted).collect()) == sorted(i for i, t in rows if own <= t)
        assert sorted(r.id for r in indexes.tagged_ids(spark, path, wanted, "OR").collect()) == sorted(i for i, t in rows if own & t)
    with pytest.raises(ValueError):
        indexes.tagged_ids(spark, path, [])
    empty = fresh_path(spark, "test-tags")
    indexes.write_tags(photos.limit(0), empty, any_case=any_case)
    assert indexes.tagged(photos, empty, ["rare"]).count() == 0


def test_a_search_reads_its_postings_only(spark, photos):
    path = fresh_path(spark, "test-tags")
    indexes.write_tags(photos, path)
    plan = indexes.tagged_ids(spark, path, ["T8", "rare"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and re.search(r"PushedFilters: \[[^\]]*In\(tag", plan)
    postings = spark.read.parquet(f"{path}/postings")
    # a tag that most rows have is dealt to several files; each tag has one folder
    assert len(files_read(postings.filter("tag = 'all'"))) > 3
    assert postings.groupBy("tag").agg(F.countDistinct("folder").alias("n")).filter("n > 1").count() == 0
