"""Written indexes over a table: pages that read one range of the order, and postings of tags.

Both are plain Parquet folders, written once by Spark and read with filters that prune folders and row
groups. They hold the rows as they were when written; build them again after changes.
"""
from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Ranges of a page index. Its counts, one row a range, are the only thing the driver reads.
RANGES, MOST_RANGES = 256, 65_536
#: Folders of a tag index. A search reads those of its tags; a hot tag has many files in its folder.
FOLDERS = 64


# --- pages ----------------------------------------------------------------------------------------

def write_pages(df: DataFrame, path: str, ts: str, id_col: str = "id", ranges: int = RANGES) -> None:
    """Write ``df`` in newest-first order, dealt to ``ranges`` ranges of it, and how many rows each has.

    The order is that of ``readers.page``: ``ts`` descending, nulls last, then the id. Rows with the same
    time and id are in one range, and have no order among themselves. An empty table has no pages.
    """
    if "page_range" in df.columns:
        raise ValueError("page_range is the index's own column")
    if not 0 < ranges <= MOST_RANGES:
        raise ValueError(f"1 to {MOST_RANGES} ranges")
    dealt = df.repartitionByRange(ranges, F.desc(ts), F.asc(id_col)).withColumn("page_range", F.spark_partition_id())
    dealt.sortWithinPartitions("page_range", F.desc(ts), F.asc(id_col)).write.partitionBy("page_range").parquet(f"{path}/rows")
    spark = df.sparkSession
    df.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    written = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    written.groupBy("page_range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, number: int, size: int, ts: str, id_col: str = "id") -> DataFrame:
    """Page ``number`` (from 1): only the ranges that hold its rows are read, however deep it lies.
    Pages behind the end are empty."""
    if number < 1 or size < 1:
        raise ValueError("pages and sizes count from 1")
    counts = sorted((r["page_range"], r["n"]) for r in spark.read.schema("page_range int, n long").parquet(f"{path}/counts").collect())
    ends = list(accumulate(n for _, n in counts))
    first = (number - 1) * size
    low, high = bisect_right(ends, first), bisect_right(ends, first + size - 1)
    wanted = [r for r, _ in counts[low:high + 1]]
    skipped = first - (ends[low - 1] if low else 0)
    columns = spark.read.parquet(f"{path}/columns").schema
    rows = spark.read.schema(columns.add("page_range", "integer")).parquet(f"{path}/rows")
    return rows.filter(F.col("page_range").isin(wanted) if wanted else F.lit(False)).drop("page_range").orderBy(
        F.desc(ts), F.asc(id_col)).offset(skipped).limit(size)


# --- tags -----------------------------------------------------------------------------------------

def _folder(tag: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(folders)).cast("int")


def write_tags(df: DataFrame, path: str, tags: str = "tags", id_col: str = "id", any_case: bool = False,
               files: int = FOLDERS, folders: int = FOLDERS) -> None:
    """Write the postings ``tag, id`` of an array column, each pair once, ordered by tag.

    With ``any_case`` tags are lower-cased. Rows go to files by ranges of folder, tag and id, so a tag that
    most rows have is spread over many files. Null tags, null arrays and null ids have no postings.
    """
    tag = F.lower("tag") if any_case else F.col("tag")
    pairs = df.select(F.explode(F.array_distinct(tags)).alias("tag"), F.col(id_col).alias("id")).select(tag.alias("tag"), "id").filter(
        "tag IS NOT NULL AND id IS NOT NULL").distinct()
    placed = pairs.withColumn("folder", _folder(F.col("tag"), folders))
    placed.repartitionByRange(files, "folder", "tag", "id").sortWithinPartitions("folder", "tag", "id").write.partitionBy(
        "folder").parquet(f"{path}/postings")
    form = df.sparkSession.range(1).select(F.lit(any_case).alias("any_case"), F.lit(folders).alias("folders"),
                                           F.lit(None).cast(df.schema[id_col].dataType).alias("id"))
    form.coalesce(1).write.parquet(f"{path}/form")


def tagged_ids(spark: SparkSession, path: str, wanted, logic: str = "AND") -> DataFrame:
    """``id`` of the rows with all (``AND``) or any (``OR``) of the tags, from their postings only."""
    if logic not in ("AND", "OR"):
        raise ValueError(f"unknown tag logic: {logic}")
    kept = spark.read.parquet(f"{path}/form")
    form, columns = kept.first(), kept.select(F.lit("").alias("tag"), "id", F.lit(0).alias("folder")).schema
    own = sorted({w.lower() if form["any_case"] else w for w in wanted})
    if not own:
        raise ValueError("a search by postings needs a tag")
    folders = [_folder(F.lit(w), form["folders"]) for w in own]  # constants: Catalyst prunes the folders by them
    postings = spark.read.schema(columns).parquet(f"{path}/postings")
    hits = postings.filter(F.col("folder").isin(folders) & F.col("tag").isin(own))
    if logic == "OR" or len(own) == 1:
        return hits.select("id").distinct()
    return hits.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(own)).select("id")


def tagged(df: DataFrame, path: str, wanted, logic: str = "AND", id_col: str = "id") -> DataFrame:
    """The rows of ``df`` that :func:`tagged_ids` names."""
    found = tagged_ids(df.sparkSession, path, wanted, logic).withColumnRenamed("id", "_found")
    return df.join(found, df[id_col] == found["_found"], "left_semi")
