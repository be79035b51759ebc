"""Catalog readers: explicit schemas, filters and columns reach the scan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.filters import has_all

URI = "struct<type:string,uri:string,url:string>"
PHOTO_JSON_DDL = (
    "id string, company_id string, creator_id string, creator_name string, project_id string, "
    "processing_status string, photo_url string, hash string, description string, "
    "captured_at bigint, created_at bigint, updated_at bigint, "
    "coordinates array<struct<latitude:double,longitude:double,altitude:double>>, "
    f"uris array<{URI}>, tags array<struct<id:string,display_value:string,value:string>>, "
    "archive_state string")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def newest_first(df: DataFrame, ts: str, id_col: str = "id", project_id=None, limit: int | None = None,
                 project_col: str = "project_id") -> DataFrame:
    out = df if project_id is None else df.filter(F.col(project_col) == project_id)
    out = out.orderBy(F.desc(ts), id_col)
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, number: int, size: int, ts: str, id_col: str = "id", tag_ids=(),
         tags: str = "tags") -> DataFrame:
    """Page ``number`` (from 1) in newest-first order. Deep scans should use :func:`page_after`."""
    out = df.filter(has_all(F.col(tags), tag_ids)) if tag_ids else df
    return out.orderBy(F.desc(ts), id_col).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_ts, last_id, size: int, ts: str, id_col: str = "id") -> DataFrame:
    """The page that follows the row ``(last_ts, last_id)``: a pushed filter instead of an offset."""
    at = F.lit(last_ts).cast("timestamp")
    after = (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(id_col) > F.lit(last_id)))
    return df.filter(after).orderBy(F.desc(ts), id_col).limit(size)


def has_more(df: DataFrame, size: int) -> bool:
    """More than ``size`` rows exist: fetches one row beyond."""
    return len(df.limit(size + 1).take(size + 1)) > size


def preferred_uri(uris: Column, photo_url: Column) -> Column:
    """Web address, else original, else the plain photo address."""
    def of(kind):
        hit = F.get(F.filter(uris, lambda u: u["type"] == kind), F.lit(0))["uri"]
        return F.nullif(hit, F.lit(""))
    return F.coalesce(of("web"), of("original"), F.nullif(photo_url, F.lit("")))


def photo_columns(doc: Column) -> list[Column]:
    """Canonical flat columns of a nested photo record."""
    first = F.get(doc["coordinates"], F.lit(0))
    return [doc["id"].alias("id"), doc["project_id"].alias("project_id"), doc["creator_id"].alias("creator_id"),
            doc["description"].alias("description"), doc["hash"].alias("hash"),
            preferred_uri(doc["uris"], doc["photo_url"]).alias("web_url"),
            first["latitude"].alias("latitude"), first["longitude"].alias("longitude"),
            F.timestamp_seconds(doc["captured_at"]).alias("captured_at"),
            F.transform(doc["tags"], lambda t: F.coalesce(F.nullif(t["value"], F.lit("")), t["display_value"])).alias("tags"),
            F.coalesce(doc["archive_state"], F.lit("active")).alias("archive_state")]


def parse_photos(df: DataFrame, json_col: str) -> DataFrame:
    return df.select(F.from_json(json_col, PHOTO_JSON_DDL).alias("p")).select(*photo_columns(F.col("p")))


def read_photo_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines photo catalog with the canonical columns."""
    df = spark.read.schema(PHOTO_JSON_DDL).json(path)
    return df.select(F.struct("*").alias("p")).select(*photo_columns(F.col("p")))


def by_extension(df: DataFrame, path_col: str, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    pattern = r"(?i)\.(" + "|".join(extensions) + r")$"
    return df.filter(F.col(path_col).rlike(pattern)).orderBy(path_col)


def list_files(spark: SparkSession, folder: str, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """Names and sizes of the files with one of the extensions; contents are not read."""
    files = by_extension(spark.read.format("binaryFile").load(folder), "path", extensions)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length").orderBy("name")


def hash_files(spark: SparkSession, folder: str, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    files = by_extension(spark.read.format("binaryFile").load(folder), "path", extensions)
    return files.select("path", F.sha2("content", 256).alias("hash"))


def user_records(df: DataFrame, user, user_col: str, ts: str, id_col: str, limit: int | None = None) -> DataFrame:
    return newest_first(df.filter(F.col(user_col) == user), ts, id_col, limit=limit)


def search_tagged(df: DataFrame, wanted, tags: str = "accepted_ai_tags") -> DataFrame:
    """Records whose tag array holds all wanted tags."""
    return df.filter(has_all(F.col(tags), wanted))
