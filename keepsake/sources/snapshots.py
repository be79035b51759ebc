"""Keyed tables as versioned parquet snapshots, and JSON export.

A write goes to a new version folder and becomes current when its Spark commit marker is there, so a
lost executor or a repeated run never leaves a half-written table in use.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return sorted(n for n in names if n.startswith("v=") and fs.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def current(self) -> DataFrame | None:
        have = self.versions()
        return self.spark.read.parquet(f"{self.root}/{have[-1]}") if have else None

    def write(self, df: DataFrame, version: str) -> DataFrame:
        """Write one version; writing the same version again replaces it (idempotent by batch id)."""
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        return self.spark.read.parquet(f"{self.root}/v={version}")

    def before(self, version: str) -> DataFrame | None:
        """The newest version older than ``version``: what a repeated batch must build on."""
        have = [v for v in self.versions() if v < f"v={version}"]
        return self.spark.read.parquet(f"{self.root}/{have[-1]}") if have else None


class KeyedTable:
    """A keyed table in hash buckets of its key, of which a write touches only those that it has rows for.

    A version folder holds the touched buckets in full. The table is, for each bucket, its newest version
    with a commit marker, so a lost executor or a repeated run never leaves a half-written bucket in use.
    Of every bucket the newest two versions stay.
    """

    BUCKET = "_bucket"

    def __init__(self, spark: SparkSession, root: str, keys, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self._snapshots = Snapshots(spark, root)

    def listing(self) -> dict[int, list[str]]:
        """Versions of each bucket, oldest first."""
        fs, path = self._snapshots._fs()
        out: dict[int, list[str]] = {}
        for version in self._snapshots.versions():
            for status in fs.listStatus(path(f"{self.root}/{version}")):
                name = status.getPath().getName()
                if name.startswith(f"{self.BUCKET}="):
                    out.setdefault(int(name.split("=")[1]), []).append(version)
        return out

    def read(self, before: str | None = None, only=None) -> DataFrame | None:
        """The table, or what it was before a version, or some of its buckets."""
        paths = []
        for bucket, versions in self.listing().items():
            have = [v for v in versions if before is None or v < f"v={before}"]
            if have and (only is None or bucket in only):
                paths.append(f"{self.root}/{have[-1]}/{self.BUCKET}={bucket}")
        return self.spark.read.parquet(*paths) if paths else None

    current = read

    def change(self, rows: DataFrame, version: str, merge) -> None:
        """Write ``merge(old rows of the touched buckets or None, rows)`` as a version; writing the same
        version again replaces it. ``rows`` has the keys."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # at most `buckets` rows
        if not touched:
            return
        new = merge(self.read(version, touched), rows)
        (new.withColumn(self.BUCKET, bucket).hint("rebalance", self.BUCKET)
         .write.mode("overwrite").partitionBy(self.BUCKET).parquet(f"{self.root}/v={version}"))
        fs, path = self._snapshots._fs()
        for number, versions in self.listing().items():
            for old in versions[:-2]:
                fs.delete(path(f"{self.root}/{old}/{self.BUCKET}={number}"), True)


def write_aggregates(df: DataFrame, path: str) -> None:
    """Aggregates stored by grain and day of start: a re-run replaces just the partitions it covers."""
    (df.withColumn("start_date", F.to_date("period_start"))
     .hint("rebalance", "grain", "start_date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("grain", "start_date").parquet(path))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read an export back with its schema; timestamps are restored from text."""
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
