"""Session settings and reliable materialisation."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Join and partition settings every job here is written for. Skewed shuffle joins are split at run
# time even when that adds a shuffle, because one key may hold a third of all rows.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # The shuffle files of a step go when it has ended, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


# Tables are estimated by their files, and the rows of a compressed file take ten times its size and more as a
# hash table on the driver; larger ones are joined by shuffles.
BROADCAST_BYTES = 1 << 20


def configure(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_BYTES:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that functions that run there
    can import it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="keepsake-code-"), "keepsake_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own (tests, laptops).
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="keepsake-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Deletes the tables that :func:`materialize` has written inside, at its end. The value is a function
    that writes a result which shall outlive the scope; it only writes if there is something to delete."""
    written: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        if not written:
            return df
        _scopes.append(kept)
        try:
            return materialize(df, "result")
        finally:
            _scopes.pop()

    _scopes.append(written)
    try:
        yield keep
    finally:
        _scopes.remove(written)
        conf = spark._jsc.hadoopConfiguration()
        for path in written:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that the scope around deletes at its end."""
    path = fresh_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    return path


# Hash codes repeat: their dictionaries are larger than the usual page, and still much smaller than the codes.
WRITTEN = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative jobs, survives the loss of any executor, and gives the next join
    the true size of the table, so that Catalyst broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**WRITTEN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that no later step reads."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and aggregates of the rows taken by the write itself."""
    seen = Observation()
    return materialize(df.observe(seen, *metrics), name), seen.get
