"""Streams of feedback, photos and interactions.

Every stream is declarative: event-time windows and watermarks, partial aggregation, and state that
the watermark bounds. Sinks are parquet (exactly once through the checkpoint) or keyed snapshots that
are idempotent by batch id, so a restarted batch gives the same table.
"""
from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.catalog import latest_per_key
from ..operators.feedback import METRICS, metric_counts
from ..sources.snapshots import KeyedTable, Snapshots

# Windows start at the epoch, a Thursday: three more days make weeks start on Sunday.
GRAIN_WINDOWS = {"hour": ("1 hour", "1 hour", "0 seconds"), "day": ("1 day", "1 day", "0 seconds"),
                 "week": ("7 days", "7 days", "3 days")}


def read_stream(spark: SparkSession, folder: str, schema, name_glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def feedback_windows(stream: DataFrame, grain: str = "hour", keys=("user_type",), ts="ts", delay="1 hour",
                     kind="feedback") -> DataFrame:
    """Feedback counts per tumbling hour, day or Sunday week; append mode gives closed windows."""
    window = F.window(ts, *GRAIN_WINDOWS[grain])
    return (stream.withWatermark(ts, delay).groupBy(window, *keys).agg(*metric_counts(kind))
            .select(*keys, F.lit(grain).alias("grain"), F.col("window.start").alias("period_start"), *METRICS))


def month_rollup(days: DataFrame, keys=("user_type",)) -> DataFrame:
    """Months from daily rows: months have no fixed length, so they are no stream window."""
    return (days.groupBy(*keys, F.date_trunc("month", "period_start").alias("period_start"))
            .agg(*[F.sum(m).alias(m) for m in METRICS]))


def month_counts(stream: DataFrame, keys=("user_type",), ts="ts", kind="feedback") -> DataFrame:
    """Running month counts for update mode; the state is one row per key and month."""
    return stream.groupBy(*keys, F.date_trunc("month", ts).alias("period_start")).agg(*metric_counts(kind))


def closed_months(stream: DataFrame, keys=("user_type",), ts="ts", delay="1 hour", kind="feedback") -> DataFrame:
    """Feedback counts of closed calendar months, in append mode.

    A month is no stream window, so it is keyed state with a timer at its end: four counts for each key and
    open month, given out and released when the watermark passes the end. Tasks count before the shuffle,
    so a hot key sends a row for each Arrow batch and month. Rows older than the watermark are dropped,
    unless they come in one Arrow batch with newer ones of their key and month.
    """
    keys = list(keys)
    types = dict(stream.dtypes)
    month, is_ = F.date_trunc("month", ts), lambda x: (F.coalesce(F.col(kind), F.lit("")) == x).cast("bigint")
    rows = stream.filter(F.col(ts).isNotNull()).select(
        *keys, F.unix_micros(month).alias("start"), F.unix_micros(F.add_months(month, 1).cast("timestamp")).alias("end"), F.unix_micros(ts).alias("newest"),
        is_("positive").alias("positive"), is_("negative").alias("negative"), is_("edit").alias("edits"), F.lit(1).cast("bigint").alias("total"))
    cols = ", ".join(f"{k} {types[k]}" for k in keys) + ", start bigint, end bigint, newest bigint, " + ", ".join(f"{m} bigint" for m in METRICS)

    def count(batches):
        for batch in batches:
            if len(batch):
                by = batch.groupby([*keys, "start", "end"], dropna=False, sort=False)
                yield by.agg({"newest": "max", **{m: "sum" for m in METRICS}}).reset_index()

    counted = rows.mapInPandas(count, cols).withColumn("at", F.timestamp_micros("newest")).withWatermark("at", delay)

    def close(key, batches, state):
        total = list(state.get) if state.exists else [0] * len(METRICS)
        for batch in batches:
            total = [t + int(batch[m].sum()) for t, m in zip(total, METRICS)]
        end = int(key[-1]) // 1000
        if end <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            if total[-1]:
                yield pd.DataFrame([(*key[:-1], *total)], columns=[*keys, "start", *METRICS])
        else:
            state.update(tuple(int(t) for t in total))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    out = ", ".join(f"{k} {types[k]}" for k in keys) + ", start bigint, " + ", ".join(f"{m} bigint" for m in METRICS)
    closed = counted.groupBy(*keys, "start", "end").applyInPandasWithState(
        close, out, ", ".join(f"{m} bigint" for m in METRICS), "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select(*keys, F.timestamp_micros("start").alias("period_start"), *METRICS)


def burst_sessions(stream: DataFrame, gap="30 seconds", keys=("project_id",), ts="captured_at", delay="1 minute") -> DataFrame:
    """Rows of a key with gaps of at most ``gap``; closed sessions of more than one row."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys)
    out = grouped.agg(F.count(F.lit(1)).alias("size"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.filter(F.col("size") > 1).select(*keys, "first", "last", "size")


def joined_stretches(rows: pd.DataFrame, keys: list[str], idle: int) -> pd.DataFrame:
    """Stretches ``(first, last, n, id, context)`` merged where the pause between them is at most ``idle``;
    ``id`` and ``context`` are those of the newest row, of the largest id among rows of one time."""
    rows = rows.astype({"first": "int64", "last": "int64", "n": "int64"})
    rows = rows.sort_values([*keys, "first", "last", "id"], kind="stable").reset_index(drop=True)
    same = pd.Series(True, rows.index)
    for k in keys:
        same &= rows[k].eq(rows[k].shift()) | (rows[k].isna() & rows[k].shift().isna() & (rows.index > 0))
    reached = rows.groupby((~same).cumsum())["last"].cummax().shift()
    number = (~(same & (rows["first"] - reached <= idle))).cumsum()
    rows["stretch"] = number
    out = rows.groupby("stretch").agg({"first": "min", "last": "max", "n": "sum"}).reset_index(drop=True)
    heads = rows.drop_duplicates("stretch")  # a missing key stays missing
    newest = rows.sort_values(["stretch", "last", "id"], kind="stable").drop_duplicates("stretch", keep="last")
    return out.assign(**{k: heads[k].to_numpy() for k in keys}, **{c: newest[c].to_numpy() for c in ("id", "context")})


def open_stretches(rows, idle: int, whole: bool = True) -> list[tuple]:
    """The same for the stretches ``(first, last, n, id, context)`` of one key, in plain Python: a data frame for
    each key costs far more than its rows. ``whole``: ids are whole numbers, also where a missing one made them floats."""
    def named(x):
        return None if x is None or x != x else int(x) if whole else x

    given = [(int(first), int(last), int(n), named(id_), context) for first, last, n, id_, context in rows]
    # a missing id is the largest
    given.sort(key=lambda s: (s[0], s[1], s[3] is None, 0 if s[3] is None else s[3]))
    out: list[list] = []
    for first, last, n, id_, context in given:
        if out and first - out[-1][1] <= idle:
            at = out[-1]
            at[2] += n
            # the newest so far is of the time at[1]; of one time the largest id, of one id the later row
            if last > at[1] or last == at[1] and (id_ is None or at[3] is not None and id_ >= at[3]):
                at[1], at[3], at[4] = last, id_, context
        else:
            out.append([first, last, n, id_, context])
    return [tuple(s) for s in out]


def interaction_log(stream: DataFrame, key="session_id", ts="ts", id_col="id", context="context", idle="7 days",
                    delay="1 hour") -> DataFrame:
    """Interactions of each session with the last context; a session is given out, and its state released,
    when the watermark has passed ``idle`` without an interaction.

    Arbitrary state with timers: a key holds its open stretches of interactions (first, last, count, newest
    id and context), so state does not grow with the interactions. Order inside a batch, and late rows
    within ``delay``, make no difference; at one time the largest id is the last. Tasks merge the rows of a
    key before the shuffle, so a hot key sends a row for each Arrow batch. Rows older than the watermark
    are dropped, unless they come in one Arrow batch with newer ones of their stretch.
    """
    pause = int(timedelta(**{_unit(idle): int(idle.split()[0])}).total_seconds()) * 1_000_000
    types = dict(stream.dtypes)
    cols = f"{key} {types[key]}, first bigint, last bigint, n bigint, id {types[id_col]}, context {types[context]}"
    rows = stream.select(key, F.unix_micros(ts).alias("first"), F.unix_micros(ts).alias("last"), F.lit(1).cast("bigint").alias("n"),
                         F.col(id_col).alias("id"), F.col(context).alias("context")).filter(F.col("first").isNotNull())

    def merge(batches):
        for batch in batches:
            if len(batch):
                yield joined_stretches(batch, [key], pause)

    merged = rows.mapInPandas(merge, cols).withColumn("at", F.timestamp_micros("last")).withWatermark("at", delay)
    fields = ["first", "last", "n", "id", "context"]

    whole = types[id_col] in ("tinyint", "smallint", "int", "bigint")

    def log(name, batches, state):
        rows = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            rows += zip(*[batch[f].tolist() for f in fields])
        own, mark = open_stretches(rows, pause, whole), state.getCurrentWatermarkMs()
        open_ = [s for s in own if s[1] + pause > mark * 1000]
        if open_:
            state.update(tuple(list(column) for column in zip(*open_)))
            state.setTimeoutTimestamp(max(-(-(min(s[1] for s in open_) + pause) // 1000), mark + 1))
        elif state.exists:
            state.remove()
        done = [s for s in own if s[1] + pause <= mark * 1000]
        if done:
            yield pd.DataFrame({key: [name[0]] * len(done), "n": [s[2] for s in done], "context": [s[4] for s in done], "last": [s[1] for s in done]})

    held = f"first array<bigint>, last array<bigint>, n array<bigint>, id array<{types[id_col]}>, context array<{types[context]}>"
    out = merged.groupBy(key).applyInPandasWithState(log, f"{key} {types[key]}, n bigint, context {types[context]}, last bigint", held,
                                                     "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.col("n").alias("interactions"), F.col("context").alias("last_context"), F.timestamp_micros("last").alias("last_updated"))


def _unit(interval: str) -> str:
    unit = interval.split()[1].rstrip("s") + "s"
    if unit not in ("seconds", "minutes", "hours", "days", "weeks"):
        raise ValueError(f"not an interval of fixed length: {interval}")
    return unit


def interaction_sessions(stream: DataFrame, key="session_id", ts="ts", context="context", idle="7 days",
                         delay="1 hour", id_col="id") -> DataFrame:
    """The same as a session window, without Python: the state is a count and the newest context. A session
    ends after ``idle`` without any interaction; at one time the largest id is the last."""
    return (stream.withWatermark(ts, delay).groupBy(F.session_window(ts, idle).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("interactions"), F.max_by(context, F.struct(ts, id_col)).alias("last_context"), F.max(ts).alias("last_updated"))
            .select(key, "interactions", "last_context", "last_updated"))


def first_arrivals(stream: DataFrame, key="hash", ts="captured_at", delay="1 day") -> DataFrame:
    """Drops exact duplicates that arrive within the watermark of the first; missing keys pass."""
    marked = stream.withWatermark(ts, delay)
    named = marked.withColumn("_k", F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("id:"), F.col("id").cast("string"))))
    return named.dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Parquet sink that takes all available input and stops."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start())


def upsert_stream(stream: DataFrame, store: KeyedTable, order, checkpoint: str, mode: str = "append"):
    """Keeps the last row per key of a keyed table; a repeated batch rewrites its own version, and a batch
    rewrites only the buckets that it has keys of."""
    order = [order] if isinstance(order, str) else list(order)

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return latest_per_key(batch if old is None else old.unionByName(batch), store.keys, order)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.change(batch, f"{batch_id:012d}", merge)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start())


def route_late(stream: DataFrame, on_time: str, late: str, marks: Snapshots, delay: timedelta, checkpoint: str, ts="ts"):
    """Splits each batch by the watermark of the batches before it: rows older than the newest time
    seen minus ``delay`` go to the ``late`` folder. Each batch writes its own subfolder, so a repeated
    batch replaces its output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        version = f"{batch_id:012d}"
        old = marks.before(version)
        # one row: the newest time of all earlier batches
        seen = None if old is None else old.first()["newest"]
        mark = None if seen is None else F.lit(seen - delay).cast("timestamp")
        is_late = F.lit(False) if mark is None else F.col(ts) < mark
        # the batch is read once for each output; nothing is held in memory
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={version}")
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={version}")
        newest = batch.agg(F.max(ts).alias("newest"))
        both = newest if old is None else newest.unionByName(old.select("newest"))
        marks.write(both.agg(F.max("newest").alias("newest")), version)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
