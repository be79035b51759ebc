"""Joins and groups by nearness in time and place, without listing all pairs of a crowded place.

Two devices keep the work linear in the rows, however crowded a minute, a project or a spot is:

* *cells*: cells are so small that any two rows in one are near enough by construction, so a cell with
  two rows settles all its rows at once; only lone rows look at the neighbouring cells;
* *distinct times*: rows of one instant are summarised before neighbours are taken.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, pi

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import EARTH_RADIUS_KM, haversine_km
from ..functions.numbers import micros
from ..session import materialize

KM_PER_DEGREE = EARTH_RADIUS_KM * pi / 180
SECOND = 1_000_000
SWEEP = 8  # width of the cells of a sweep, in limits


def time_cell(t: Column, seconds: float) -> Column:
    return F.floor(t / F.lit(float(seconds * SECOND))).cast("bigint")


# --- candidate rows (time, place, project, creator) ----------------------------------------------

class Place:
    """Cells of latitude bands and longitude steps, ``side`` limits of ``km`` wide.

    With the default side the diagonal is below ``km``, so any two rows of a cell are within it.
    """

    def __init__(self, km: float, side: float = 0.68):
        self.km, self.width_km = km, side * km
        self.dy = self.width_km / KM_PER_DEGREE
        # degrees of latitude within reach
        self.reach_y = 1.01 * km / KM_PER_DEGREE

    def band(self, lat: Column) -> Column:
        return F.floor(lat / F.lit(self.dy)).cast("bigint")

    def step(self, band: Column) -> Column:
        """Longitude step of a band: at its edge nearest the equator a step is one cell wide."""
        edge = F.when(band >= 0, band * F.lit(self.dy)).otherwise((band + 1) * F.lit(-self.dy))
        width = F.lit(KM_PER_DEGREE) * F.cos(F.radians(F.least(edge, F.lit(90.0))))
        return F.when(width * 360.0 <= self.width_km, F.lit(360.0)).otherwise(F.lit(self.width_km) / width)

    def column(self, lon: Column, band: Column) -> Column:
        return F.floor((lon + 180.0) / self.step(band)).cast("bigint")

    def cell(self, lat: Column, lon: Column) -> Column:
        band = self.band(lat)
        return F.struct(band.alias("band"), self.column(lon, band).alias("col"))

    def around(self, lat: Column, lon: Column) -> Column:
        """Array of the cells within reach, across the date line too."""
        far = F.least(F.abs(lat) + F.lit(self.reach_y), F.lit(90.0))
        width = F.lit(KM_PER_DEGREE) * F.cos(F.radians(far))
        # near a pole every longitude may be in reach
        reach_x = F.when(width * 180.0 <= self.km * 1.01, F.lit(360.0)).otherwise(F.lit(self.km * 1.01) / width)

        def cells(band):
            spans = []
            for turn in (-360.0, 0.0, 360.0):
                low = F.greatest(lon + turn - reach_x, F.lit(-180.0))
                high = F.least(lon + turn + reach_x, F.lit(180.0))
                spans.append(F.when(low <= high, F.sequence(self.column(low, band), self.column(high, band)))
                             .otherwise(F.array().cast("array<bigint>")))
            cols = F.array_distinct(F.concat(*spans))
            return F.transform(cols, lambda c: F.struct(band.alias("band"), c.alias("col")))

        bands = F.sequence(self.band(lat - self.reach_y), self.band(lat + self.reach_y))
        return F.flatten(F.transform(bands, cells))


def _paired(rows: DataFrame, scope: list[str], seconds: float | None, km: float | None) -> DataFrame:
    """Ids of rows that have another row of the same scope within ``seconds`` (strictly) and ``km``."""
    place = Place(km) if km else None
    keys = list(scope)
    df = rows
    if seconds:
        df = df.filter(F.col("t").isNotNull()).withColumn("tc", time_cell(F.col("t"), seconds))
        keys.append("tc")
    if km:
        df = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        df = df.withColumn("band", place.band(F.col("latitude")))
        df = df.withColumn("col", place.column(F.col("longitude"), F.col("band")))
        keys += ["band", "col"]
    for c in scope:
        df = df.filter(F.col(c).isNotNull())
    # one partial aggregate finds crowded cells; a lone cell carries its only row along
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"), F.first("t").alias("t"),
                                  F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"))
    # written first: a join back to an aggregate of its own stage is not split when a cell is hot
    cells = materialize(cells, "cells")
    # cells are nearly as many as rows, however small their file: merged, not broadcast
    crowded = df.join(cells.filter(F.col("n") > 1).select(*keys).hint("merge"), keys, "left_semi").select("id")
    lone = cells.filter(F.col("n") == 1)
    look = lone.select(*scope, F.col("id").alias("x_id"), F.col("t").alias("x_t"),
                       F.col("latitude").alias("x_lat"), F.col("longitude").alias("x_lon"), *(["tc"] if seconds else []))
    # cells of place are looked at by one side and cells of time by the other, so that copies add up, not multiply
    if seconds:
        df = df.withColumn("tc", F.explode(F.sequence(F.col("tc") - 1, F.col("tc") + 1)))
    if km:
        look = look.withColumn("_c", F.explode(place.around(F.col("x_lat"), F.col("x_lon")))).select(
            "*", F.col("_c.band").alias("band"), F.col("_c.col").alias("col")).drop("_c")
    near = F.col("id") != F.col("x_id")
    if seconds:
        near = near & (F.abs(F.col("t") - F.col("x_t")) < int(seconds * SECOND))
    if km:
        near = near & (((F.col("latitude") == F.col("x_lat")) & (F.col("longitude") == F.col("x_lon")))
                       | (haversine_km(F.col("latitude"), F.col("longitude"), F.col("x_lat"), F.col("x_lon")) < km))
    met = df.join(look.hint("merge"), keys).filter(near).select(F.col("x_id").alias("id"))
    return crowded.union(met)


def _rules(mode: str) -> list[tuple[list[str], float | None, float | None]]:
    """Columns that must be equal, seconds and kilometres of each rule of :func:`candidate_rows`."""
    if mode == "strict":
        return [(["project_id"], 60, None), (["project_id"], 300, 0.05)]
    if mode == "permissive":
        return [(["project_id"], 300, None), (["creator_id"], 900, None), ([], None, 0.05), ([], 60, None)]
    raise ValueError(f"unknown candidate mode: {mode}")


def candidate_rows(df: DataFrame, mode: str = "strict", id_col="id", captured="captured_at") -> DataFrame:
    """Rows that have a likely duplicate by metadata alone: time, place, project, creator.

    ``strict``: same project, and within 1 minute, or within 5 minutes and 50 m. ``permissive``: same
    project within 5 minutes; same creator within 15 minutes; within 50 m; or within 1 minute.
    """
    rows = df.select(F.col(id_col).alias("id"), "project_id", "creator_id", "latitude", "longitude",
                     micros(F.col(captured)).alias("t"))
    rules = _rules(mode)
    hits = _paired(rows, *rules[0])
    for rule in rules[1:]:
        hits = hits.union(_paired(rows, *rule))
    return df.join(hits.select(F.col("id").alias(id_col)).hint("merge"), id_col, "left_semi")


def _known(columns) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns], F.lit(True))


def pairs_within(nodes: DataFrame, scope: list[str], seconds: float | None) -> DataFrame:
    """One row ``pairs``: pairs of rows of one scope, strictly within ``seconds`` if given, counted without meeting.

    ``nodes`` have a time ``t`` and a number of rows ``n``. In time order a row enters at its time and leaves
    ``seconds`` later; a running sum of entries and departures is the number of earlier rows in reach. The sum runs
    in cells ``SWEEP`` times as wide, each with the rows of the cell before that have not left, so it is linear in
    the instants. Rows travel to their cells once; events are made there.
    """
    known = nodes.filter(_known([*scope, *(["t"] if seconds else [])]))
    alone = lambda m: F.shiftright(m * (m - 1), 1)
    if not seconds:
        counted = known.groupBy(*scope).agg(F.sum("n").alias("m")).select(alone(F.col("m")).alias("pairs"))
        return counted.agg(F.sum("pairs").alias("pairs"))
    width = int(seconds * SECOND)
    cell = lambda at: time_cell(at, SWEEP * seconds)
    t, m, none = F.col("t"), F.col("m"), F.lit(0).cast("bigint")
    placed = known.select(*scope, "t", "n", F.explode(F.array_distinct(F.array(cell(t), cell(t + width)))).alias("tc"))
    instants = placed.repartition(*scope, "tc").groupBy(*scope, "tc", "t").agg(F.sum("n").alias("m"))

    def event(at, enters, change, asks):
        return F.struct(at.alias("at"), F.lit(enters).alias("enters"), change.alias("change"), asks.alias("asks"))

    # a row of the cell before asks nothing here
    events = instants.select(*scope, "tc", F.explode(F.array(
        event(t, 1, m, F.when(cell(t) == F.col("tc"), m).otherwise(none)), event(t + width, 0, -m, none))).alias("e")).select(*scope, "tc", "e.*")
    # departures first: rows exactly ``seconds`` apart are no pair
    earlier = Window.partitionBy(*scope, "tc").orderBy("at", "enters").rowsBetween(Window.unboundedPreceding, -1)
    met = events.withColumn("earlier", F.coalesce(F.sum("change").over(earlier), none)).filter("asks > 0")
    return met.agg(F.sum(F.col("asks") * F.col("earlier") + alone(F.col("asks"))).alias("pairs"))


def pairs_of_any(nodes: DataFrame, rules: list[tuple[list[str], float]], scope: list[str]) -> list[DataFrame]:
    """Counts whose sum is the number of pairs of one ``scope`` that at least one rule of time accepts.

    Two rules together are again a rule, of both scopes and the shorter time, so the pairs are counted by
    inclusion and exclusion, each term by a sweep.
    """
    counts = []
    for many in range(1, len(rules) + 1):
        for some in combinations(rules, many):
            columns = list(dict.fromkeys([*scope, *[c for own, _ in some for c in own]]))
            found = pairs_within(nodes, columns, min(seconds for _, seconds in some))
            counts.append(found if many % 2 else found.select((-F.col("pairs")).alias("pairs")))
    return counts


def between_cells(nodes: DataFrame, rule: tuple[list[str], float | None, float], settled: float | None) -> DataFrame:
    """Pairs of nodes ``a_*, b_*`` of different place cells that may meet the rule; nodes have their place in ``spot``.

    Pairs closer in time than ``settled`` seconds are counted elsewhere. With cells of half that time they are at
    most a cell or two apart, so those in the same or the next cell need not meet.
    """
    scope, seconds, km = rule
    place = Place(km)
    code = lambda c: F.shiftleft(c["band"], 32) + c["col"]
    nodes = nodes.withColumn("spot", code(F.col("spot")))
    # cells look for each other once, not each of their rows, and only rows of cells that found one travel
    cells = materialize(nodes.select(*scope, "spot").distinct(), "cells")
    looks = nodes.select(*scope, F.col("spot").alias("own"), F.explode(place.around(F.col("latitude"), F.col("longitude"))).alias("c"))
    looks = looks.select(*scope, "own", code(F.col("c")).alias("spot")).filter(F.col("own") != F.col("spot")).distinct()
    # some twenty cells at most are in reach of one
    beside = materialize(looks.join(cells, [*scope, "spot"]).groupBy(*scope, "own").agg(F.collect_set("spot").alias("spots")), "beside")
    seen = materialize(beside.select(*scope, F.explode("spots").alias("spot")).distinct(), "seen")
    left, right = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns]) for side in "ab")
    for c in scope:
        left, right = left.withColumn(c, F.col(f"a_{c}")), right.withColumn(c, F.col(f"b_{c}"))
    keys = [*scope, "spot"]
    left = left.withColumn("spot", F.col("a_spot")).join(seen, keys, "left_semi")
    right = right.withColumn("own", F.col("b_spot")).join(beside, [*scope, "own"]).withColumn("spot", F.explode("spots")).drop("own", "spots")
    apart = F.col("a_spot") != F.col("b_spot")
    if seconds and settled:
        width = settled / 2
        home = time_cell(F.col("a_t"), width)
        # times on this side and places on the other, so that copies add up, not multiply
        left = left.withColumn("tc", F.explode(F.sequence(home + 2, home + ceil(seconds / width))))
        right = right.withColumn("tc", time_cell(F.col("b_t"), width))
        return left.join(right, [*keys, "tc"]).filter(apart)
    if seconds:
        home = time_cell(F.col("a_t"), seconds)
        left = left.withColumn("tc", F.explode(F.sequence(home - 1, home + 1)))
        right = right.withColumn("tc", time_cell(F.col("b_t"), seconds))
        keys.append("tc")
    return left.join(right, keys).filter(apart & (F.col("a_id") < F.col("b_id")))


def candidate_pairs(df: DataFrame, mode: str = "strict", id_col="id", captured="captured_at") -> DataFrame:
    """One row ``total, compared``: the rows, and the pairs of them that :func:`candidate_rows` goes by.

    Pairs by time alone are counted by sweeps (:func:`pairs_of_any`), and so are the pairs of one place cell, all
    near by construction, less those that time has settled. Only rows of different, neighbouring place cells
    are put together, and of them only pairs that time has not settled are tested where the rule has a time.
    Rows of equal metadata are one node with a number.
    """
    own = ["project_id", "creator_id", "latitude", "longitude", "t"]
    rows = df.select(F.col(id_col).alias("id"), *own[:4], micros(F.col(captured)).alias("t"))
    nodes = materialize(rows.groupBy(*own).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "metadata")
    rules = _rules(mode)
    by_time = [(scope, seconds) for scope, seconds, km in rules if not km]
    # each count is written by itself, so that the files of one sweep go before the next begins
    alone = lambda found: materialize(found, "count")
    counts = [alone(found) for found in pairs_of_any(nodes, by_time, [])]
    a, b = lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")

    def close(scope, seconds) -> Column:
        tests = [a(c) == b(c) for c in scope]
        if seconds:
            tests.append(F.abs(a("t") - b("t")) < int(seconds * SECOND))
        return F.coalesce(reduce(lambda x, y: x & y, tests, F.lit(True)), F.lit(False))

    [(scope, seconds, km)] = [rule for rule in rules if rule[2]]
    placed = nodes.filter(_known([*scope, "latitude", "longitude", *(["t"] if seconds else [])])).withColumn(
        "spot", Place(km).cell(F.col("latitude"), F.col("longitude")))
    counts.append(alone(pairs_within(placed, [*scope, "spot"], seconds)))
    both = [([*scope, *own_scope], min(limit, seconds or limit)) for own_scope, limit in by_time]
    counts += [alone(found.select((-F.col("pairs")).alias("pairs"))) for found in pairs_of_any(placed, both, [*scope, "spot"])]
    settled = max([limit for own_scope, limit in by_time if set(own_scope) <= set(scope)], default=None)
    distance = haversine_km(a("latitude"), a("longitude"), b("latitude"), b("longitude"))
    first = close(scope, seconds) & (distance < km)
    for rule in by_time:
        first = first & ~close(*rule)
    met = between_cells(placed, (scope, seconds, km), settled).filter(first)
    counts.append(alone(met.agg(F.sum(a("n") * b("n")).alias("pairs"))))
    pairs = reduce(DataFrame.unionByName, counts).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("compared"))
    return nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total")).crossJoin(pairs)


# --- nearest neighbours in time ------------------------------------------------------------------

def in_ranges(instants: DataFrame, k: int, ranges: int | None = None) -> DataFrame:
    """``instants`` (distinct ``_t``) plus ``range`` and ``own``: every range of the time order holds its own rows, and
    as strangers at least the ``k`` instants before and after them.

    Ranges are cut by a sample of the rows, so they are alike in size however the rows crowd in time. A cut is an
    instant of the data, so no range but the last can be empty, and the last (first) ``k`` instants of the ``k``
    ranges before (after) hold the nearest ``k``.
    """
    cut = instants.repartitionByRange(*([ranges] if ranges else []), "_t")
    cut = materialize(cut.withColumn("range", F.spark_partition_id()), "ranges")

    def lent(order: Column, step: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("range").orderBy(order))
        to = F.explode(F.sequence(F.col("range") + step, F.col("range") + k * step))
        return cut.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r").withColumn("range", to)

    strangers = lent(F.desc("_t"), 1).unionByName(lent(F.asc("_t"), -1))
    return cut.withColumn("own", F.lit(True)).unionByName(strangers.withColumn("own", F.lit(False)))


def nearest_in_time(df: DataFrame, k: int = 4, seconds: float = 30, id_col="id", captured="captured_at",
                    payload=(), ranges: int | None = None) -> DataFrame:
    """``df`` plus ``near``: the ``k`` other rows nearest in time, strictly within ``seconds``.

    Ties go to the smaller id. ``near`` is an array of ``struct(gap, id, t, payload...)``, nearest first; it is
    empty for rows without a time. Only the ``k + 1`` smallest ids of an instant can be anyone's nearest, and only
    the ``k`` instants before and after a row's own. Instants are swept in ``ranges`` of equal size (as many as
    their volume asks for, if not given), so one busy second is spread over all tasks.
    """
    t = micros(F.col(captured))
    rows = df.withColumn("_t", t)
    item = F.struct(F.col(id_col).alias("id"), F.col("_t").alias("t"), *[F.col(c).alias(c) for c in payload])
    rank = Window.partitionBy("_t").orderBy(id_col)
    instants = (rows.filter(F.col("_t").isNotNull()).withColumn("_r", F.row_number().over(rank))
                .filter(F.col("_r") <= k + 1).groupBy("_t").agg(F.array_sort(F.collect_list(item)).alias("items")))
    limit = int(seconds * SECOND)
    gap = lambda x: F.abs(x["t"] - F.col("_t"))
    around = Window.partitionBy("range").orderBy("_t").rowsBetween(-k, k)
    seen = (in_ranges(instants, k, ranges).withColumn("around", F.flatten(F.collect_list("items").over(around)))
            .filter("own").select("_t", F.filter("around", lambda x: gap(x) < limit).alias("around")))
    ordered = F.array_sort(F.transform("around", lambda x: F.struct(
        gap(x).alias("gap"), x["id"].alias("id"), x["t"].alias("t"), *[x[c].alias(c) for c in payload])))
    # ordered once an instant, not once a row; an id has one place, and one more for every copy of any id
    copies = F.size("around") - F.size(F.array_distinct(F.transform("around", lambda x: x["id"])))
    # written first, so that the rows of a hot instant can be split over tasks
    seen = materialize(seen.select("_t", F.slice(ordered, F.lit(1), k + 1 + copies).alias("around")), "around")
    others = F.filter(F.col("around"), lambda x: x["id"] != F.col(id_col))
    empty = F.array().cast(f"array<struct<{_struct_ddl(df, id_col, payload)}>>")
    return (rows.join(seen, "_t", "left")
            .withColumn("near", F.coalesce(F.slice(others, 1, k), empty)).drop("_t", "around"))


def _struct_ddl(df: DataFrame, id_col: str, payload) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = ["gap:bigint", f"id:{kinds[id_col]}", "t:bigint"] + [f"{c}:{kinds[c]}" for c in payload]
    return ",".join(parts)


def time_decisions(df: DataFrame, id_col="id", captured="captured_at") -> DataFrame:
    """Decision per row from its four nearest rows within 30 s, by a fixed list of rules:

    burst (some within 10 s), duplicate (same spot to 1e-5 degrees, nearest such within 30 s), similar
    (two or more within 60 s), unique. Also confidence, related ids and pattern labels.
    """
    near = nearest_in_time(df, 4, 30, id_col, captured, payload=("latitude", "longitude"))
    x = F.col("near")
    burst = F.filter(x, lambda n: n["gap"] <= 10 * SECOND)
    spot = F.filter(x, lambda n: (F.abs(n["latitude"] - F.col("latitude")) < 1e-5)
                    & (F.abs(n["longitude"] - F.col("longitude")) < 1e-5))
    close = F.filter(x, lambda n: n["gap"] <= 60 * SECOND)
    same_spot = (F.size(spot) > 0) & (F.get(spot, F.lit(0))["gap"] <= 30 * SECOND)
    ids = lambda items: F.transform(items, lambda n: n["id"])
    none_near = F.size(x) == 0

    def pick(burst_v, spot_v, similar_v, alone_v, unique_v):
        return (F.when(none_near, alone_v).when(F.size(burst) > 0, burst_v).when(same_spot, spot_v)
                .when(F.size(close) >= 2, similar_v).otherwise(unique_v))

    def text(*values):
        return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")

    no_ids = F.slice(ids(x), 1, 0)
    lit = F.lit
    return near.select(
        *df.columns,
        pick(lit("burst_shot"), lit("duplicate"), lit("similar"), lit("unique"), lit("unique")).alias("decision"),
        pick(lit(0.8), lit(0.9), lit(0.6), lit(0.9), lit(0.8)).alias("confidence"),
        pick(ids(burst), ids(spot), F.slice(ids(close), 1, 2), no_ids, no_ids).alias("related"),
        pick(text("rapid_sequence", "burst_mode"), text("same_location", "duplicate"),
             text("sequential_shots"), text(), text()).alias("patterns"))


# --- sessions and bursts -------------------------------------------------------------------------

def gap_sessions(df: DataFrame, seconds: float = 30, keys=(), captured="captured_at") -> DataFrame:
    """``df`` plus ``session_start`` (microseconds): a new session starts after a gap above ``seconds``.

    Rows fall into cells as wide as the gap, so no session breaks inside a cell and the cells, not the
    rows, are chained: first inside each day, then day to day.
    """
    keys = list(keys)
    t = micros(F.col(captured))
    width = int(seconds * SECOND)
    cell = time_cell(F.col("_t"), seconds)
    rows = df.withColumn("_t", t).filter(F.col("_t").isNotNull()).withColumn("_cell", cell)
    cells = rows.groupBy(*keys, "_cell").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    cells = cells.withColumn("day", F.floor(F.col("lo") / F.lit(86400 * SECOND)).cast("bigint"))
    in_day = Window.partitionBy(*keys, "day").orderBy("_cell")
    broken = F.col("prev").isNotNull() & (F.col("lo") - F.col("prev") > width)
    inside = cells.withColumn("prev", F.lag("hi").over(in_day)).withColumn("start", F.when(broken, F.col("lo")))
    days = inside.groupBy(*keys, "day").agg(F.min("lo").alias("d_lo"), F.max("hi").alias("d_hi"),
                                            F.max("start").alias("d_last"))
    # one row per day and key: a short table, whatever the number of rows
    by_day = Window.partitionBy(*keys).orderBy("day")
    carry = (days.withColumn("p_hi", F.lag("d_hi").over(by_day))
             .withColumn("fresh", F.col("p_hi").isNull() | (F.col("d_lo") - F.col("p_hi") > width))
             .withColumn("open", F.coalesce("d_last", F.when(F.col("fresh"), F.col("d_lo"))))
             .withColumn("before", F.last("open", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)))
             .select(*keys, "day", F.when(F.col("fresh"), F.col("d_lo")).otherwise(F.col("before")).alias("carried")))
    on = keys + ["day"]
    upto = in_day.rowsBetween(Window.unboundedPreceding, 0)
    named = (inside.withColumn("here", F.max("start").over(upto)).join(carry, on)
             .select(*keys, "_cell", F.coalesce("here", "carried").alias("session_start")))
    # written first, so that the rows of a busy cell can be split over tasks
    return rows.join(materialize(named, "sessions"), keys + ["_cell"]).drop("_t", "_cell")


def time_groups(df: DataFrame, seconds: float = 30, keys=(), captured="captured_at") -> DataFrame:
    """Sessions of more than one row, in long form."""
    rows = gap_sessions(df, seconds, keys, captured)
    keys = list(keys) + ["session_start"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    return rows.join(sizes, keys)


def burst_test(sessions: DataFrame, keys=("session_start",), id_col="id", captured="captured_at",
               spread_seconds: float = 10, degrees: float = 1e-4) -> DataFrame:
    """Per time group: spread, mean interval, same place as its first row, and whether it is a burst."""
    keys = list(keys)
    t = micros(F.col(captured))
    here = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
                  F.struct("latitude", "longitude"))
    # all within d of the first row: enough to know the extremes and the first row itself
    out = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.min(t).alias("lo"), F.max(t).alias("hi"),
        F.min_by(F.struct(here.alias("p")), F.struct(t, F.col(id_col))).alias("first"),
        F.count_if(here.isNull()).alias("unplaced"),
        F.min("latitude").alias("lat0"), F.max("latitude").alias("lat1"),
        F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1"))
    lat, lon = F.col("first.p.latitude"), F.col("first.p.longitude")
    same = ((F.col("unplaced") == 0) & (F.col("lat1") - lat < degrees) & (lat - F.col("lat0") < degrees)
            & (F.col("lon1") - lon < degrees) & (lon - F.col("lon0") < degrees))
    spread = (F.col("hi") - F.col("lo")) / F.lit(float(SECOND))
    return out.select(*keys, "size", spread.alias("spread_s"),
                      F.when(F.col("size") > 1, spread / (F.col("size") - 1)).otherwise(F.lit(0.0)).alias("mean_interval_s"),
                      F.coalesce(same, F.lit(False)).alias("same_place"),
                      ((spread <= spread_seconds) & (F.coalesce(same, F.lit(False)) | lat.isNull())).alias("is_burst"))


def quota_flags(df: DataFrame, key: str, ts: str, limit: int = 30, seconds: float = 60) -> DataFrame:
    """``df`` plus ``recent`` (rows of the key in the trailing window, itself included) and ``over_quota``.

    Counts are kept per distinct instant and looked up within one cell and the one before it.
    """
    width = int(seconds * SECOND)
    rows = df.withColumn("_t", micros(F.col(ts)))
    instants = rows.groupBy(key, "_t").agg(F.count(F.lit(1)).alias("n")).withColumn("home", time_cell(F.col("_t"), seconds))
    halo = instants.withColumn("cell", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    trailing = Window.partitionBy(key, "cell").orderBy("_t").rangeBetween(-(width - 1), 0)
    counted = (halo.withColumn("recent", F.sum("n").over(trailing)).filter(F.col("cell") == F.col("home"))
               .select(key, "_t", "recent"))
    return rows.join(counted, [key, "_t"]).drop("_t").withColumn("over_quota", F.col("recent") > limit)


