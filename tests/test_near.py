"""Time, place and composite joins against brute force."""
import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from keepsake.operators import composite, neighbors
from keepsake.plans import cascade

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def km(a, b):
    la, oa, lb, ob = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def temporal(s):
    for limit, score in ((60, .98), (300, .95), (900, .85), (3600, .6), (14400, .3), (86400, .1)):
        if s == 0:
            return 1.0
        if s < limit:
            return score
    return .05


def spatial(a, b):
    if None in a or None in b:
        return 0.0
    if a == b:
        return 1.0
    d = km(a, b)
    for limit, score in ((.01, .98), (.05, .92), (.1, .6), (.5, .4), (1, .2)):
        if d < limit:
            return score
    return 0.0


def photos(n, seed, span, spots):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = rnd.choice(spots)
        if lat is not None:
            lat, lon = lat + rnd.gauss(0, .0004), (lon + rnd.gauss(0, .0004) + 180) % 360 - 180
        out.append((i, T0 + timedelta(microseconds=rnd.randrange(span * 1_000_000)) if rnd.random() < .95 else None,
                    lat, lon, rnd.randrange(3), rnd.randrange(4)))
    return out


SPOTS = [(40.0, -74.0), (0.0, 179.9999), (0.0001, -179.9999), (89.9995, 10.0), (-65.0, 30.0), (None, None)]
SCHEMA = "id long, captured_at timestamp, latitude double, longitude double, project_id long, creator_id long"


@pytest.mark.parametrize("mode", ["strict", "permissive"])
@pytest.mark.parametrize("span", [3_000, 90_000])
def test_candidates(spark, mode, span):
    rows = photos(90, span, span, SPOTS)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] >= b[0]:
                continue
            t = temporal(abs((a[1] - b[1]).total_seconds())) if a[1] and b[1] else 0
            s = spatial(a[2:4], b[2:4])
            if mode == "strict":
                hit = a[4] == b[4] and t > .85 and (s > .9 or t > .95)
            else:
                hit = (a[4] == b[4] and t > .85) or (a[5] == b[5] and t > .7) or s > .9 or t > .95
            if hit:
                want |= {a[0], b[0]}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["id"] for r in neighbors.candidate_rows(df, mode).collect()} == want


@pytest.mark.parametrize("mode", ["strict", "permissive"])
@pytest.mark.parametrize("span", [3_000, 90_000])
def test_candidate_pairs(spark, mode, span):
    rows = photos(90, span, span, SPOTS)
    rows += [(i + 1_000, *r[1:]) for i, r in enumerate(rows[:20])] + [(i + 2_000, *r[1:]) for i, r in enumerate(rows[:20])]
    pairs = 0
    for a in rows:
        for b in rows:
            if a[0] >= b[0]:
                continue
            t = temporal(abs((a[1] - b[1]).total_seconds())) if a[1] and b[1] else 0
            s = spatial(a[2:4], b[2:4])
            if mode == "strict":
                pairs += a[4] == b[4] and t > .85 and (s > .9 or t > .95)
            else:
                pairs += (a[4] == b[4] and t > .85) or (a[5] == b[5] and t > .7) or s > .9 or t > .95
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert [tuple(r) for r in neighbors.candidate_pairs(df, mode).select("total", "compared").collect()] == [(len(rows), pairs)]
    assert [tuple(r) for r in neighbors.candidate_pairs(df.limit(0), mode).collect()] == [(0, 0)]


def test_crowded_minute_is_counted_without_meeting(spark):
    rnd = random.Random(3)
    rows = [(i, T0 + timedelta(microseconds=rnd.randrange(59_000_000)), 40 + rnd.gauss(0, 1e-4), -74 + rnd.gauss(0, 1e-4), 1, i % 7) for i in range(10_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    for mode in ("strict", "permissive"):
        assert tuple(neighbors.candidate_pairs(df, mode).first()) == (10_000, 10_000 * 9_999 // 2)
    nodes = df.withColumn("t", F.unix_micros("captured_at")).withColumn("n", F.lit(1).cast("long")).withColumn(
        "spot", neighbors.Place(0.05).cell(F.col("latitude"), F.col("longitude")))
    assert neighbors.between_cells(nodes, (["project_id"], 300, 0.05), 60).count() < 3_000_000


@pytest.mark.parametrize("scope", [[], ["project_id"]])
def test_pairs_within(spark, scope):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([0, 1, 59_999_999, 60_000_000, 60_000_001, 120_000_000, -1, -60_000_000, None]), rnd.randrange(1, 4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "project_id long, t long, n long").repartition(3)
    each = [(p, t) for p, t, n in rows for _ in range(n) if t is not None and not (scope and p is None)]
    want = sum(abs(each[i][1] - each[j][1]) < 60_000_000 and (not scope or each[i][0] == each[j][0]) for i in range(len(each)) for j in range(i))
    assert neighbors.pairs_within(df, scope, 60).first()["pairs"] == want


def test_one_busy_cell_is_swept_by_all_tasks(spark):
    rows = [(i, T0 + timedelta(microseconds=(i * 7919) % 20_000_000)) for i in range(8_000)]
    df = spark.createDataFrame(rows, "id long, captured_at timestamp").repartition(4)
    instants = df.select(F.unix_micros("captured_at").alias("_t"))
    own = neighbors.in_ranges(instants, 4, 8).filter("own").groupBy("range").count().collect()
    assert len(own) == 8 and max(r["count"] for r in own) < 3 * 8_000 / 8
    order = [i for i, _ in sorted(rows, key=lambda r: r[1])]
    place = {i: p for p, i in enumerate(order)}
    when = dict(rows)
    for r in neighbors.nearest_in_time(df, ranges=8).collect():
        p = place[r["id"]]
        close = [order[q] for q in range(max(0, p - 4), min(len(order), p + 5)) if q != p]
        assert [n["id"] for n in r["near"]] == sorted(close, key=lambda i: (abs(when[i] - when[r["id"]]), i))[:4]


@pytest.mark.parametrize("ranges", [None, 3, 50])
def test_nearest_in_time_in_a_crowd(spark, ranges):
    rnd = random.Random(1)
    rows = [(i, T0 + timedelta(seconds=rnd.choice([0, 0, 0, 1, 2.5, 29, 30, 31, 59, 61, 95]))) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, captured_at timestamp").repartition(4)
    got = {r["id"]: [n["id"] for n in r["near"]] for r in neighbors.nearest_in_time(df, ranges=ranges).collect()}
    for i, t in rows:
        near = sorted((abs((u - t).total_seconds()), j) for j, u in rows if j != i and abs((u - t).total_seconds()) < 30)
        assert got[i] == [j for _, j in near[:4]]


@pytest.mark.parametrize("gap", [30, 40_000])
def test_gap_sessions(spark, gap):
    rnd = random.Random(gap)
    times = sorted(T0 + timedelta(seconds=rnd.randrange(60) + rnd.choice([0, 86_300, 86_390, 172_800, 300_000])) for _ in range(60))
    times += [times[-1] + timedelta(seconds=gap * k) for k in (1, 2, 3)] + [times[-1] + timedelta(seconds=gap * 4, microseconds=1)]
    start, want, last = None, {}, None
    for i, t in sorted(enumerate(times), key=lambda x: x[1]):
        if last is None or (t - last).total_seconds() > gap:
            start = t
        want[i], last = start, t
    df = spark.createDataFrame(list(enumerate(times)), "id long, captured_at timestamp").repartition(3)
    got = {r["id"]: r["session_start"] for r in neighbors.gap_sessions(df, gap).collect()}
    assert got == {i: int(round((s - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))) for i, s in want.items()}


DOMAIN = {"roof", "repair", "siding"}


def overall(a, b):
    ta, tb = a["toks"], b["toks"]
    t = temporal(abs((a["t"] - b["t"]).total_seconds())) if a["t"] and b["t"] else 0.0
    s = spatial(a["at"], b["at"])
    c = .6 * (a["project"] == b["project"]) + .4 * (.8 if a["creator"] == b["creator"] else .3)
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    m = .7 * jac(a["tags"], b["tags"]) + .3 * jac({w for w in ta if len(w) > 3}, {w for w in tb if len(w) > 3})
    if a["text"] and b["text"]:
        da, db = ta & DOMAIN, tb & DOMAIN
        v = min(1.0, jac(ta, tb) + (.3 * len(da & db) / max(len(da), len(db)) if da & db else 0))
    else:
        v = .4 * t + .6 * s
    return .7 * v + .2 * t + .1 * c if t > .95 and c > .8 else .4 * v + .2 * c + .15 * t + .15 * s + .1 * m


@pytest.mark.parametrize("seed", [1, 2])
def test_composite_is_lossless(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(25)] + sorted(DOMAIN)
    recs = []
    for i in range(70):
        words = rnd.sample(vocabulary, rnd.randint(2, 9))
        if recs and rnd.random() < .4:
            words = [w for w in rnd.choice(recs)["text"].split(" ") if w and rnd.random() > .2] + words[:1]
        text = " ".join(words) if rnd.random() < .8 else rnd.choice(["", None])
        p = photos(1, seed * 1000 + i, rnd.choice([100, 20_000, 400_000]), SPOTS)[0]
        recs.append({"id": i, "t": p[1], "at": p[2:4], "project": p[4], "creator": p[5], "text": text or "", "raw": text,
                     "toks": set((text or "").split()), "tags": set(rnd.sample(["a", "b", "c"], rnd.randint(0, 2)))})
    recs.append({**recs[3], "id": 70})
    want = {(a["id"], b["id"]) for a in recs for b in recs if a["id"] < b["id"] and overall(a, b) >= .4 + 1e-12}
    df = spark.createDataFrame([(r["id"], r["t"], r["at"][0], r["at"][1], r["project"], r["creator"], r["raw"], sorted(r["tags"])) for r in recs],
                               SCHEMA + ", description string, tags array<string>")
    got = {(r["id_a"], r["id_b"]) for r in composite.composite_pairs(df).collect()}
    same = {r["id"] for r in recs if r["id"] == 70}
    # the copy is represented by its first row
    assert {p for p in want if not set(p) & same} - got == set()
    assert got - want == set()
    members, _ = composite.composite_groups(df)
    peeled, _ = composite.composite_groups(df, pairs_listed=0, pairs_per_row=0)
    leader = {}
    for a in recs:
        if a["id"] not in leader:
            leader[a["id"]] = a["id"]
            for b in recs:
                if b["id"] > a["id"] and b["id"] not in leader and overall(a, b) >= .4 + 1e-12:
                    leader[b["id"]] = a["id"]
    shared = {v for k, v in leader.items() if k != v}
    expected = {(k, v) for k, v in leader.items() if v in shared}
    assert {(r["member_id"], r["group_id"]) for r in members.collect()} == expected
    assert {(r["member_id"], r["group_id"]) for r in peeled.collect()} == expected


def test_threshold_below_the_proof_is_refused(spark):
    df = spark.createDataFrame([], SCHEMA + ", description string, tags array<string>")
    with pytest.raises(ValueError):
        composite.composite_pairs(df, 0.3)


def _cascade_rows(spark, hashes=("a", "b"), features=([1.0, 0.0], [0.999, 0.01])):
    rows = [(i, f"c{i}", h * 16, list(v), 1, 1, T0 + timedelta(seconds=i), 40.0, -74.0, "roof repair done") for i, (h, v) in enumerate(zip(hashes, features))]
    return spark.createDataFrame(rows, "id long, content_hash string, hash string, features array<double>, project_id long, creator_id long, "
                                       "captured_at timestamp, latitude double, longitude double, description string")


def test_cascade_layers(spark):
    df = _cascade_rows(spark)
    assert {r["layer"] for r in cascade.analyse(df).members.collect()} == {"vector"}
    off = cascade.analyse(df, cascade.Layers(vectors=False))
    assert off.members.count() == 0 and "vectors off" in {r["layer"] for r in off.metrics.collect()}
    far = _cascade_rows(spark, features=([1.0, 0.0], [0.0, 1.0]))
    assert {r["layer"] for r in cascade.analyse(far).members.collect()} == {"text"}
    with pytest.raises(ValueError, match="at least 2"):
        cascade.analyse(df.limit(1))
    with pytest.raises(ValueError, match="at least 2"):
        cascade.analyse(df.filter(F.lit(False)))


def test_copies_for_neighbouring_cells_add_up(spark):
    rows = [(i, T0 + timedelta(seconds=40 * i), 40 + i * 1e-3, -74.0, 1, i) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = df.withColumn("t", F.unix_micros("captured_at")).withColumn("n", F.lit(1).cast("long")).withColumn(
        "spot", neighbors.Place(0.05).cell(F.col("latitude"), F.col("longitude")))
    plan = neighbors.between_cells(nodes, (["project_id"], 300, 0.05), 60)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(line.count("explode(") for line in plan.splitlines() if "explode(" in line) == [1, 1]
    left, right = plan.split("Generate explode(")[1:]
    assert "tc#" in left.splitlines()[0] and "tc#" not in right.splitlines()[0]  # times on one side, places on the other
    swept = neighbors.pairs_within(nodes, ["project_id"], 60)._jdf.queryExecution().executedPlan().toString()
    assert swept.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1  # rows travel once
    for mode in ("strict", "permissive"):
        assert "BroadcastHashJoin" not in neighbors.candidate_rows(df, mode)._jdf.queryExecution().executedPlan().toString()
