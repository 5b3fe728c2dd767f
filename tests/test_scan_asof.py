"""As-of joins and chunked scans against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fjordlake.operators import asof, scan


def walk_changes(rows, largest, least):
    last, out = {}, []
    for k, n, v in sorted(rows):
        if k not in last or least <= abs(v - last[k]) <= largest:
            last[k] = v
            out.append((k, n))
    return out


def walk_throttle(rows, limit):
    out, by = [], {}
    for k, t, n in sorted(rows):
        by.setdefault(k, []).append((t, n))
    for k, events in by.items():
        due = waiting = None
        for now, n in events:
            if due is not None and now >= due:
                if waiting is not None:
                    out.append((k, waiting, due))
                    due, waiting = due + limit, None
                if now >= due:
                    due = None
            if due is None:
                out.append((k, n, now))
                due = now + limit
            else:
                waiting = n
        if waiting is not None:
            out.append((k, waiting, due))
    return sorted(out)


@pytest.mark.parametrize("largest,least", [(0.5, 0.0), (0.1, 0.0), (0.3, 0.05), (0.0, 0.0)])
def test_accepted_changes_in_chunks(spark, largest, least):
    rng = random.Random(4)
    rows = [(k, n, round(rng.random() * rng.choice((1, 1, 2)), 2)) for k, size in ((1, 900), (2, 30), (3, 1)) for n in range(size)]
    frame = spark.createDataFrame(rows, "k int, n int, v double").repartition(4)
    got = scan.accepted_changes(frame, "k", "v", ["n"], largest, least, chunk_bits=4)
    assert sorted((r.k, r.n) for r in got.collect()) == walk_changes(rows, largest, least)


@pytest.mark.parametrize("step", [30, 90, 110, 150, 190, 260])
@pytest.mark.parametrize("bits", [2, 4, 15])
def test_throttle_in_chunks(spark, step, bits):
    rng = random.Random(step)
    rows = []
    for k, size in ((1, 700), (2, 40), (3, 1), (None, 20)):
        t = 0
        for n in range(size):
            t += rng.choice((0, 1, step, step, 2 * step, 100, 200, 199, 101))
            rows.append((k, t, n))
    frame = spark.createDataFrame(rows, "user_id int, t long, event_id int").repartition(4)
    frame = frame.withColumn("ts", F.timestamp_millis(F.col("t")).cast("timestamp_ntz")).drop("t")
    got = scan.throttled(frame, "user_id", 100, chunk_bits=bits).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    want = walk_throttle([(-1 if k is None else k, t, n) for k, t, n in rows], 100)
    assert sorted((-1 if r.user_id is None else r.user_id, r.event_id, r.emitted_ms) for r in got) == want, key


def test_a_hot_key_is_in_many_chunks(spark):
    frame = spark.range(4000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7 / 10.0).alias("v"))
    assert scan.accepted_changes(frame, "k", "v", ["id"], 1.0, chunk_bits=6).count() == 4000
    assert scan.accepted_changes(frame.limit(0), "k", "v", ["id"], 1.0).count() == 0


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_asof_is_that_of_all_pairs(spark, direction):
    rng = random.Random(1)
    known = [(rng.choice(("a", "b", None)), rng.randrange(1000), rng.randrange(99)) for _ in range(60)] + [("a", None, 1)]
    asked = [(rng.choice(("a", "b", None, "c")), rng.randrange(-50, 1100)) for _ in range(300)] + [("a", None)]

    def want(g, t):
        rows = [(x, v) for h, x, v in known if h == g and x is not None] if t is not None else []
        rows = [r for r in rows if direction == "nearest" or (r[0] <= t if direction == "backward" else r[0] >= t)]
        return min(rows, key=lambda r: (abs(r[0] - t), *r)) if rows else (None, None)

    available = spark.createDataFrame(known, "g string, t int, v int").repartition(3)
    targets = spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "g string, t int, i int").repartition(3)
    got = asof.asof_join(targets, available, "t", ["g"], ["v"], direction).collect()
    assert len(got) == len(asked)
    assert {r.i: (r.nearest, r.v) for r in got} == {i: want(*a) for i, a in enumerate(asked)}


def test_asof_over_a_million_hours(spark):
    hours = spark.range(1_000_000).select((F.col("id") * 3).alias("t"))
    targets = spark.range(0, 3_000_000, 1009).select(F.col("id").alias("t"))
    got = asof.nearest_asof(targets, hours, "t")
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    wrong = got.where(F.col("nearest") != F.when(F.col("t") % 3 == 2, F.col("t") + 1).otherwise(F.col("t") - F.col("t") % 3))
    assert got.count() == targets.count() and wrong.where("t < 2999997").count() == 0
    with pytest.raises(ValueError):
        asof.nearest_asof(targets, hours, "t", direction="up")


def test_places_over_all_ranges(spark):
    from fjordlake.operators.ranges import numbered

    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("x"), F.lit("a").alias("y")).repartition(7)
    assert [(r.x, r.place) for r in numbered(rows, "x").orderBy("x").collect()] == [(i, i) for i in range(500)]
    assert numbered(rows.limit(0), "x").count() == 0
