"""Nearest places by a quadtree, against all pairs."""

import random

import pytest

from fjordlake.operators import nearest as N


def spread(rng, kind, n):
    if kind == "even":
        return [(rng.uniform(54, 60), rng.uniform(10, 17)) for _ in range(n)]
    if kind == "clusters":
        return [(55 + rng.choice((0, 3)) + rng.gauss(0, 1e-4), 11 + rng.choice((0, 5)) + rng.gauss(0, 1e-4)) for _ in range(n)]
    if kind == "line":
        return [(55.0, 10 + k / n) for k in range(n)]
    return [(56.0, 12.0)] * n


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "one"])
def test_nearest_is_that_of_all_pairs(spark, kind):
    rng = random.Random(kind)
    rows = [(lat, lon, float(i), i) for i, (lat, lon) in enumerate(spread(rng, kind, 300))]
    rows += [(lat, lon, v + 1000, i + 1000) for lat, lon, v, i in rows[:100]] + [(None, 1.0, 5.0, -1)]  # later values of the same places
    places = [(k, rng.uniform(50, 64), rng.uniform(5, 22)) for k in range(60)] + [(100 + k, *rows[k][:2]) for k in range(20)]
    near = lambda p: min(((r[1] - p[2]) * (r[1] - p[2]) + (r[0] - p[1]) * (r[0] - p[1]), r[3], r[2]) for r in rows if r[0] is not None)
    frame = spark.createDataFrame(rows, "lat double, lon double, value double, seq int")
    asked = spark.createDataFrame(places, "id int, lat double, lon double")
    found = N.nearest(asked, frame, "id", "value", "seq", most=4)
    assert {r.id: (r.dist2, r.value) for r in found.collect()} == {p[0]: (near(p)[0], near(p)[2]) for p in places}


def test_groups_have_their_own_rows(spark):
    rng = random.Random(9)
    rows = [(g, rng.uniform(54, 60), rng.uniform(10, 17), float(i), i) for i in range(200) for g in [rng.choice("abc")]]
    places = [(g, k, rng.uniform(54, 60), rng.uniform(10, 17)) for k in range(20) for g in "abcd"]
    frame = spark.createDataFrame(rows, "g string, lat double, lon double, value double, seq int")
    asked = spark.createDataFrame(places, "g string, id int, lat double, lon double")
    found = {(r.g, r.id): r.value for r in N.nearest(asked, frame, "id", "value", "seq", ["g"], most=4).collect()}
    want = {(g, k): min((r for r in rows if r[0] == g), key=lambda r: ((r[2] - y) ** 2 + (r[1] - x) ** 2, r[4]))[3] for g, k, x, y in places if g != "d"}
    assert found == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "lat double, lon double, value double, seq int")
    assert N.nearest(spark.createDataFrame([(1, 1.0, 1.0)], "id int, lat double, lon double"), empty, "id", "value", "seq").count() == 0
