"""Merging by position and filling of gaps, on small made-up inputs."""

import random

import pytest
from pyspark.sql import functions as F

from fjordlake.operators import merge as P
from fjordlake.operators.dilate import dilate

KIND = f"position int, entries array<{P.ENTRY}>"


def entry(t, current=None, values=None):
    import datetime

    return (datetime.datetime(2024, 1, 1, t), current, values)


def merged(spark, base, *batches):
    frames = [None if b is None else spark.createDataFrame(b, KIND) for b in batches]
    rows = P.merge_by_position(spark.createDataFrame(base, KIND), frames).orderBy("position").collect()
    return [[(e["time"].hour, e["current"], e["values"]) for e in r.entries] for r in rows]


def test_components_presence_and_time_guard(spark):
    base = [(0, [entry(0, {"u": 1.0}, {"t": 4.0}), entry(1, None, {"t": 5.0}), entry(2, {"u": 3.0}, {})]), (1, [entry(0, {"u": 9.0}, {})])]
    batch = [(0, [entry(0, {"v": 2.0}, {"t": None}), entry(1, {"v": 7.0}, None), entry(3, {"v": 8.0}, {"s": 1.0}), entry(4, {}, {"s": 1.0})]), (5, [entry(0, {"u": 0.0}, {})])]
    assert merged(spark, base, batch) == [
        [(0, {"u": 1.0, "v": 2.0}, {"t": None}), (1, {"v": 7.0}, {"t": 5.0}), (2, {"u": 3.0}, {})], [(0, {"u": 9.0}, {})],
    ]


def test_failed_and_short_batches_leave_the_base(spark):
    base = [(0, [entry(0, {"u": 1.0}, {"t": 4.0}), entry(1, {"u": 2.0}, {"t": 5.0})])]
    short = [(0, [entry(0, {"u": 6.0}, {})])]
    assert merged(spark, base, None) == merged(spark, base, []) == [[(0, {"u": 1.0}, {"t": 4.0}), (1, {"u": 2.0}, {"t": 5.0})]]
    assert merged(spark, base, None, short) == [[(0, {"u": 6.0}, {"t": 4.0}), (1, {"u": 2.0}, {"t": 5.0})]]


def filled(grid, sweeps):
    n, m = len(grid), len(grid[0])
    grid, sweep = [list(r) for r in grid], [[None if v is None else 0 for v in r] for r in grid]
    first = {(i, j): v for i, r in enumerate(grid) for j, v in enumerate(r) if v is not None}
    for k in range(1, sweeps + 1):
        new = {}
        for i in range(n):
            for j in range(m):
                inside = [(a, b) for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) if 0 <= a < n and 0 <= b < m and grid[a][b] is not None]
                if grid[i][j] is None and any(a == i or b == j for a, b in inside):
                    new[i, j] = sum(grid[a][b] for a, b in inside) / len(inside)
        for (i, j), v in new.items():
            grid[i][j], sweep[i][j] = v, k
    out = {}
    for i in range(n):
        for j in range(m):
            v = grid[i][j]
            if v is None and first:
                v = min(((a - i) ** 2 + (b - j) ** 2, a, b, x) for (a, b), x in first.items())[3]
            out[i, j] = (None if v is None else round(v, 9), sweep[i][j])
    return out


@pytest.mark.parametrize("sweeps", [0, 1, 2, 20])
def test_dilation_is_that_of_a_loop(spark, sweeps):
    rng = random.Random(3)
    grids = {"a": [[rng.uniform(-5, 5) if rng.random() < 0.12 else None for _ in range(9)] for _ in range(8)], "b": [[None] * 9 for _ in range(8)]}
    grids["c"] = [[1.5 if (i, j) == (0, 0) else None for j in range(9)] for i in range(8)]
    rows = [(g, i, j, float(i), float(j), v) for g, grid in grids.items() for i, r in enumerate(grid) for j, v in enumerate(r)]
    cells = spark.createDataFrame(rows, "g string, i int, j int, lat double, lon double, z double").repartition(3)
    got = dilate(cells, "z", ["g"], sweeps).withColumn("z", F.round("z", 9)).collect()
    want = {(g, *at): v for g, grid in grids.items() for at, v in filled(grid, sweeps).items()}
    assert {(r.g, r.i, r.j): (r.z, r.sweep) for r in got} == want
