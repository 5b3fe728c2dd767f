"""Points in polygons by a grid of cells, against the crossings of all edges."""

import math
import random

import pytest

from fjordlake.operators import mask as M


def plain(point, edges, boundary):
    x, y = point
    odd = on = False
    for x1, y1, x2, y2 in edges:
        if min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on |= cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
    return (odd or on) if boundary else (odd and not on)


def star(rng, corners):
    x, y, size = rng.uniform(10, 16), rng.uniform(54, 60), rng.choice((0.01, 0.3, 2.0, 9.0))
    ring = [(x + size * r * math.cos(a), y + size * r * math.sin(a)) for k in range(corners) for a, r in [(2 * math.pi * k / corners, rng.uniform(0.2, 1))]]
    return [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]


@pytest.mark.parametrize("boundary", [False, True])
def test_many_polygons(spark, boundary):
    rng = random.Random(5)
    polygons = {k: star(rng, rng.choice((3, 8, 60, 300))) for k in range(40)}
    square = lambda a, b, c, d: [(a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b)]
    polygons[90] = square(11.0, 55.0, 13.0, 57.0) + square(11.5, 55.5, 12.5, 56.5)  # a hole, on lines of the grid
    polygons[91] = square(12.0, 56.0, 12.0, 58.0)  # no width
    points = [(rng.uniform(9, 17), rng.uniform(53, 61)) for _ in range(300)] + [p[:2] for k in (0, 90, 91) for p in polygons[k]]
    points += [(11.0, 56.0), (11.25, 55.25), (12.0, 56.0), (13.0, 55.5), (12.5, 57.0), (11.5, 56.0)]
    edges = spark.createDataFrame([(k, *e) for k, es in polygons.items() for e in es], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, None)], "id int, lon double, lat double")
    found = M.containing(frame, edges, "id", boundary)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.id, r.poly_id) for r in found.collect())
    assert got == sorted((i, k) for i, p in enumerate(points) for k, es in polygons.items() if plain(p, es, boundary))


def test_no_polygons(spark):
    edges = spark.createDataFrame([], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    assert M.containing(spark.createDataFrame([(1, 1.0, 2.0)], "id int, lon double, lat double"), edges, "id").count() == 0


def test_hot_cells_are_dealt(spark):
    """Cells of many points or many polygons go to many parts, and no pair is lost or made twice."""
    rng = random.Random(7)
    polygons = {k: star(rng, 8) for k in range(30)} | {k: star(random.Random(1), 8) for k in range(100, 160)}
    points = [(rng.uniform(9, 17), rng.uniform(53, 61)) for _ in range(100)] + [polygons[100][k % 3][:2] for k in range(80)] + [(13.0, 57.0)] * 50
    edges = spark.createDataFrame([(k, *e) for k, es in polygons.items() for e in es], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lon double, lat double")
    grid = M.PolygonGrid(edges)
    pairs = [(i, k, plain(p, es, False)) for i, p in enumerate(points) for k, es in polygons.items() if plain(p, es, True)]
    assert sorted(tuple(r) for r in grid.containing(frame, "id", most=20).collect()) == sorted(pairs)
    for boundary in (False, True):
        found = frame.join(grid.inside(frame.select("lon", "lat").distinct(), boundary, most=5), ["lon", "lat"], "left_semi")
        assert sorted(r.id for r in found.collect()) == sorted({i for i, _, open_ in pairs if open_ or boundary})


def test_inside_makes_no_pairs(spark):
    """Points in cells inside a polygon meet no polygon, however many are there."""
    square = [(0.0, 0.0, 8.0, 0.0), (8.0, 0.0, 8.0, 8.0), (8.0, 8.0, 0.0, 8.0), (0.0, 8.0, 0.0, 0.0)]
    edges = spark.createDataFrame([(k, *e) for k in range(50) for e in square], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    frame = spark.createDataFrame([(i, 3.0 + i / 1000, 5.0) for i in range(100)], "id int, lon double, lat double")
    met = []
    grid = M.PolygonGrid(edges)
    grid.meet = lambda probes, *rest: met.append(probes.count()) or M.PolygonGrid.meet(probes, *rest)
    assert grid.inside(frame.select("lon", "lat"), False).count() == 100
    assert met == [0]
