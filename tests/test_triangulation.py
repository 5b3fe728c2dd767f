"""Triangles of many points, and rasters of places with many rows."""

import time

import numpy as np
import pytest

from fjordlake.operators import raster as R


@pytest.mark.parametrize("kind", ["random", "lattice", "circle"])
def test_circles_hold_no_point(kind):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 5, (2, 150))
    if kind == "lattice":
        x, y = (a.ravel() * 0.1 for a in np.meshgrid(np.arange(12.0), np.arange(9.0)))
    if kind == "circle":
        x, y = np.cos(np.arange(60) / 60 * 2 * np.pi), np.sin(np.arange(60) / 60 * 2 * np.pi)
    triangles = R.triangulate(x, y)
    hull = len(R.convex_hull(np.column_stack([x, y])))
    sides = {"random": 2 * 150 - 2 - hull, "lattice": 2 * 11 * 8, "circle": 58}
    assert abs(len(triangles) - sides[kind]) <= (2 if kind == "random" else 0)  # slivers on the hull
    for t in triangles:
        a, b, c = (complex(x[i], y[i]) for i in t)
        assert (b - a).real * (c - a).imag - (b - a).imag * (c - a).real > 0
        w = (c - a) / (b - a)
        centre = a + (b - a) * (w - abs(w) ** 2) / (w - w.conjugate())
        assert (np.hypot(x - centre.real, y - centre.imag) >= abs(a - centre) - 1e-6).all()


def test_many_points_are_quick():
    """A minute or more if each point meets all triangles."""
    x, y = np.random.default_rng(2).uniform(0, 5, (2, 30_000))
    began = time.process_time()
    assert len(R.triangulate(x, y)) > 59_000
    assert time.process_time() - began < 20


def test_rows_of_a_place_meet_before_their_raster(spark):
    """The first row with a value counts, whatever the order of rows; rows are counted, and a group without values stays."""
    rows = [("a", float(k % 3), float(k // 3), 10.0 * k + m if m else None, m) for k in range(9) for m in (3, 1, 0, 2)] + [("b", 1.0, 1.0, None, 0)]
    frame = spark.createDataFrame(rows, "g string, lon double, lat double, z double, seq int")
    found = R.rasters(frame, ["g"], "z", 3, (0.0, 2.0, 0.0, 2.0), "linear", False, "seq")
    got = {r.g: (r.n_points, r["values"]) for r in found.collect()}
    assert got["a"][0] == 27 and got["a"][1] == pytest.approx([10.0 * k + 1 for k in range(9)])
    assert got["b"] == (0, [None] * 9)
