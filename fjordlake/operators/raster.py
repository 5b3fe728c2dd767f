"""Rasters from scattered observations: one group of rows for a parameter and an hour, in numpy."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RAMPS, rgb


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles (counterclockwise) of distinct points, by insertion one after the other.

    Points of one circle or line, as on lattices, are told apart by a fixed
    shift of a billionth of the extent. Fewer than three points, or points on
    one line, have none. Triangles are in order of their largest point, which
    is their last corner, and then of the others.
    """
    n = len(x)
    if n < 3:
        return np.empty((0, 3), np.int64)
    span = max(np.ptp(x), np.ptp(y)) or 1.0
    turn = np.random.default_rng(12345).uniform(-1, 1, (2, n)) * span * 1e-9
    centre_x, centre_y = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
    px = np.concatenate([(x + turn[0] - centre_x) / span, [-60.0, 60.0, 0.0]])
    py = np.concatenate([(y + turn[1] - centre_y) / span, [-60.0, -60.0, 60.0]])
    triangles = np.array(_inserted(px.tolist(), py.tolist(), _rounds(px[:n], py[:n])), np.int64).reshape(-1, 3)
    triangles = triangles[(triangles < n).all(1)]
    triangles = triangles[np.arange(len(triangles))[:, None], (triangles.argmax(1)[:, None] + [1, 2, 3]) % 3]
    triangles = triangles[np.lexsort((triangles[:, :2].max(1), triangles[:, :2].min(1), triangles[:, 2]))]
    a, b, c = triangles.T
    area = (x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])
    return triangles[np.abs(area) > 1e-12 * span * span]


def _rounds(x: np.ndarray, y: np.ndarray) -> list[int]:
    """An order of points in which few triangles are made in vain and neighbours follow each other: rounds drawn at random, twice as many points in each, in strips."""
    drawn, out, at = np.random.default_rng(54321).permutation(len(x)), [], 0
    while at < len(x):
        part = drawn[at : max(2 * at, 64)]
        at += len(part)
        strip = np.floor((y[part] + 0.5) * np.sqrt(len(part) / 2))
        out += part[np.lexsort((np.where(strip % 2, -x[part], x[part]), strip))].tolist()
    return out


def _inserted(px: list[float], py: list[float], order: list[int]) -> list[tuple[int, int, int]]:
    """Triangles of the points and of the three last ones around them. A walk finds the triangle of a point; those whose circles hold it lie around."""
    n = len(px) - 3
    corners: list = [(n, n + 1, n + 2)]
    beside: list = [[-1, -1, -1]]  # across the side from corner i to the next
    free: list[int] = []
    last = 0
    for p in order:
        x, y = px[p], py[p]
        t, came = last, -1
        for _ in range(len(corners) + 1):
            abc, around = corners[t], beside[t]
            for i in (0, 1, 2):
                a, b, to = abc[i], abc[i - 2], around[i]
                if to != came and to >= 0 and (px[b] - px[a]) * (y - py[a]) - (x - px[a]) * (py[b] - py[a]) < 0:
                    t, came = to, t
                    break
            else:
                break
        bad, stack, rim = {t}, [t], []
        while stack:
            t = stack.pop()
            abc, around = corners[t], beside[t]
            for i in (0, 1, 2):
                to = around[i]
                if to in bad:
                    continue
                a, b = abc[i], abc[i - 2]
                if to >= 0:
                    k, l, m = corners[to]
                    ax, ay, bx, by, cx, cy = px[k] - x, py[k] - y, px[l] - x, py[l] - y, px[m] - x, py[m] - y
                    hold = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
                    if hold > 0 or (px[b] - px[a]) * (y - py[a]) - (x - px[a]) * (py[b] - py[a]) <= 0:
                        bad.add(to)
                        stack.append(to)
                        continue
                rim.append((a, b, to))
        rim = [r for r in rim if r[2] not in bad]
        free.extend(bad)
        made = {}
        for a, b, to in rim:
            t = free.pop() if free else len(corners)
            if t == len(corners):
                corners.append(None)
                beside.append(None)
            made[a] = t, b, to
        for a, (t, b, to) in made.items():
            corners[t] = (a, b, p)
            beside[t] = [to, made[b][0], -1]
        for a, (t, b, to) in made.items():
            beside[made[b][0]][2] = t
            if to >= 0:
                k = corners[to].index(b)
                beside[to][k] = t
            last = t
    gone = set(free)
    return [c for t, c in enumerate(corners) if t not in gone]


def gradients(x: np.ndarray, y: np.ndarray, z: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Slopes at the points: the plane through a point that fits its neighbours best, nearer ones counting more."""
    sums = np.zeros((len(x), 5))
    for i, j in ((0, 1), (1, 2), (2, 0), (1, 0), (2, 1), (0, 2)):
        a, b = triangles[:, i], triangles[:, j]
        dx, dy, dz = x[b] - x[a], y[b] - y[a], z[b] - z[a]
        w = 1 / np.maximum(dx * dx + dy * dy, 1e-30)
        np.add.at(sums, a, np.column_stack([w * dx * dx, w * dx * dy, w * dy * dy, w * dx * dz, w * dy * dz]))
    xx, xy, yy, xz, yz = sums.T
    det = xx * yy - xy * xy
    flat = np.abs(det) < 1e-12
    det = np.where(flat, 1, det)
    return np.where(flat, 0, np.array([(yy * xz - xy * yz) / det, (xx * yz - xy * xz) / det])).T


def interpolate(x, y, z, at_x, at_y, method: str = "linear") -> np.ndarray:
    """Values at places inside the hull, NaN outside.

    ``linear`` is the plane of each triangle. ``cubic`` is a cubic over each
    triangle with the values and slopes of its corners, whose middle is set
    so that quadratic fields come out exactly; it is smooth at the points and
    continuous everywhere.
    """
    x, y, z = distinct_points(x, y, z)
    triangles = triangulate(x, y)
    owner, weights = np.full(len(at_x), -1), np.zeros((3, len(at_x)))
    order = np.argsort(at_y, kind="stable")
    rows = at_y[order]
    for k, t in enumerate(triangles):
        near = order[np.searchsorted(rows, y[t].min()) : np.searchsorted(rows, y[t].max(), "right")]
        near = near[(at_x[near] >= x[t].min()) & (at_x[near] <= x[t].max())]
        found = _barycentric(x[t][:, None], y[t][:, None], at_x[near], at_y[near])
        inside = (found >= -1e-9).all(0)
        owner[near[inside]], weights[:, near[inside]] = k, found[:, inside]
    return surface(x, y, z, triangles, owner, weights, method)


def distinct_points(x, y, z) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points at places of their own, the first of equals."""
    _, first = np.unique(np.round(np.column_stack([x, y]), 9), axis=0, return_index=True)
    first = np.sort(first)
    return x[first], y[first], z[first]


def _barycentric(x, y, at_x, at_y) -> np.ndarray:
    """Weights of the three corners ``x[0], y[0]`` and so on at places."""
    area = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])
    l1 = ((at_x - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (at_y - y[0])) / area
    l2 = ((x[1] - x[0]) * (at_y - y[0]) - (at_x - x[0]) * (y[1] - y[0])) / area
    return np.array([1 - l1 - l2, l1, l2])


def cover(x, y, triangles, at_x: np.ndarray, at_y: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of a lattice, row by row, its triangle (-1: none) and the weights of the corners.

    Every triangle looks at the cells in its bounding box; boxes are listed
    for many triangles at once, about ``most`` cells.
    """
    columns = len(at_x)
    owner, weights = np.full(len(at_y) * columns, -1), np.zeros((3, len(at_y) * columns))
    if not len(triangles):
        return owner, weights
    tx, ty = x[triangles].T, y[triangles].T
    left, right = np.searchsorted(at_x, tx.min(0)), np.searchsorted(at_x, tx.max(0), "right")
    low, high = np.searchsorted(at_y, ty.min(0)), np.searchsorted(at_y, ty.max(0), "right")
    wide, cells = right - left, (right - left) * (high - low)
    part = np.cumsum(cells) // most
    for k in np.unique(part):
        some = np.flatnonzero((part == k) & (cells > 0))
        t = np.repeat(some, cells[some])
        place = np.arange(len(t)) - np.repeat(np.cumsum(cells[some]) - cells[some], cells[some])
        i, j = low[t] + place // wide[t], left[t] + place % wide[t]
        found = _barycentric(tx[:, t], ty[:, t], at_x[j], at_y[i])
        inside = (found >= -1e-9).all(0)
        cell = i[inside] * columns + j[inside]
        owner[cell], weights[:, cell] = t[inside], found[:, inside]
    return owner, weights


def surface(x, y, z, triangles, owner, weights, method: str) -> np.ndarray:
    """Values at places whose triangles and weights are known, NaN where there is none."""
    out = np.full(len(owner), np.nan)
    there = np.flatnonzero(owner >= 0)
    if not len(there):
        return out
    w, of = weights[:, there], owner[there]
    if method == "linear":
        out[there] = (z[triangles[of]].T * w).sum(0)
        return out
    slopes = gradients(x, y, z, triangles)
    corner = z[triangles].T
    rim = np.zeros(len(triangles))
    total = np.zeros(len(there))
    for i in range(3):
        total += corner[i][of] * w[i] ** 3
        for j in range(3):
            if i != j:  # control value on the side from i towards j
                a, b = triangles[:, i], triangles[:, j]
                side = corner[i] + (slopes[a, 0] * (x[b] - x[a]) + slopes[a, 1] * (y[b] - y[a])) / 3
                rim += side
                total += 3 * side[of] * w[i] ** 2 * w[j]
    out[there] = total + 6 * (rim / 4 - corner.sum(0) / 6)[of] * w[0] * w[1] * w[2]
    return out


def fill_nearest(grid: np.ndarray, x, y, z, at_x, at_y, tile: int = 1024) -> np.ndarray:
    """Values where the grid has none: those of the nearest points, the first of equals.

    Places are taken in tiles of neighbours. A tile meets only the points
    that can be nearest to one of its places: those no farther from its
    middle than the nearest one and the tile's extent.
    """
    out = grid.copy()
    empty = np.flatnonzero(np.isnan(grid))
    if not len(empty) or not len(x):
        return out
    span = max(np.ptp(at_x[empty]), np.ptp(at_y[empty])) or 1.0
    side = span / max(1, int(np.sqrt(len(empty) / tile)))
    number = np.floor((at_y[empty] - at_y[empty].min()) / side) * 65536 + np.floor((at_x[empty] - at_x[empty].min()) / side)
    order = np.argsort(number, kind="stable")
    for part in np.split(empty[order], np.flatnonzero(np.diff(number[order])) + 1):
        px, py = at_x[part], at_y[part]
        mx, my = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
        reach = np.sqrt((px - mx) ** 2 + (py - my) ** 2).max()
        away = np.sqrt((x - mx) ** 2 + (y - my) ** 2)
        near = np.flatnonzero(away <= away.min() + 2 * reach + 1e-9)
        d = (x[near][None, :] - px[:, None]) ** 2 + (y[near][None, :] - py[:, None]) ** 2
        out[part] = z[near[d.argmin(1)]]
    return out


@lru_cache(maxsize=2)
def _covered(points: bytes, count: int, at_x: bytes, at_y: bytes):
    """Triangles of some places and the cover of a lattice, which the hours of one worker share if their places are the same."""
    x, y = np.frombuffer(points).reshape(2, count)
    triangles = triangulate(x, y)
    return triangles, *cover(x, y, triangles, np.frombuffer(at_x), np.frombuffer(at_y))


def lattice_values(x, y, z, at_x: np.ndarray, at_y: np.ndarray, method: str, fill: bool) -> np.ndarray:
    """Values at the cells of a lattice, row by row: ``nearest``, or by triangles and then the nearest point where asked."""
    gy, gx = (a.ravel() for a in np.meshgrid(at_y, at_x, indexing="ij"))
    grid = np.full(len(gx), np.nan)
    if len(x) and method != "nearest":
        px, py, pz = distinct_points(x, y, z)
        triangles, owner, weights = _covered(np.stack([px, py]).tobytes(), len(px), at_x.tobytes(), at_y.tobytes())
        grid = surface(px, py, pz, triangles, owner, weights, method)
    return fill_nearest(grid, x, y, z, gx, gy) if fill or method == "nearest" else grid


def wet_cells(edges: list[tuple[int, float, float, float, float]], at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Which cells of a lattice are in a polygon, by parity: each row is cut where edges ``polygon, x1, y1, x2, y2`` cross it."""
    out = np.zeros((len(at_y), len(at_x)), bool)
    polygon, x1, y1, x2, y2 = np.array(edges, float).reshape(-1, 5).T
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    for i, lat in enumerate(at_y):
        met = np.flatnonzero((low <= lat) & (lat < high))
        cuts = x1[met] + (lat - y1[met]) * (x2[met] - x1[met]) / (y2[met] - y1[met])
        for p in np.unique(polygon[met]):
            beyond = np.sort(cuts[polygon[met] == p])
            out[i] |= (len(beyond) - np.searchsorted(beyond, at_x, "right")) % 2 == 1
    return out


def raster_job(
    rows: DataFrame, by: list[str], n: int, box: tuple[float, float, float, float],
    edges: list[tuple[int, float, float, float, float]] | None = None, method: str = "cubic", side: int = 25, draw: bool = True,
) -> DataFrame:
    """The whole way from scattered values to masked pictures, for each group of rows ``parameter, lon, lat, value, seq``.

    ``side`` places on each side of the box get the value of the row nearest
    to them; all are interpolated, what is outside the hull is filled from
    the nearest, speeds and salinities are held at 0, cells outside the
    polygons of ``edges`` are emptied, and the rest is counted and drawn.
    Returns the group, ``n_points, n_values, n_empty, least, most, mean`` and
    the ``png`` (null if not drawn). A group is one parameter and time: the
    points of one raster, whose task makes it alone.
    """
    west, east, south, north = box
    at_x, at_y = np.linspace(west, east, n), np.linspace(south, north, n)
    share = np.arange(side) / (side - 1)
    edge_x = np.concatenate([west + share * (east - west)] * 2 + [np.full(side, west), np.full(side, east)])
    edge_y = np.concatenate([np.full(side, south), np.full(side, north)] + [south + share * (north - south)] * 2)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    wet = wet_cells(edges, at_x, at_y).ravel() if edges is not None else np.ones(n * n, bool)

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["parameter"].iloc[0]
        good = frame.dropna(subset=["value"]).sort_values("seq", kind="stable")
        x, y, z = (good[c].to_numpy(float) for c in ("lon", "lat", "value"))
        if len(x):
            around = fill_nearest(np.full(len(edge_x), np.nan), x, y, z, edge_x, edge_y)
            x, y, z = np.append(x, edge_x), np.append(y, edge_y), np.append(z, around)
        grid = lattice_values(x, y, z, at_x, at_y, method, True)
        if name in ("current", "salinity"):
            grid = np.where(grid < 0, 0.0, grid)
        grid = np.where(wet, grid, np.nan)
        kept = grid[~np.isnan(grid)]
        some = (float(kept.min()), float(kept.max()), float(kept.mean())) if len(kept) else (None, None, None)
        found = [{c: frame[c].iloc[0] for c in by} | dict(zip(("least", "most", "mean"), some))]
        return pd.DataFrame(found).assign(
            n_points=len(good), n_values=len(kept), n_empty=len(grid) - len(kept), png=[png(grid, n, name) if draw else None]
        )[[*by, "n_points", "n_values", "n_empty", "least", "most", "mean", "png"]]

    out = f"{kinds}, n_points long, n_values long, n_empty long, least double, most double, mean double, png binary"
    return rows.groupBy(*by).applyInPandas(make, out)


def rasters(
    rows: DataFrame, by: list[str], value: str, n: int, box: tuple[float, float, float, float], method: str = "cubic", fill: bool = True, seq: str | None = None
) -> DataFrame:
    """Rasters of n by n values, row by row from below, one for each group of ``lon, lat, value`` rows.

    ``values`` has nulls outside the hull unless filled from the nearest
    point. Of a place's rows with a value the first by ``seq`` counts (the
    one of the least value without it), which is found before the rows of a
    parameter and hour meet: a task holds the distinct places of one raster,
    and rasters are made side by side.
    """
    west, east, south, north = box
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    there = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    first = F.min(F.when(there, F.struct(*([seq] if seq else []), F.col(value).alias("value"))))
    places = rows.groupBy(*by, "lon", "lat").agg(F.count_if(there).alias("n"), first.alias("first"))

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        good = frame[frame["n"] > 0].sort_values(["lat", "lon"], kind="stable")
        x, y, z = (good[c].to_numpy(float) for c in ("lon", "lat", "value"))
        at_x, at_y = np.linspace(west, east, n), np.linspace(south, north, n)
        grid = lattice_values(x, y, z, at_x, at_y, method, fill)
        values = [None if np.isnan(v) else float(v) for v in grid]
        return pd.DataFrame([{**{c: frame[c].iloc[0] for c in by}, "n_points": good["n"].sum(), "values": values}])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a group is few bytes and much work: not to be merged by size
    held = places.select(*by, "lon", "lat", "n", F.col("first.value").alias("value")).repartition(tasks, *by)
    return held.groupBy(*by).applyInPandas(make, f"{kinds}, n_points long, `values` array<double>")


#: Twice the area of a triangle whose corners are on one line but for rounding.
_FLAT = 1e-9


def hulls(rows: DataFrame, by: list[str], lon: float, lat: float, salts: int = 32) -> DataFrame:
    """Convex hull of each group's points: its corners in order, their number, whether it holds a place, and the distance of its nearest corner.

    Distinct places of a group are dealt to ``salts`` tasks, whose hulls meet
    in one: a corner of all is a corner of its part, so few rows do.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        corners = convex_hull(frame[["lon", "lat"]].to_numpy(float))
        return pd.DataFrame(corners, columns=["lon", "lat"]).assign(**{c: frame[c].iloc[0] for c in by})[[*by, "lon", "lat"]]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        hull = np.array(convex_hull(frame[["lon", "lat"]].to_numpy(float)))
        nxt = np.roll(hull, -1, axis=0)
        side = (nxt[:, 0] - hull[:, 0]) * (lat - hull[:, 1]) - (nxt[:, 1] - hull[:, 1]) * (lon - hull[:, 0])
        away = float(np.sqrt(((hull - [lon, lat]) ** 2).sum(1)).min())
        holds = bool(len(hull) > 2 and (side > 0).all())
        found = {c: frame[c].iloc[0] for c in by} | {"corners": [{"lon": x, "lat": y} for x, y in hull.tolist()]}
        return pd.DataFrame([found | {"n_corners": len(hull), "holds": holds, "corner_distance": away}])

    places = rows.select(*by, "lon", "lat").distinct().withColumn("salt", F.pmod(F.hash("lon", "lat"), F.lit(salts)))
    parts = places.groupBy(*by, "salt").applyInPandas(part, f"{kinds}, lon double, lat double")
    return parts.groupBy(*by).applyInPandas(whole, f"{kinds}, corners array<struct<lon: double, lat: double>>, n_corners long, holds boolean, corner_distance double")


def convex_hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the hull, counterclockwise (monotone chains); what rounding alone makes a corner is none."""
    distinct = sorted(set(map(tuple, points.tolist())))
    if len(distinct) < 3:
        return distinct

    def chain(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= _FLAT:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(distinct) + chain(distinct[::-1])


def png(values, n: int, parameter: str, alpha: float = 0.8) -> bytes:
    """An n by n picture of a raster on its parameter's ramp; places without a value are transparent."""
    stops = RAMPS[parameter]
    at = np.array([s for s, _ in stops])
    colours = np.array([rgb(c) for _, c in stops], float)
    level = at[0] + np.arange(256) / 255 * (at[-1] - at[0])
    table = np.column_stack([np.interp(level, at, colours[:, c]) for c in range(3)])
    grid = np.array(values, float).reshape(n, n)[::-1]  # None is NaN
    share = np.floor((np.nan_to_num(grid) - at[0]) / (at[-1] - at[0]) * 256)
    picture = np.zeros((n, n, 4), np.uint8)
    picture[..., :3] = np.floor(table[np.clip(share, 0, 255).astype(int)] + 0.5)
    picture[..., 3] = np.where(np.isnan(grid), 0, round(255 * alpha))
    picture[np.isnan(grid)] = 0
    lines = b"".join(b"\0" + row.tobytes() for row in picture)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", n, n, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines, 6)) + part(b"IEND", b"")


def pictures(rasters_: DataFrame, n: int, by: list[str], parameter: str) -> DataFrame:
    """``png`` bytes of each raster."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters_.select(*by).schema.fields)

    def draw(frames):
        for frame in frames:
            yield frame[by].assign(png=[png(v, n, parameter) for v in frame["values"]])

    return rasters_.select(*by, "values").mapInPandas(draw, f"{kinds}, png binary")
