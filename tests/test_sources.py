"""Documents in and out, masks, interpolation, searches and streams, on small made-up inputs."""

import json
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fjordlake.functions import vectors as V
from fjordlake.operators import mask as M
from fjordlake.operators import nearest as N
from fjordlake.operators import scan
from fjordlake.operators import raster as R
from fjordlake.operators import search as Q
from fjordlake.operators import series as E
from fjordlake.sinks import files
from fjordlake.sinks.versions import Versions
from fjordlake.sources import area, catalog, coverage, geometry, rest
from fjordlake.streaming import sessions


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value))
    return str(path)


def test_area_documents_round_trip(spark, tmp_path):
    data = [{"time": "2025-06-29T14:00:00.000Z", "temperature": None}, {"time": "2025-06-29T14:30:00.000Z", "temperature": 5.0, "current": {"u": 0.0, "v": 0.5}}]
    doc = {"metadata": {"collection": "c"}, "points": [{"lat": 55.0, "lon": 12.0, "data": data}, {"lat": 56.0, "lon": 12.5, "name": "n", "isPointSpecific": True, "data": []}]}
    rows = area.long_table(area.read_area(spark, put(tmp_path, "a.json", doc)))
    assert rows.count() == 3 and rows.where("is_point_specific").count() == 1
    hour = rows.where(F.col("time_str").startswith("2025-06-29T14"))
    first = E.first_entry(hour, "point_id", order=("seq",))
    assert first.where("temperature IS NOT NULL").count() == 0  # the first entry decides
    back = area.document(rows.where("time_str IS NOT NULL")).first()
    assert [d.temperature for d in back.data] == [None, 5.0] and back.data[0].current is None
    files.write_document(rows.limit(1), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 1


def test_validity(spark):
    rows = spark.createDataFrame([([(1.0, None)],), ([(1.0, 2.0)],), ([],)], "vectors array<struct<u:double,v:double>>")
    assert [r[0] for r in rows.select(area.all_valid(F.col("vectors"))).collect()] == [False, True, True]


def cube(**more):
    axes = {"t": {"values": ["t0", "t1"]}, "x": {"start": 10.0, "stop": 12.0, "num": 3}, "y": {"start": 55.0, "stop": 56.0, "num": 2}}
    ranges = {"salinity": {"values": [float(i) for i in range(12)]}, "current-u": {"values": [None] * 12}}
    return {"domain": {"domainType": "Grid", "axes": axes}, "ranges": ranges} | more


def test_cubes(spark, tmp_path):
    rows = coverage.cube_rows(coverage.read_coverage(spark, put(tmp_path, "c.json", cube())))
    got = {(r.time_str, r.lat, r.lon): (r.salinity, r.u) for r in rows.collect()}
    assert len(got) == 12 and got["t1", 55.0, 12.0] == (8.0, None)
    named = cube()
    named["domain"]["axes"] |= {"x": None, "y": None, "lon": {"values": [1.0, 2.0, 3.0]}, "lat": {"values": [4.0, 5.0]}}
    rows = coverage.cube_rows(coverage.read_coverage(spark, put(tmp_path, "n.json", named)))
    assert {r.lon for r in rows.collect()} == {1.0, 2.0, 3.0}
    with pytest.raises(PySparkException):
        coverage.cube_rows(coverage.read_coverage(spark, put(tmp_path, "b.json", cube(ranges=None)))).collect()


def test_positions(spark, tmp_path):
    make = lambda u, v: {"domain": {"axes": {"t": {"values": ["a", "b"]}}}, "ranges": {"current-u": {"values": u}, "current-v": {"values": v}}}
    whole = coverage.read_coverage(spark, put(tmp_path, "p.json", make([1.0, 2.0], [3.0, 4.0])))
    assert coverage.position_rows(whole, strict=True).count() == 2
    uneven = coverage.read_coverage(spark, put(tmp_path, "q.json", make([1.0, 2.0, 5.0], [3.0])))
    assert coverage.position_rows(uneven).count() == 2
    with pytest.raises(PySparkException):
        coverage.position_rows(uneven, strict=True).collect()


def test_merge_keeps_absent_and_takes_null(spark):
    base = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, 4.0)], "p int, temperature double")
    batch = spark.createDataFrame([(1, None, True), (2, 9.0, False)], "p int, temperature double, has_temperature boolean")
    got = {r.p: r.temperature for r in E.merge_batch(base, batch, ["p"], ["temperature"]).collect()}
    assert got == {1: None, 2: 4.0, 3: 4.0}


MASK = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [9, 9]}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]], [[[8, 8], [9, 8], [9, 9], [8, 8]]]]}},
    ],
}


def test_masks(spark, tmp_path):
    edges = geometry.edges(geometry.read_mask(spark, put(tmp_path, "m.json", MASK)))
    places = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.5, 3.5), (4, 4.0, 2.0), (5, 8.8, 8.3), (6, 9.0, 9.5), (7, 1.0, 1.5)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in places], "id int, lon double, lat double")
    assert {r.id for r in M.inside(points, edges, "id").collect()} == {1, 3, 5}
    assert {r.id for r in M.inside(points, edges, "id", boundary=True).collect()} == {1, 3, 4, 5, 7}
    assert M.containing(points, edges, "id").where("id = 3").count() == 2
    water = points.where("id = 1")
    rows = spark.createDataFrame([(1, 0.50001, 0.49999), (2, 0.6, 0.5)], "k int, lon double, lat double")
    keys = {"lat_key": V.key4(F.col("lat")), "lon_key": V.key4(F.col("lon"))}
    assert [r.k for r in M.wet(rows, water, keys).collect()] == [1]


def test_lattices(spark):
    assert len(geometry.stepped(54.9, 59.6, 0.05)) == 95
    cells = geometry.lattice(spark.range(1).drop("id"), 3, 0.0, 2.0, 10.0, 14.0).orderBy("i", "j").collect()
    assert (cells[0].lat, cells[0].lon, cells[5].lat, cells[5].lon) == (10.0, 0.0, 12.0, 2.0)
    edge = N.box_edge(spark.range(1).drop("id"), 25, 10.3, 16.6, 54.9, 59.6)
    assert edge.count() == 100 and edge.select("lon", "lat").distinct().count() == 96


def test_nearest_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    known = [(i, *map(float, rng.uniform(0, 9, 2)), float(i)) for i in range(60)] + [(99, 500.0, 400.0, 99.0), (98, 4.0, 4.0, 1.5), (97, 4.0, 4.0, 2.5)]
    places = [(i, *map(float, rng.uniform(-3, 14, 2))) for i in range(80)] + [(200, 300.0, 300.0), (201, 4.0, 4.0)]
    rows = spark.createDataFrame(known, "seq int, lat double, lon double, value double")
    got = {r.id: r.value for r in N.nearest(spark.createDataFrame(places, "id int, lat double, lon double"), rows, "id", "value", "seq").collect()}
    want = {i: min(known, key=lambda k: ((k[2] - x) ** 2 + (k[1] - y) ** 2, k[0]))[3] for i, y, x in places}
    assert got == want


def test_interpolation():
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 10, (2, 60))
    at_x, at_y = (a.ravel() for a in np.meshgrid(np.linspace(0, 10, 25), np.linspace(0, 10, 25)))
    plane = lambda a, b: 2 * a - 3 * b + 1
    for method in ("linear", "cubic"):
        grid = R.interpolate(x, y, plane(x, y), at_x, at_y, method)
        there = ~np.isnan(grid)
        assert 0.5 < there.mean() < 1 and np.allclose(grid[there], plane(at_x, at_y)[there])
        z = rng.normal(size=60)
        assert np.allclose(R.interpolate(x, y, z, x, y, method), z)
        filled = R.fill_nearest(R.interpolate(x, y, z, at_x, at_y, method), x, y, z, at_x, at_y)
        assert not np.isnan(filled).any()
    gx, gy = (a.ravel().astype(float) for a in np.meshgrid(range(6), range(6)))
    triangles = R.triangulate(gx, gy)
    area = sum(abs((gx[b] - gx[a]) * (gy[c] - gy[a]) - (gx[c] - gx[a]) * (gy[b] - gy[a])) / 2 for a, b, c in triangles)
    assert abs(area - 25) < 1e-9
    assert np.isnan(R.interpolate(gx[:2], gy[:2], gx[:2], at_x, at_y)).all()


def test_hull_and_pictures():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0], [0, 0]], float)
    assert R.convex_hull(square) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    data = R.png([0.0, None, 1.3, 0.65], 2, "current")
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    size = int.from_bytes(data[33:37], "big")
    lines = zlib.decompress(data[41 : 41 + size])
    assert lines[1:9] == bytes([64, 0, 0, 204]) + lines[5:9] and lines[9 + 1 : 9 + 5] == bytes([0, 0, 128, 204]) and lines[9 + 5 : 9 + 9] == bytes(4)


def test_searches(spark):
    rows = spark.createDataFrame([(i, 55.0 + i / 100, 12.0, 0.1 * i, 0.0) for i in range(8)], "seq int, lat double, lon double, u double, v double")
    assert [r.seq for r in Q.nearest_points(rows, 55.0, 12.0, 0.05).orderBy("dist").collect()] == [0, 1, 2]
    far = Q.nearest_points(rows, 70.0, 12.0, 0.05).collect()
    assert [r.seq for r in far] == [7, 6, 5, 4, 3] and not any(r.in_box for r in far)
    stats = Q.radius_stats(rows, 55.0, 12.0, 0.0201).first()
    assert stats.n == 3 and abs(stats.max_knots - 0.2 * 1.944) < 1e-9


def test_catalogue_metadata_and_listing(spark, tmp_path):
    doc = {"collections": [{"id": "DKSS_a", "title": "A", "parameter_names": {f"p{i}": "x" for i in range(7)}, "links": [{"rel": "self", "href": "h/x?k=1"}]}, {"id": "other"}]}
    found = catalog.collections(spark, put(tmp_path, "cat.json", doc), "dkss").collect()
    assert len(found) == 1 and len(found[0].parameters) == 5 and found[0].addresses == ["h/x"]
    listed = put(tmp_path, "one.json", {"instances": [{"id": "2025-06-29T00:00:00Z"}, {"id": "2025-06-29T06:00:00Z"}]})
    assert [r.id for r in catalog.instances(spark, listed).orderBy("seq").collect()] == ["2025-06-29T00:00:00Z", "2025-06-29T06:00:00Z"]
    meta = files.raster_metadata(spark, "salinity", ["2025-06-29T12:00:00.000Z", "2025-06-29T13:00:00.000Z"], 1, [10.3, 16.6, 54.9, 59.6], 64, "now")
    meta.coalesce(1).write.json(f"file://{tmp_path}/meta")
    again = catalog.raster_metadata(spark, f"file://{tmp_path}/meta")
    assert again.first().total_images == 1 and len(again.first().timestamps) == 2
    assert catalog.image_for_hour(again, "2025-06-29T13").first().timestamp == "2025-06-29T13:00:00.000Z"
    assert catalog.image_for_hour(again, "2030").first().timestamp is None
    hours = spark.createDataFrame([("2025-06-29T12",), ("2030-01-01T00",)], "hour string")
    assert sorted((r.hour, r.timestamp) for r in catalog.images_for_hours(again, hours).collect()) == [("2025-06-29T12", "2025-06-29T12:00:00.000Z"), ("2030-01-01T00", None)]
    wanted = spark.createDataFrame([("a",), ("b",)], "name string")
    assert files.missing(wanted, wanted.limit(1), "name").count() == 1 and files.missing(wanted, wanted, "name", force=True).count() == 2


def test_documents_by_address(spark, tmp_path):
    spark.dataSource.register(rest.JsonDocuments)
    good = f"file://{put(tmp_path, 'd.json', {'a': 1})}"
    read = spark.read.format("json_documents").option("urls", f"{good}\nfile:///none/x.json")
    assert [json.loads(r.body) for r in read.option("onError", "skip").load().collect()] == [{"a": 1}]
    with pytest.raises(PySparkException):
        read.option("onError", "fail").load().collect()
    assert rest.address("http://h/p", lat=1, key="", name="x y") == "http://h/p?lat=1&name=x+y"
    assert rest.redacted("http://h?a=1&api-key=secret&b=2") == "http://h?a=1&api-key=***&b=2"


def test_throttle_and_changes_in_batch(spark):
    at = lambda ms: f"2024-01-01 00:00:{ms / 1000:06.3f}"
    rows = [(1, i, at(ms)) for i, ms in enumerate([0, 40, 90, 120, 400, 430])]
    frame = spark.createDataFrame(rows, "user_id int, event_id int, t string").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    got = scan.throttled(frame, "user_id", 100).orderBy("emitted_ms").collect()
    base = min(r.emitted_ms for r in got)
    assert [(r.event_id, r.emitted_ms - base) for r in got] == [(0, 0), (2, 100), (3, 200), (4, 400), (5, 500)]
    shares = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.1, 0.9, 0.4, 0.95, 0.8])], "k int, n int, v double")
    assert [r.n for r in scan.accepted_changes(shares, "k", "v", ["n"], 0.5).orderBy("n").collect()] == [0, 2, 4]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "event_id long, ts timestamp, user_id long, value double"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [(i, at(s), 1, float(i)) for i, s in enumerate([0, 10, 20, 200, 210])] + [(99, at(3000), 2, 0.0)]
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").withColumn("ts", F.col("t").cast("timestamp"))
    frame.select("event_id", "ts", "user_id", "value").write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))

    def run(out, name):
        query = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name).collect()

    got = run(sessions.drag_sessions(stream, "30 seconds", "10 seconds"), "drags")
    assert sorted((r.n, r.last_event) for r in got) == [(2, 4), (3, 2)]
    passed = run(sessions.throttle(stream.withWatermark("ts", "10 seconds"), 60_000), "passed")
    first = min(r.emitted_ms for r in passed if r.user_id == 1)
    mine = sorted((r.emitted_ms - first, r.value) for r in passed if r.user_id == 1)
    assert mine[:3] == [(0, 0.0), (60_000, 2.0), (200_000, 3.0)]
    sessions.keep_fresh(stream, f"file://{tmp_path}/fresh", str(tmp_path / "fresh-state")).awaitTermination()
    assert Versions(spark, f"file://{tmp_path}/fresh").read().count() == len(rows)


def test_lattice_rasters():
    rng = np.random.default_rng(4)
    x, y = rng.random(120), rng.random(120)
    plane = lambda a, b: 2 * a - 3 * b + 1
    at_x, at_y = np.linspace(0, 1, 31), np.linspace(0, 1, 23)
    gy, gx = (a.ravel() for a in np.meshgrid(at_y, at_x, indexing="ij"))
    z = np.sin(5 * x) + y
    for method in ("linear", "cubic"):
        alone = R.interpolate(x, y, z, gx, gy, method)
        grid = R.lattice_values(x, y, z, at_x, at_y, method, False)
        assert np.array_equal(np.isnan(alone), np.isnan(grid)) and np.allclose(alone, grid, equal_nan=True)
        flat = R.lattice_values(x, y, plane(x, y), at_x, at_y, method, False)
        there = ~np.isnan(flat)
        assert there.sum() > 500 and np.allclose(flat[there], plane(gx, gy)[there])
    nearest = z[((gx[:, None] - x) ** 2 + (gy[:, None] - y) ** 2).argmin(1)]
    assert np.array_equal(R.lattice_values(x, y, z, at_x, at_y, "nearest", True), nearest)
    filled = R.lattice_values(x, y, z, at_x, at_y, "linear", True)
    hole = np.isnan(R.interpolate(x, y, z, gx, gy))
    assert hole.any() and np.array_equal(filled[hole], nearest[hole])


def test_wet_cells():
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
    sides = [(1, *a, *b) for r in (ring, hole) for a, b in zip(r, r[1:])] + [(2, *a, *b) for a, b in zip(ring, ring[1:])][:0]
    at = np.array([-0.5, 0.5, 2.0, 3.5, 4.5])
    want = [[0 < v < 4 and 0 < w < 4 and not (1 < v < 3 and 1 < w < 3) for v in at] for w in at]
    assert R.wet_cells(sides, at, at).tolist() == want
    assert not R.wet_cells([], at, at).any()


def test_raster_job(spark):
    rows = [("salinity", "a", x / 4, y / 4, x / 4 + y / 4 - 0.5, x * 5 + y) for x in range(5) for y in range(5)]
    rows += [("salinity", "b", 0.5, 0.5, None, 0)]
    frame = spark.createDataFrame(rows, "parameter string, hour string, lon double, lat double, value double, seq long")
    got = {r.hour: r for r in R.raster_job(frame, ["parameter", "hour"], 9, (0, 1, 0, 1), None, "linear").collect()}
    a, b = got["a"], got["b"]
    assert (a.n_points, a.n_values, a.n_empty) == (25, 81, 0) and a.least == 0.0 and abs(a.most - 1.5) < 1e-9
    assert a.png.startswith(b"\x89PNG") and (b.n_points, b.n_values, b.n_empty, b.least) == (0, 0, 81, None)


def test_document_sizes(spark, tmp_path):
    rows = spark.createDataFrame([(i, "same " * 50) for i in range(20)], "id int, text string").repartition(2)
    files.write_document(rows, f"file://{tmp_path}/sized")
    found = files.sizes(spark, f"file://{tmp_path}/sized", rows).first()
    assert found.n_files == 20 and found.n_raw == sum(len('{"id":%d,"text":"%s"}' % (i, "same " * 50)) + 1 for i in range(20)) and found.share < 1


def test_collections_on_lines(spark, tmp_path):
    """Features are numbered through all collections, past what an int times a million holds."""
    polygon = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[%d,0],[1,0],[1,1],[%d,0]]]}}'
    lines = ['{"type":"FeatureCollection","first":%d,"features":[%s,%s]}' % (k, polygon % (k, k), polygon % (k + 1, k + 1)) for k in (0, 2, 5000)]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    rows = geometry.read_mask(spark, str(tmp_path / "lines.json"), lines=True).where("seq = 0").collect()
    assert sorted((r.poly_id, r.x) for r in rows) == [(k * 1_000_000, float(k)) for k in (0, 1, 2, 3, 5000, 5001)]


def test_mask_of_many_polygons(spark, tmp_path):
    many = {"type": "FeatureCollection", "features": MASK["features"][:1] * 2_200}
    rows = geometry.read_mask(spark, put(tmp_path, "many.json", many))
    assert rows.agg({"poly_id": "max"}).first()[0] == 2_199_000_000
