"""The typed scan of coverages, over documents in a folder."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fjordlake.sources.coverages import Coverages, Request, _FilteredReader, _Reader

TIMES = ["2025-06-29T12:00:00.000Z", "2025-06-29T13:00:00.000Z"]


def cube(**ranges):
    axes = {"t": {"values": TIMES}, "y": {"start": 55.0, "stop": 57.0, "num": 3}, "x": {"values": [10.0, 11.0]}}
    return {"domain": {"domainType": "Grid", "axes": axes}, "ranges": {k: {"values": v} for k, v in ranges.items()}}


@pytest.fixture
def scan(spark, tmp_path):
    spark.dataSource.register(Coverages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def put(name, *documents):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "part-0.json").write_text("\n".join(map(json.dumps, documents)))

    put("cube/u+v", cube(u=list(range(12)), v=[None, *range(11)]))
    put("cube/t", cube(t=[float(i) for i in range(12)]))
    put("cube/bad", cube(bad=[1.0]))
    series = {"domain": {"axes": {"t": {"values": TIMES}}}, "ranges": {"u": {"values": [1, None]}, "v": {"values": [3, 4]}}}
    put("position/Öresund Nord", series)
    put("position/Short", {**series, "ranges": {"u": {"values": [1]}}})
    yield lambda **o: spark.read.format("coverages").options(base=f"file://{tmp_path}", **o).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_partition_for_each_batch(scan):
    rows = scan(parameters="u\nv\nt", pushdown="true")
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 36
    one = rows.where(f"parameter = 'u' AND time_str = '{TIMES[1]}' AND lat = 55.0 AND lon = 11.0").collect()
    assert [r.value for r in one] == [7.0]
    assert rows.where("value IS NULL").count() == 1


def test_filters_leave_requests_out(scan):
    rows = scan(parameters="u\nv\nt", pushdown="true")
    only = rows.where(F.col("parameter") == "t")
    assert only.rdd.getNumPartitions() == 1 and only.count() == 12
    assert "parameter#" in (plan := only._jdf.queryExecution().executedPlan().toString()) and "= t" not in plan  # the source has taken it
    assert rows.where("place = 'x'").count() == 0
    boxed = scan(parameters="t", box="10,55,11,57", pushdown="true")
    assert boxed.where("lat >= 56 AND lon <= 10.5").count() == 4 and boxed.where("lat >= 60").count() == 0


def test_the_box_of_a_request_is_narrowed():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThanOrEqual

    options = {"base": "https://h/collections/c", "parameters": "a\nb\nc", "box": "10,54,17,60", "extra": "crs=crs84"}
    reader = _FilteredReader(options)
    list(reader.pushFilters([GreaterThanOrEqual(("lat",), 56.0), LessThanOrEqual(("lon",), 12.0), In(("parameter",), ("c", "z"))]))
    assert reader.partitions() == [Request("cube", ["c"], box=[10.0, 56.0, 12.0, 60.0])]
    assert reader.location(reader.partitions()[0]) == "https://h/collections/c/cube?bbox=10.0%2C56.0%2C12.0%2C60.0&parameter-name=c&crs=crs84"
    places = _FilteredReader({"base": "https://h/c", "kind": "position", "parameters": "a", "places": "Big Belt 55.3 11.0\nSmall 56.0 12.5"})
    list(places.pushFilters([EqualTo(("place",), "Big Belt")]))
    assert [p.place for p in places.partitions()] == ["Big Belt"]
    assert _Reader({"base": "b", "parameters": "a\nb\nc", "batchSize": "1"}).partitions() == [Request("cube", [p]) for p in "abc"]
    assert places.location(places.partitions()[0]) == "https://h/c/position?coords=POINT%2811.0+55.3%29&parameter-name=a"


def test_skip_and_strict(scan):
    assert scan(parameters="u\nv\nbad\nnone", batchSize="1", mode="skip").count() == 0  # no folder of that name
    assert scan(parameters="u\nv\nbad", mode="skip").count() == 24
    for options in ({"parameters": "bad"}, {"parameters": "none"}):
        with pytest.raises(PySparkException):
            scan(**options).count()
    places = {"kind": "position", "parameters": "u\nv", "places": "Öresund Nord 56.0 12.6\nShort 55.0 12.0\nNone 55.0 12.0"}
    rows = scan(mode="skip", **places).collect()
    assert sorted((r.parameter, r.place, r.lat, r.value or 0.0) for r in rows) == [("u", "Öresund Nord", 56.0, 0.0), ("u", "Öresund Nord", 56.0, 1.0), ("v", "Öresund Nord", 56.0, 3.0), ("v", "Öresund Nord", 56.0, 4.0)]
    with pytest.raises(PySparkException):
        scan(**places).count()
