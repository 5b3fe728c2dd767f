"""Polygons of GeoJSON as edges, and lattices of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"
MASK_SCHEMA = "type string, first bigint, features array<struct<type:string,geometry:string>>"


def read_mask(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Polygons of a feature collection as ``poly_id, ring_id, seq, x, y``; other geometries are ignored.

    A large collection is many, one on each of the ``lines``; ``first`` is
    the number of a collection's first feature, 0 where it is not there.
    """
    features = spark.read.schema(MASK_SCHEMA).option("multiLine", not lines).json(path)
    number = F.coalesce("first", F.lit(0)).cast("bigint") + F.col("at")
    shape = features.select("first", F.posexplode("features").alias("at", "f")).select(number.alias("feature"), F.col("f.geometry").alias("g"))
    kind = F.get_json_object("g", "$.type")
    raw = F.get_json_object("g", "$.coordinates")
    one = shape.where(kind == "Polygon").select("feature", F.lit(0).alias("part"), F.from_json(raw, _POLYGON).alias("rings"))
    many = shape.where(kind == "MultiPolygon").select("feature", F.posexplode(F.from_json(raw, _MULTI)).alias("part", "rings"))
    rings = one.unionByName(many).select("feature", "part", F.posexplode("rings").alias("ring_id", "ring"))
    points = rings.select("feature", "part", "ring_id", F.posexplode("ring").alias("seq", "xy"))
    poly = (F.col("feature") * 1_000_000 + F.col("part")).cast("bigint").alias("poly_id")
    return points.select(poly, "ring_id", "seq", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def edges(points: DataFrame) -> DataFrame:
    """Edges ``poly_id, ring_id, x1, y1, x2, y2`` of closed rings."""
    order = Window.partitionBy("poly_id", "ring_id").orderBy("seq")
    rows = points.select(
        "poly_id", "ring_id", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2"),
    )
    return rows.where("x2 IS NOT NULL")


def lattice(groups: DataFrame, n: int, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> DataFrame:
    """For each row of ``groups`` an n by n lattice with its ends: ``i`` counts rows of latitude from below, ``j`` columns."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = groups.withColumn("i", axis).withColumn("j", axis)
    lat = F.lit(lat_min) + F.col("i") * F.lit(lat_max - lat_min) / F.lit(n - 1)
    lon = F.lit(lon_min) + F.col("j") * F.lit(lon_max - lon_min) / F.lit(n - 1)
    return cells.select("*", lat.alias("lat"), lon.alias("lon"))


def stepped(start: float, stop: float, step: float) -> list[float]:
    """Repeated sums of a step up to an end, with the drift of repeated sums."""
    out, x = [], start
    while x <= stop:
        out.append(x)
        x += step
    return out


def stepped_lattice(spark: SparkSession, lons: tuple[float, float], lats: tuple[float, float], step: float) -> DataFrame:
    """Lattice points ``i, j, lat, lon``, rounded to 4 places, in order of latitude and then longitude."""
    ys = spark.createDataFrame(list(enumerate(stepped(*lats, step))), "i int, y double")
    xs = spark.createDataFrame(list(enumerate(stepped(*lons, step))), "j int, x double")
    return ys.crossJoin(F.broadcast(xs)).select("i", "j", F.round("y", 4).alias("lat"), F.round("x", 4).alias("lon"))
