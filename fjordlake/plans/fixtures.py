"""Constant inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rings of a made-up water mask: polygon, ring, corners in order (closed). The second ring of 1 is a hole; 1 and 2 overlap.
RINGS = [
    (1, 0, [(10.5, 55.0), (14.0, 55.0), (14.0, 58.0), (10.5, 58.0), (10.5, 55.0)]),
    (1, 1, [(11.5, 56.0), (12.5, 56.0), (12.5, 57.0), (11.5, 57.0), (11.5, 56.0)]),
    (2, 0, [(13.0, 57.0), (16.4, 57.5), (15.0, 59.4), (13.0, 57.0)]),
    (3, 0, [(14.5, 55.0), (16.5, 55.0), (16.5, 56.5), (15.5, 55.5), (14.5, 56.5), (14.5, 55.0)]),
]
#: Corners of the polygons around points of the events, in units of their half width and half height.
OUTER = [(-1.0, -0.5), (-0.5, -1.0), (0.5, -1.0), (1.0, -0.5), (1.0, 0.5), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.5), (-1.0, -0.5)]
HOLE = [(-0.25, 0.0), (0.0, -0.25), (0.25, 0.0), (0.0, 0.25), (-0.25, 0.0)]
DAY = "2024-01-05"
BASE = "2024-01-15 00:00:00"
#: Place, tolerance and radius of the searches.
LAT, LON, TOLERANCE, RADIUS = 55.5344, 12.7036, 0.6, 1.5


def ring_points(spark: SparkSession) -> DataFrame:
    rows = [(p, r, i, x, y) for p, r, corners in RINGS for i, (x, y) in enumerate(corners)]
    return spark.createDataFrame(rows, "poly_id bigint, ring_id int, seq int, x double, y double")


def event_rings(rows: DataFrame) -> DataFrame:
    """A polygon around each point of the observations: eight corners by its numbers of rows, and for some a hole."""
    sized = rows.groupBy("point_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("m"))
    sized = sized.withColumns({"hx": 0.1 + F.col("n") % 5 * 0.1, "hy": 0.1 + F.col("m") % 4 * 0.08})

    def ring(number: int, corners: list[tuple[float, float]]) -> Column:
        place = [F.struct((F.col("lon") + x * F.col("hx")).alias("x"), (F.col("lat") + y * F.col("hy")).alias("y")) for x, y in corners]
        return F.struct(F.lit(number).alias("ring_id"), F.array(*place).alias("corners"))

    rings = F.when(F.col("n") % 3 == 0, F.array(ring(0, OUTER), ring(1, HOLE))).otherwise(F.array(ring(0, OUTER)))
    parts = sized.select(F.col("point_id").alias("poly_id"), F.inline(rings))
    return parts.select("poly_id", "ring_id", F.posexplode("corners").alias("seq", "p")).select("poly_id", "ring_id", "seq", "p.x", "p.y")
