"""Forecast documents: points with their series, as nested JSON (also gzipped), to and from the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AREA_SCHEMA = (
    "metadata struct<collection:string,pointCollection:string,parameters:array<string>,bbox:string,fetchedAt:string,"
    "format:string,timestamps:array<string>,gridPoints:bigint,pointSpecificPoints:bigint,totalPoints:bigint>,"
    "points array<struct<lat:double,lon:double,name:string,isPointSpecific:boolean,"
    "data:array<struct<time:string,current:struct<u:double,v:double>,temperature:double,salinity:double>>>>"
)
GRID_SCHEMA = "lat double, lon double, vectors array<struct<u:double,v:double,time:string>>"


def read_area(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; a malformed one fails the read. Write the result of :func:`long_table` to Parquet once."""
    return spark.read.schema(AREA_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def long_table(area: DataFrame) -> DataFrame:
    """Observations of documents; ``seq`` keeps the order of a point's series."""
    points = area.select(F.posexplode("points").alias("point_id", "p"))
    rows = points.select("point_id", "p.lat", "p.lon", "p.name", "p.isPointSpecific", F.posexplode_outer("p.data").alias("seq", "d"))
    return rows.select(
        "point_id", "lat", "lon", "name", F.coalesce("isPointSpecific", F.lit(False)).alias("is_point_specific"), "seq",
        F.col("d.time").alias("time_str"), F.to_timestamp("d.time").alias("ts"),
        F.col("d.current.u").alias("u"), F.col("d.current.v").alias("v"),
        F.col("d.temperature").alias("temperature"), F.col("d.salinity").alias("salinity"),
    )


def document(rows: DataFrame, *more: str) -> DataFrame:
    """The nested points of a long table, each series in order of time, and columns ``more`` that a point has."""
    entry = F.struct(
        F.col("time_str").alias("time"),
        F.when(F.col("u").isNotNull() | F.col("v").isNotNull(), F.struct("u", "v")).alias("current"), "temperature", "salinity",
    )
    grouped = rows.groupBy("point_id", "lat", "lon", "name", "is_point_specific").agg(F.sort_array(F.collect_list(entry)).alias("data"))
    return grouped.select(*more, "lat", "lon", "name", F.col("is_point_specific").alias("isPointSpecific"), "data")


def with_metadata(points: DataFrame, doc: str, parameters: list[str]) -> DataFrame:
    """One document ``metadata, points`` for each value of ``doc``, which should hold few points."""
    nested = F.sort_array(F.collect_list(F.struct("lat", "lon", "name", "isPointSpecific", "data")))
    counts = F.struct(
        F.array(*[F.lit(p) for p in parameters]).alias("parameters"),
        F.count_if(~F.col("isPointSpecific")).alias("gridPoints"), F.count_if("isPointSpecific").alias("pointSpecificPoints"),
        F.count(F.lit(1)).alias("totalPoints"),
    )
    return points.groupBy(doc).agg(counts.alias("metadata"), nested.alias("points")).drop(doc)


def legacy_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRID_SCHEMA).option("multiLine", True).json(path)


def all_valid(vectors: Column) -> Column:
    """Whether no entry lacks a component; true for none."""
    return F.forall(vectors, lambda x: x["u"].isNotNull() & x["v"].isNotNull())


def any_valid(entries: Column) -> Column:
    return F.exists(entries, lambda x: x["temperature"].isNotNull() | x["current"].isNotNull() | x["salinity"].isNotNull())
