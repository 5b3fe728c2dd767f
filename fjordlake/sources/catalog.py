"""Catalogues of collections and metadata of rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = (
    "collections array<struct<id:string,title:string,extent:struct<spatial:struct<bbox:array<array<double>>>>,"
    "parameter_names:map<string,string>,links:array<struct<rel:string,href:string>>>>, instances array<struct<id:string>>"
)
META_SCHEMA = (
    "parameter string, parameter_name string, unit string, bbox array<double>, total_images int, timestamps array<string>,"
    "colormap array<array<string>>, resolution int, generated_at string"
)


def collections(spark: SparkSession, path: str, text: str = "", parameters: int = 5) -> DataFrame:
    """Collections whose id has ``text`` in any case: id, title, first parameters, addresses without their query."""
    raw = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    rows = raw.select(F.explode("collections").alias("c")).where(F.lower("c.id").contains(text.lower()))
    return rows.select(
        "c.id", "c.title", F.slice(F.map_keys("c.parameter_names"), 1, parameters).alias("parameters"),
        F.transform("c.links", lambda x: F.split(x["href"], r"\?")[0]).alias("addresses"),
    )


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the instances that a collection's document lists, in order."""
    raw = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.posexplode("instances").alias("seq", "i")).select("seq", "i.id")


def raster_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META_SCHEMA).option("multiLine", True).json(path)


def image_for_hour(metadata: DataFrame, prefix: str) -> DataFrame:
    """The first timestamp of each raster's list that begins with an hour's prefix; null without one."""
    hits = F.filter("timestamps", lambda t: t.startswith(prefix))
    return metadata.select("parameter", F.get(hits, F.lit(0)).alias("timestamp"))


def images_for_hours(metadata: DataFrame, asked: DataFrame, hour: str = "hour") -> DataFrame:
    """For each parameter of the metadata and each asked hour (``yyyy-MM-ddTHH``) the first listed time that begins with it, or null.

    An hour is 13 characters, so listed times meet it by equality.
    """
    listed = metadata.select("parameter", F.explode("timestamps").alias("timestamp"))
    first = listed.groupBy("parameter", F.substring("timestamp", 1, 13).alias(hour)).agg(F.min("timestamp").alias("timestamp"))
    names = metadata.agg(F.collect_set("parameter").alias("names"))  # one row of a few names
    wanted = asked.select(hour).distinct().join(F.broadcast(names)).select(hour, F.explode("names").alias("parameter"))
    return wanted.join(first, ["parameter", hour], "left").select("parameter", hour, "timestamp")
