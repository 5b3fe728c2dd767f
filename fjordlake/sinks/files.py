"""JSON documents, GeoJSON features, raster metadata, and what is left to write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RAMPS, parameter


def write_document(rows: DataFrame, path: str) -> None:
    """A gzipped JSON document a file for each row; documents are small, tables go to Parquet."""
    rows.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 1).json(path)


def write_pictures(pictures: DataFrame, path: str, name: str = "name") -> None:
    """Pictures as a table of names and bytes, which any store can take."""
    pictures.select(F.col(name).alias("name"), "png").write.mode("overwrite").parquet(path)


def features(rows: DataFrame, *properties: str) -> DataFrame:
    """A GeoJSON feature per row of ``lon, lat``, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    shape = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(*[c for c in rows.columns], F.to_json(shape).alias("feature"))


def feature_collections(rows: DataFrame, by: list[str], order: str, *properties: str) -> DataFrame:
    """A GeoJSON collection for each group of rows of ``lon, lat``: one nested row, in order, as a document of a map."""
    shape = F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, shape.alias("feature")))), lambda e: e["feature"])
    return rows.groupBy(*by).agg(listed.alias("features")).select(*by, F.lit("FeatureCollection").alias("type"), "features")


def raster_metadata(spark: SparkSession, name: str, timestamps: list[str], written: int, box: list[float], resolution: int, now: str) -> DataFrame:
    """The one-row metadata of a parameter's rasters: it lists all timestamps, also those without a raster."""
    unit, native, _, _ = parameter(name)
    ramp = [[str(v), c] for v, c in RAMPS[name]]
    kinds = (
        "parameter string, parameter_name string, unit string, bbox array<double>, total_images int, timestamps array<string>,"
        "colormap array<array<string>>, resolution int, generated_at string"
    )
    return spark.createDataFrame([(name, native, unit, box, written, timestamps, ramp, resolution, now)], kinds)


def missing(wanted: DataFrame, there: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What is not there yet; everything if forced."""
    return wanted if force else wanted.join(there.select(key).distinct(), key, "left_anti")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only for a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='fjordlake-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sizes(spark: SparkSession, path: str, raw: DataFrame) -> DataFrame:
    """Files and bytes of a written document, the bytes its rows have as JSON text, and the share that is left."""
    files = spark.read.format("binaryFile").load(path).select("length").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    text = raw.select(F.octet_length(F.to_json(F.struct(*raw.columns))).cast("long").alias("n")).agg(F.sum(F.col("n") + 1).alias("n_raw"))
    return files.crossJoin(text).withColumn("share", F.col("n_bytes") / F.col("n_raw"))
