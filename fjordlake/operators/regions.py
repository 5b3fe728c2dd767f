"""Regions with display offsets, and the snapping of hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REGIONS
from .asof import nearest_asof

_BOUNDS = ["lon_min", "lon_max", "lat_min", "lat_max"]


def regions(spark: SparkSession) -> DataFrame:
    """All regions in their order, with area and centre."""
    rows = [(i, *r) for i, r in enumerate(REGIONS)]
    frame = spark.createDataFrame(rows, "idx int, region string, " + ", ".join(f"{b} double" for b in _BOUNDS) + ", lat_offset double, lon_offset double")
    return frame.withColumns(
        {
            "area": (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min")),
            "centre_lon": (F.col("lon_min") + F.col("lon_max")) / 2,
            "centre_lat": (F.col("lat_min") + F.col("lat_max")) / 2,
        }
    )


def region_of(lon: Column, lat: Column) -> Column:
    """Struct ``region, lat_offset, lon_offset`` of the smallest region around a place, the first of equals.

    The regions are few and fixed, so the lookup is an expression over them,
    smallest first, and no join. A place outside all has the last region.
    """
    ranked = sorted(enumerate(REGIONS), key=lambda r: ((r[1][2] - r[1][1]) * (r[1][4] - r[1][3]), r[0]))
    as_struct = lambda r: F.struct(F.lit(r[0]).alias("region"), F.lit(r[5]).alias("lat_offset"), F.lit(r[6]).alias("lon_offset"))
    out = as_struct(REGIONS[-1])
    for _, r in reversed(ranked):
        out = F.when(lon.between(r[1], r[2]) & lat.between(r[3], r[4]), as_struct(r)).otherwise(out)
    return out


def region_of_box(west: Column, east: Column, south: Column, north: Column) -> Column:
    """The region of a box, which is that of its centre."""
    return region_of((west + east) / 2, (south + north) / 2)


def offsets_named(name: Column) -> Column:
    """Struct ``lat_offset, lon_offset`` of the region of a name; null for other names."""
    named = F.map_from_entries(
        F.array(*[F.struct(F.lit(r[0]).alias("k"), F.struct(F.lit(r[5]).alias("lat_offset"), F.lit(r[6]).alias("lon_offset")).alias("v")) for r in REGIONS])
    )
    return named[name]


def corners(lat_offset: Column, lon_offset: Column, box: Sequence[float | Column]) -> Column:
    """Corners of an overlay of a box (west, east, south, north), clockwise from the top left, as ``lon, lat`` structs."""
    west, east, south, north = (x if isinstance(x, Column) else F.lit(x) for x in box)
    place = lambda x, y: F.struct((x + lon_offset).alias("lon"), (y + lat_offset).alias("lat"))
    return F.array(place(west, north), place(east, north), place(east, south), place(west, south))


def nearest_hours(targets: DataFrame, available: DataFrame) -> DataFrame:
    """``target, nearest`` of each distinct target: of the available hours (a column ``hour``) the nearest, the earlier of two as near."""
    return nearest_asof(targets, available.select(F.col("hour").alias("target")), "target")
