"""Searches around a place, and how well a box is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def within_box(rows: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> DataFrame:
    return rows.where(F.col("lon").between(lon_min, lon_max) & F.col("lat").between(lat_min, lat_max))


def nearest_points(points: DataFrame, lat: float, lon: float, tolerance: float, best: int = 3, fallback: int = 5, first: int = 100) -> DataFrame:
    """The nearest points of a box around a place; without any, the nearest of the first ``first`` points by ``seq``."""
    away = points.withColumn("dist", V.planar(F.col("lat") - F.lit(lat), F.col("lon") - F.lit(lon)))
    inside = away.where((F.abs(F.col("lat") - F.lit(lat)) <= tolerance) & (F.abs(F.col("lon") - F.lit(lon)) <= tolerance))
    hits = inside.orderBy("dist", "seq").limit(best).withColumn("in_box", F.lit(True))
    none = inside.agg(F.count(F.lit(1)).alias("c")).where("c = 0").drop("c")
    others = away.orderBy("seq").limit(first).join(F.broadcast(none), how="cross").orderBy("dist", "seq").limit(fallback)
    return hits.unionByName(others.withColumn("in_box", F.lit(False)))


def radius_stats(rows: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Number and least and greatest speed in knots within a radius in degrees."""
    near = rows.where(V.planar(F.col("lat") - F.lit(lat), F.col("lon") - F.lit(lon)) <= radius)
    speed = V.knots(V.magnitude(F.col("u"), F.col("v")))
    return near.agg(F.count(F.lit(1)).alias("n"), F.min(speed).alias("min_knots"), F.max(speed).alias("max_knots"))


def coverage_counts(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows have each parameter; zero and null both count as missing in ``nonzero_temperature``."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("u").isNotNull() & F.col("v").isNotNull()).alias("n_current"),
        F.count("temperature").alias("n_temperature"),
        F.count("salinity").alias("n_salinity"),
        F.count_if(F.col("temperature").isNotNull() & (F.col("temperature") != 0)).alias("nonzero_temperature"),
    )


def box_gaps(rows: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> DataFrame:
    """Gap between the data and each side of a box, in degrees and kilometres."""
    bounds = rows.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    gaps = {
        "west": F.col("w") - F.lit(lon_min), "east": F.lit(lon_max) - F.col("e"),
        "south": F.col("s") - F.lit(lat_min), "north": F.lit(lat_max) - F.col("n"),
    }
    return bounds.select(*[g.alias(k) for k, g in gaps.items()], *[V.kilometres(g).alias(f"{k}_km") for k, g in gaps.items()])


def expand_all(wanted: list[str], every: list[str]) -> list[str]:
    """The wanted names; ``all`` stands for every one."""
    return list(every) if "all" in wanted else list(wanted)


def is_wanted(name: Column, wanted: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in wanted]), name)


def first_times(times: DataFrame, column: str, most: int) -> DataFrame:
    """The first ``most`` rows of a time axis; all for 0."""
    return times.orderBy(column).limit(most) if most else times
