"""Series of points: first entries, merging, grouping and removal of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered


def first_entry(rows: DataFrame, *by: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first row of each group, whatever it lacks: test its values for null afterwards."""
    columns = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("r"))
    return picked.select(*by, *[F.col(f"r.{c}").alias(c) for c in columns])


def series(rows: DataFrame, by: str, *entry: str) -> DataFrame:
    """``entries`` of each point in ascending order."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*entry))).alias("entries"))


def merge_batch(base: DataFrame, batch: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Base rows with the batch's values where it has them.

    The batch carries ``has_<value>``: a value that is there replaces the
    base's even if it is null, one that is not there leaves it. Base rows
    without a partner stay as they are.
    """
    named = batch.select(*on, *[F.col(v).alias(f"__{v}") for v in values], *[F.col(f"has_{v}").alias(f"__has_{v}") for v in values])
    joined = base.join(named, on, "left")
    new = {v: F.when(F.coalesce(f"__has_{v}", F.lit(False)), F.col(f"__{v}")).otherwise(F.col(v)) for v in values}
    return joined.withColumns(new).select(base.columns)


def dedup_points(rows: DataFrame, keys: dict[str, Column], order: tuple[str, ...], values: list[str]) -> DataFrame:
    """One row per key: the first coordinates, and of each value the last that is not null."""
    place = F.struct(*order)
    firsts = [F.min_by(c, place).alias(c) for c in ("lat", "lon")]
    lasts = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in values]
    return rows.withColumns(keys).groupBy(*keys).agg(*firsts, *lasts)


def dedup_series(rows: DataFrame, keys: dict[str, Column], time: str, order: tuple[str, ...], values: list[str]) -> DataFrame:
    """One row per key and time: the key's first coordinates, and of each value the last of that time that is not null.

    Coordinates are the first of all times of a key, so they are found by an
    aggregate over the aggregate of key and time and joined to nothing.
    """
    place = F.struct(*order)
    by_time = rows.withColumns(keys).groupBy(*keys, time).agg(
        F.min(F.struct(*order, "lat", "lon")).alias("first"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in values],
    )
    entry = F.struct(time, *values)
    points = by_time.groupBy(*keys).agg(F.min("first").alias("first"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return points.select(*keys, "first.lat", "first.lon", F.inline("entries"))


def with_control_points(rows: DataFrame, points: list[tuple[float, float, str]]) -> DataFrame:
    """Grid points and then control points; the latter have names and are marked."""
    extra = rows.sparkSession.createDataFrame(points, "lat double, lon double, name string")
    marked = rows.withColumn("is_point_specific", F.lit(False))
    return marked.unionByName(extra.withColumn("is_point_specific", F.lit(True)), allowMissingColumns=True)


def with_control_series(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Rows of grid points and then those of control points (with ``name``), marked, each with its series."""
    marked = rows.withColumn("is_point_specific", F.lit(False))
    return marked.unionByName(series.withColumn("is_point_specific", F.lit(True)), allowMissingColumns=True)


def area_counts(rows: DataFrame, place: tuple[str, ...], water: DataFrame | None = None) -> DataFrame:
    """Numbers of points, of those of the grid, of control points, of points with a value and, by a semi-join, of points in the water."""
    points = rows.groupBy("is_point_specific", *place).agg(F.max(F.col("temperature").isNotNull() | F.col("salinity").isNotNull()).alias("valid"))
    if water is not None:
        points = points.join(water.select(*place).distinct().withColumn("wet", F.lit(True)), list(place), "left")
    wet = F.count_if("wet") if water is not None else F.lit(None).cast("long")
    return points.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(~F.col("is_point_specific")).alias("n_grid"), F.count_if("is_point_specific").alias("n_control"),
        F.count_if("valid").alias("n_valid"), wet.alias("n_water"),
    )


def is_apart(lat: Column, lon: Column, points: list[tuple[float, float, str]], tolerance: float = 0.001) -> Column:
    """Whether no control point is within the tolerance in both axes. A dozen points are cheaper as an expression than a join."""
    near = F.lit(False)
    for y, x, _ in points:
        near = near | ((F.abs(lat - F.lit(y)) < tolerance) & (F.abs(lon - F.lit(x)) < tolerance))
    return ~near


def gap_sessions(rows: DataFrame, by: str, gap: str, time: str = "ts") -> DataFrame:
    """Sessions of rows that follow each other by less than a gap: their bounds, number of rows and last value."""
    session = F.session_window(time, gap)
    grouped = rows.groupBy(by, session.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"),
        F.max_by("event_id", F.struct(time, "event_id")).alias("last_event"),
    )
    return grouped.drop("w")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Numbers rows in batches of a size, in an order."""
    return numbered(rows, order, name="batch").withColumn("batch", (F.col("batch") / size).cast("int"))
