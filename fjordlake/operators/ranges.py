"""Rows in sorted ranges: written once, so that places, carries and chunks of a range stay what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.files import shared_path


def stage(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which cuts their lineage."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def sorted_ranges(rows: DataFrame, *order: str, name: str = "ranges") -> DataFrame:
    """The rows with ``__range``, the number of their range of ``order``, and ``__at``, which ascends through all ranges."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return stage(ordered.withColumn("__at", at).withColumn("__range", F.shiftright("__at", 33)), name)


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """The rows with their place, from 0, in the order of all; rows that are equal in it are in any order.

    Each range counts for itself; what stands before a range comes from a
    table of one row for each, which is all that a single task sees.
    """
    placed = sorted_ranges(rows, *order, name="numbered")
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    found = placed.join(F.broadcast(starts), "__range")  # as many rows as ranges
    return found.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before")).select(*rows.columns, name)
