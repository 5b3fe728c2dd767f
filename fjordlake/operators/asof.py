"""Nearest rows along one axis: an as-of join by a sorted union of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import sorted_ranges


def nearest_asof(
    targets: DataFrame, available: DataFrame, on: str, by: Sequence[str] = (), values: Sequence[str] = (), direction: str = "nearest"
) -> DataFrame:
    """For each distinct ``by, on`` of the targets the nearest available row: ``nearest`` and its ``values``.

    ``direction`` is ``nearest`` (the earlier of two as near), ``backward``
    (the last at or before) or ``forward``. Of available rows with equal
    ``by, on`` the one with the smallest values counts. Targets without an
    available row in their group have nulls; null ``on`` of targets too.

    Both sides become one table of distinct keys, cut into sorted ranges. In
    a range a window finds the last and the first available row; what lies
    beyond its ends comes from a table of one row for each range and group.
    """
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"no direction {direction}")
    found = F.struct(F.col(on).alias("on"), *values)
    known = available.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.min(found).alias("a"))
    both = known.withColumn("asked", F.lit(False)).unionByName(
        targets.select(*by, on).withColumns({"a": F.lit(None).cast(known.schema["a"].dataType), "asked": F.lit(True)})
    )
    keys = both.groupBy(*by, on).agg(F.max("a").alias("a"), F.max("asked").alias("asked"))
    rows = sorted_ranges(keys, *by, on, name="asof")

    # frames that grow from their start are one pass; those that shrink to their end would be one for each row
    inside, up_to = Window.partitionBy(*by, "__range"), (Window.unboundedPreceding, 0)
    before = F.last("a", ignorenulls=True).over(inside.orderBy(on).rowsBetween(*up_to))
    after = F.last("a", ignorenulls=True).over(inside.orderBy(F.desc(on)).rowsBetween(*up_to))
    ends = rows.groupBy(*by, "__range").agg(F.max("a").alias("last"), F.min("a").alias("first"))
    ranges, before_it = Window.partitionBy(*by), (Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__of"),
        F.last("last", ignorenulls=True).over(ranges.orderBy("__range").rowsBetween(*before_it)).alias("left"),
        F.last("first", ignorenulls=True).over(ranges.orderBy(F.desc("__range")).rowsBetween(*before_it)).alias("right"),
    )
    same = F.col("__range") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    looked = rows.withColumns({"before": before, "after": after}).where("asked").join(carried, same, "left")
    before, after = F.coalesce("before", "left"), F.coalesce("after", "right")
    if direction == "nearest":
        closer = before["on"].isNotNull() & (after["on"].isNull() | (F.col(on) - before["on"] <= after["on"] - F.col(on)))
        pick = F.when(closer, before).otherwise(after)
    else:
        pick = before if direction == "backward" else after
    pick = F.when(F.col(on).isNotNull(), pick)
    return looked.select(*by, on, pick.alias("p")).select(*by, on, F.col("p.on").alias("nearest"), *[F.col(f"p.{v}") for v in values])


def asof_join(
    rows: DataFrame, available: DataFrame, on: str, by: Sequence[str] = (), values: Sequence[str] = (), direction: str = "nearest"
) -> DataFrame:
    """All rows with ``nearest`` and the values of the available row that :func:`nearest_asof` finds for them."""
    found = nearest_asof(rows, available, on, by, values, direction)
    names = [*by, on]
    renamed = found.select(*[F.col(c).alias(f"__{c}") for c in names], "nearest", *values)
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(renamed, same, "left").drop(*[f"__{c}" for c in names])
