"""Gaps of a lattice filled from their edges inwards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import nearest
from .ranges import stage


def _steps(straight: bool) -> Column:
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and not (straight and a and b)]
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around])


def _moved(cells: DataFrame, names: list[str], straight: bool) -> DataFrame:
    """A row for each cell around each cell, with the cell's other columns."""
    moved = cells.withColumn("step", F.explode(_steps(straight)))
    return moved.withColumns({"i": F.col("i") + F.col("step.a"), "j": F.col("j") + F.col("step.b")}).select(names)


def dilate(cells: DataFrame, value: str, by: Sequence[str] = (), sweeps: int = 20) -> DataFrame:
    """Cells ``i, j, lat, lon`` of lattices with their empty values filled, and ``sweep``: 0 for a value that was there.

    In a sweep each empty cell that shares a side with a full one gets the
    mean of the full ones among the eight around it. Only cells beside those
    that the last sweep filled are looked at, so work falls with the front.
    What is empty after ``sweeps``, or cannot be reached, takes the nearest
    value of its lattice (``sweep`` is null), or stays empty if that has
    none. Values of a sweep are those before it, so no order of cells counts.
    ``by`` names the columns, without nulls, that tell lattices apart.
    """
    place = [*by, "i", "j"]
    start = stage(cells.select(*place, "lat", "lon", value), "dilate")
    full = start.where(F.col(value).isNotNull()).select(*place, value, F.lit(0).alias("sweep"))
    empty = start.where(F.col(value).isNull()).select(*place)
    done, front = [full], full
    for sweep in range(1, sweeps + 1):
        known = reduce(DataFrame.unionByName, done)
        beside = _moved(front, place, True).distinct().join(empty, place, "left_semi").join(known.select(place), place, "left_anti")
        asked = beside.withColumns({"to_i": F.col("i"), "to_j": F.col("j")})
        met = _moved(asked, [*place, "to_i", "to_j"], False).join(known.select(*place, value), place)
        means = met.groupBy(*by, F.col("to_i").alias("i"), F.col("to_j").alias("j")).agg(F.avg(value).alias(value))
        front = stage(means.withColumn("sweep", F.lit(sweep)), "sweep")
        if front.isEmpty():
            break
        done.append(front)
    known = stage(reduce(DataFrame.unionByName, done), "dilated")
    out = start.drop(value).join(known, place, "left")
    rest = out.where("sweep IS NULL").select(*place, "lat", "lon")
    if rest.isEmpty():
        return out
    values = start.where(F.col(value).isNotNull()).withColumn("seq", F.struct("i", "j"))
    numbered = rest.withColumn("cell", F.struct("i", "j"))
    found = nearest(numbered, values, "cell", value, "seq", by).select(*place, F.col(value).alias("far"))
    return out.join(found, place, "left").withColumn(value, F.coalesce(value, "far")).drop("far")
