"""Rasters of nearest values as joins: edges of the box, cells, clamping, mask and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clamp_parameter
from ..sources.geometry import lattice
from .mask import inside
from .nearest import box_edge, nearest

#: Edge places come after all observations of equal distance.
_AFTER = 1_000_000_000_000


def edged(rows: DataFrame, by: Sequence[str], box: tuple[float, float, float, float], side: int = 25) -> DataFrame:
    """Rows ``by, lon, lat, value, seq`` and, on each side of the box, ``side`` places with the value of the nearest row of their group."""
    around = nearest(box_edge(rows.select(*by).distinct(), side, *box), rows, "id", "value", "seq", by)
    named = around.select(*by, "lon", "lat", "value", (F.col("id") + F.lit(_AFTER)).alias("seq"))
    return rows.select(*by, "lon", "lat", "value", "seq").unionByName(named)


def nearest_rasters(
    rows: DataFrame, by: Sequence[str], n: int, box: tuple[float, float, float, float], edges: DataFrame | None = None, side: int = 25
) -> DataFrame:
    """Cells ``by, i, j, value`` of an n by n raster of each group of rows ``parameter, lon, lat, value, seq``.

    Null values are left out, the box's edges take the nearest values first,
    each cell the nearest of all, speeds and salinities are held at 0. With
    ``edges`` of polygons cells outside all of them are left out. ``by``
    contains ``parameter``. No group is in one task.
    """
    known = rows.where("value IS NOT NULL")
    cell = F.col("i") * n + F.col("j")
    cells = lattice(known.select(*by).distinct(), n, *box).withColumn("cell", cell)
    if edges is not None:
        one = lattice(rows.sparkSession.range(1).drop("id"), n, *box).withColumn("cell", cell)
        cells = cells.join(inside(one, edges, "cell").select("cell"), "cell", "left_semi")
    found = nearest(cells, edged(known, by, box, side), "cell", "value", "seq", by)
    return found.select(*by, "i", "j", clamp_parameter(F.col("parameter"), F.col("value")).alias("value"))


def statistics(cells: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Of each raster its numbers of full and empty cells, least, most and mean value."""
    return cells.groupBy(*by).agg(
        F.count("value").alias("n_values"), (F.lit(n * n) - F.count("value")).alias("n_empty"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"),
    )
