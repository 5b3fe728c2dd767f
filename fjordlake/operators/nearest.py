"""Nearest observations in the plane, by an adaptive quadtree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import stage

#: Halvings of the square around all rows: cells of a ten-thousandth of it.
DEPTH = 14


def _far2(x: Column, y: Column) -> Column:
    """Square of the distance to the farthest corner of a cell's bounds."""
    dx, dy = F.greatest(x - F.col("west"), F.col("east") - x), F.greatest(y - F.col("south"), F.col("north") - y)
    return dx * dx + dy * dy


def _near2(x: Column, y: Column) -> Column:
    """Square of the distance to a cell's bounds, 0 inside."""
    dx = F.greatest(F.col("west") - x, x - F.col("east"), F.lit(0.0))
    dy = F.greatest(F.col("south") - y, y - F.col("north"), F.lit(0.0))
    return dx * dx + dy * dy


def _bounds() -> list[Column]:
    return [F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north")]


class Quadtree:
    """Distinct places of rows, in cells that are split until they hold at most ``most`` places.

    Cells are known by their depth and their column and row at that depth.
    ``cells`` has every cell that holds places, with the bounds of these;
    ``leaves`` those that are not split, with the places themselves. Both are
    tables in the shared folder. Places in a cell of the last depth stay
    together however many they are.
    """

    def __init__(self, rows: DataFrame, value: str, seq: str, by: Sequence[str] = (), most: int = 32, depth: int = DEPTH) -> None:
        self.by, self.depth = list(by), depth
        first = F.min(F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"))).alias("first")
        distinct = rows.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy(*by, F.col("lon").alias("x"), F.col("lat").alias("y")).agg(first)
        distinct = stage(distinct.select(*by, "x", "y", "first.*"), "places")
        west, east, south, north = distinct.agg(*_bounds()).first()
        self.empty = west is None
        self.west, self.south = west or 0.0, south or 0.0
        self.size = 0.0 if self.empty else max(east - west, north - south) or 1.0
        at_depth = distinct.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        at_depth = at_depth.withColumns({"cx": self.column("x", "d"), "cy": self.row("y", "d")})
        counted = at_depth.groupBy(*by, "d", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), *_bounds())
        self.cells = stage(counted, "cells")
        parents = self.cells.select(*[F.col(c).alias(f"p_{c}") for c in by], *[F.col(c).alias(f"p_{c}") for c in ("d", "cx", "cy", "n")])
        up = (F.col("p_d") == F.col("d") - 1) & (F.col("p_cx") == F.floor(F.col("cx") / 2)) & (F.col("p_cy") == F.floor(F.col("cy") / 2))
        for c in by:
            up = up & F.col(c).eqNullSafe(F.col(f"p_{c}"))
        ends = self.cells.where((F.col("n") <= most) | (F.col("d") == depth)).join(parents.where(F.col("p_n") > most), up, "left")
        ends = ends.where((F.col("d") == 0) | F.col("p_n").isNotNull()).drop(*parents.columns)
        key = [*by, "d", "cx", "cy"]
        held = at_depth.join(ends.select(*key), self.same(at_depth, ends, key), "left_semi")
        held = held.groupBy(*key).agg(F.collect_list(F.struct("x", "y", "seq", "value")).alias("places"), *_bounds())
        self.leaves = stage(held, "leaves")

    @staticmethod
    def same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & a[c].eqNullSafe(b[c])
        return out

    def _index(self, at: Column, start: float, d: Column) -> Column:
        cells = F.pow(F.lit(2), d)
        return F.least(F.greatest(F.floor((at - F.lit(start)) / F.lit(self.size) * cells), F.lit(0)), cells - 1).cast("int")

    def column(self, x: str | Column, d: str | Column) -> Column:
        return self._index(F.col(x) if isinstance(x, str) else x, self.west, F.col(d) if isinstance(d, str) else d)

    def row(self, y: str | Column, d: str | Column) -> Column:
        return self._index(F.col(y) if isinstance(y, str) else y, self.south, F.col(d) if isinstance(d, str) else d)

    def bounded(self, asked: DataFrame) -> DataFrame:
        """Asked places ``k, x, y`` with ``reach``, no less than the distance of the nearest place: one join.

        The places in a cell around it are no farther than the farthest
        corner of their bounds, and one cell at least is around each place.
        """
        probes = asked.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(self.depth))))
        probes = probes.withColumns({"cx": self.column("x", "d"), "cy": self.row("y", "d")})
        met = probes.join(self.cells, [*self.by, "d", "cx", "cy"])
        reach = F.sqrt(F.min(_far2(F.col("x"), F.col("y")))) * (1 + 1e-9) + 1e-12
        return met.groupBy("k", *self.by).agg(F.first("x").alias("x"), F.first("y").alias("y"), reach.alias("reach"))

    def probed(self, bounded: DataFrame) -> DataFrame:
        """The leaves within reach of each place: one join.

        A place looks at the depth whose cells are about as wide as its
        reach, so at nine cells at most. Leaves that are as deep or deeper are
        listed under all cells around them, shallower ones under themselves.
        """
        level = F.floor(F.log2(F.lit(self.size) / F.col("reach")))
        level = F.least(F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)), F.lit(self.depth)).cast("int")
        looks = bounded.withColumn("d", level)
        spans = {
            c: F.sequence(index(F.col(at) - F.col("reach"), "d"), index(F.col(at) + F.col("reach"), "d"))
            for c, index, at in (("cx", self.column, "x"), ("cy", self.row, "y"))
        }
        looks = looks.withColumn("cx", F.explode(spans["cx"])).withColumn("cy", F.explode(spans["cy"])).withColumn("whole", F.lit(False))
        above = looks.where("d > 0").withColumn("up", F.explode(F.sequence(F.lit(1), F.col("d"))))
        half = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("up"))).cast("int")
        above = above.select("k", *self.by, "x", "y", "reach", (F.col("d") - F.col("up")).alias("d"), half("cx").alias("cx"), half("cy").alias("cy"), F.lit(True).alias("whole"))
        columns = ["k", *self.by, "x", "y", "reach", "d", "cx", "cy", "whole"]
        probes = looks.select(columns).unionByName(above.distinct())
        listed = self.leaves.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("d"))))
        listed = listed.select(
            *self.by, (F.col("d") - F.col("up")).alias("d"), half("cx").alias("cx"), half("cy").alias("cy"), "places", "west", "east", "south", "north",
            F.explode(F.when(F.col("up") == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("whole"),
        )
        met = probes.join(listed, [*self.by, "d", "cx", "cy", "whole"])
        return met.where(_near2(F.col("x"), F.col("y")) <= F.col("reach") * F.col("reach"))


def nearest(places: DataFrame, rows: DataFrame, key: str, value: str, seq: str, by: Sequence[str] = (), most: int = 32) -> DataFrame:
    """Each place with ``value`` and ``dist2`` of the row nearest in the plane, the first by ``seq`` of equals.

    With ``by``, columns of both sides without nulls, rows of a place's own
    group alone count, and a place is known by ``key`` and group. Rows are
    reduced to distinct places and put in a :class:`Quadtree`; a first join
    bounds the distance, a second one meets the cells within it, whatever the
    spread. Places without rows in their group are left out.
    """
    tree = Quadtree(rows, value, seq, by, most)
    if tree.empty:
        return places.limit(0).withColumns({value: F.lit(None).cast(rows.schema[value].dataType), "dist2": F.lit(None).cast("double")})
    asked = places.select(F.col(key).alias("k"), *by, F.col("lon").alias("x"), F.col("lat").alias("y"))
    met = tree.probed(tree.bounded(asked))
    away = lambda p: (p["x"] - F.col("x")) * (p["x"] - F.col("x")) + (p["y"] - F.col("y")) * (p["y"] - F.col("y"))
    best = F.array_min(F.transform("places", lambda p: F.struct(away(p).alias("d"), p["seq"].alias("seq"), p["value"].alias("value"))))
    found = met.groupBy("k", *by).agg(F.min(best).alias("b")).select(F.col("k").alias(key), *by, F.col("b.value").alias(value), F.col("b.d").alias("dist2"))
    return places.join(found, [key, *by]).select(*places.columns, value, "dist2")


def box_edge(groups: DataFrame, n: int, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> DataFrame:
    """For each row of ``groups`` ``n`` points on each side of a box with its corners, which come twice."""
    share = F.col("k") / F.lit(n - 1)
    lon, lat = F.lit(lon_min) + share * F.lit(lon_max - lon_min), F.lit(lat_min) + share * F.lit(lat_max - lat_min)
    sides = F.when(F.col("side") == 0, F.struct(lon.alias("lon"), F.lit(lat_min).alias("lat")))
    sides = sides.when(F.col("side") == 1, F.struct(lon.alias("lon"), F.lit(lat_max).alias("lat")))
    sides = sides.when(F.col("side") == 2, F.struct(F.lit(lon_min).alias("lon"), lat.alias("lat")))
    sides = sides.otherwise(F.struct(F.lit(lon_max).alias("lon"), lat.alias("lat")))
    rows = groups.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(4 * n - 1)))).withColumns({"side": F.floor(F.col("id") / n), "k": F.col("id") % n})
    return rows.withColumn("p", sides).select(*groups.columns, "id", "p.lon", "p.lat")
