"""Points and lattices inside polygons, from their edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import stage


def _crossing(lon: Column, lat: Column, of: Callable[[str], Column] = F.col) -> Column:
    """Whether a ray to the east of a point crosses an edge; a lower end counts and an upper one does not."""
    x1, y1, x2, y2 = (of(c) for c in ("x1", "y1", "x2", "y2"))
    meets = x1 + (lat - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
    return F.when((F.least(y1, y2) <= lat) & (lat < F.greatest(y1, y2)), (lon < meets).cast("int")).otherwise(0)


def _on_edge(lon: Column, lat: Column, of: Callable[[str], Column] = F.col) -> Column:
    x1, y1, x2, y2 = (of(c) for c in ("x1", "y1", "x2", "y2"))
    cross = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)
    return (cross == 0) & lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))


class PolygonGrid:
    """Polygons on square grids: of each cell whether it is inside a polygon or cut by its edges.

    A polygon of n edges has cells whose side is a power of two, about
    sqrt(n) along its longer side, so its rows hold few edges. ``cells`` has
    the cells that are not outside; a cut one has the edges of its row of
    cells, which are all that a ray from a point in it can cross.
    """

    def __init__(self, edges: DataFrame) -> None:
        extent = F.greatest(
            F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))
        )
        across = F.greatest(F.sqrt(F.count(F.lit(1))), F.lit(4.0))
        sides = edges.groupBy("poly_id").agg(F.ceil(F.log2(F.greatest(extent / across, F.lit(1e-6)))).cast("int").alias("k"))
        sized = edges.join(sides, "poly_id").withColumn("s", F.pow(F.lit(2.0), "k"))
        low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
        banded = sized.withColumn("iy", F.explode(F.sequence(F.floor(low / F.col("s")), F.floor(high / F.col("s")))))
        at = lambda y: F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
        flat = F.col("y1") == F.col("y2")
        a = F.when(flat, F.col("x1")).otherwise(at(F.greatest(low, F.col("iy") * F.col("s"))))
        b = F.when(flat, F.col("x2")).otherwise(at(F.least(high, (F.col("iy") + 1) * F.col("s"))))
        slack = F.col("s") * 1e-9 + 1e-12
        cut = F.struct(F.floor((F.least(a, b) - slack) / F.col("s")).alias("a"), F.floor((F.greatest(a, b) + slack) / F.col("s")).alias("b"))
        rows = banded.withColumn("cut", cut).groupBy("poly_id", "k", "s", "iy").agg(
            F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), F.collect_list("cut").alias("cuts"), F.min("cut.a").alias("a"), F.max("cut.b").alias("b")
        )
        spread = rows.withColumn("ix", F.explode(F.sequence("a", "b")))
        is_cut = F.exists("cuts", lambda c: (c["a"] <= F.col("ix")) & (F.col("ix") <= c["b"]))
        centre = self.crossings((F.col("ix") + 0.5) * F.col("s"), (F.col("iy") + 0.5) * F.col("s"))
        spread = spread.select("poly_id", "k", "ix", "iy", is_cut.alias("cut"), F.when(is_cut, True).otherwise(centre % 2 == 1).alias("held"), "edges")
        spread = spread.where("held").withColumn("edges", F.when(F.col("cut"), F.col("edges")))
        self.cells = stage(spread.drop("held"), "polygon_cells")
        self.sides = [r.k for r in self.cells.select("k").distinct().collect()]  # exponents of two: some dozens at most

    @staticmethod
    def crossings(x: Column, y: Column) -> Column:
        """How many of a row's edges a ray to the east of a place crosses."""
        return F.aggregate("edges", F.lit(0), lambda n, e: n + _crossing(x, y, lambda c: e[c]))

    def probes(self, places: DataFrame) -> DataFrame:
        """The cell of each place on each grid."""
        grids = F.array(*[F.lit(k) for k in self.sides]).cast("array<int>")
        probes = places.withColumn("k", F.explode(grids)).withColumn("s", F.pow(F.lit(2.0), "k"))
        return probes.withColumns({"ix": F.floor(F.col("lon") / F.col("s")), "iy": F.floor(F.col("lat") / F.col("s"))}).drop("s")

    @staticmethod
    def meet(probes: DataFrame, cells: DataFrame, weight: Column, most: int) -> DataFrame:
        """Probes with the polygons of their cells, in tasks of about as many pairs each.

        A cell of more than ``most`` pairs is dealt to as many parts, those of
        its side that has more rows; the other side goes to all of them.
        """
        cell = ["k", "ix", "iy"]
        held = cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("polygons"))
        load = probes.groupBy(*cell).agg(F.count(F.lit(1)).alias("places"), F.sum(weight).alias("n")).join(held, cell)
        load = stage(load.withColumn("pairs", F.col("n") * F.col("polygons")), "polygon_load")
        pairs = load.agg(F.sum("pairs")).first()[0] or 0
        hot = load.where(F.col("pairs") > most).select(*cell, F.ceil(F.col("pairs") / most).cast("int").alias("parts"), (F.col("places") > F.col("polygons")).alias("by_place"))
        hot = F.broadcast(hot)  # a row for ``most`` pairs at most
        every = F.sequence(F.lit(0), F.col("parts") - 1)

        def dealt(rows: DataFrame, by_this: Column, *key: str) -> DataFrame:
            part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(by_this, F.array(F.pmod(F.xxhash64(*key), "parts").cast("int"))).otherwise(every)
            return rows.join(hot, cell, "left").withColumn("part", F.explode(part)).drop("parts", "by_place")

        tasks = max(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // (2 * most)))
        on = [*cell, "part"]
        left = dealt(probes, F.col("by_place"), "lon", "lat").repartition(tasks, *on)
        return left.join(dealt(cells, ~F.col("by_place"), "poly_id").repartition(tasks, *on), on)

    def exact(self) -> tuple[Column, Column]:
        """Of a place and a polygon that meet: whether it is inside or on an edge, and whether it is inside and on none."""
        lon, lat = F.col("lon"), F.col("lat")
        odd = self.crossings(lon, lat) % 2 == 1
        on_edge = F.exists("edges", lambda e: _on_edge(lon, lat, lambda c: e[c]))
        return ~F.col("cut") | odd | on_edge, ~F.col("cut") | (odd & ~on_edge)

    def containing(self, points: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
        """``key, poly_id, open`` of the polygons around each point: ``open`` unless it is on an edge. Points of one place are tested once."""
        lists = F.lit(1 + points.count() // 1_000_000)
        places = points.groupBy("lon", "lat", F.pmod(F.xxhash64(key), lists).alias("list")).agg(F.collect_list(key).alias("keys")).drop("list")
        met = self.meet(self.probes(places), self.cells, F.size("keys"), most)
        closed, open_ = self.exact()
        found = met.select("keys", "poly_id", closed.alias("closed"), open_.alias("open")).where("closed")
        return found.select(F.explode("keys").alias(key), "poly_id", "open")

    def inside(self, places: DataFrame, boundary: bool, most: int = 2_000_000) -> DataFrame:
        """The places ``lon, lat`` with a polygon around them. Those of a cell that is inside a polygon meet no edges."""
        cell = ["k", "ix", "iy"]
        probes = stage(self.probes(places), "polygon_probes")
        whole = probes.join(self.cells.where("NOT cut").select(*cell).distinct(), cell, "left_semi").select("lon", "lat").distinct()
        rest = stage(probes.join(whole, ["lon", "lat"], "left_anti"), "polygon_rest")
        met = self.meet(rest, self.cells.where("cut"), F.lit(1), most)
        closed, open_ = self.exact()
        return whole.unionByName(met.where(closed if boundary else open_).select("lon", "lat").distinct())


def containing(points: DataFrame, edges: DataFrame, key: str, boundary: bool = False) -> DataFrame:
    """``key, poly_id`` of each polygon around each point, counted by the parity of crossings.

    Each polygon counts for itself, so overlaps do not cancel and holes do
    work. Points on an edge are inside if ``boundary`` says so. Points meet
    cells of a :class:`PolygonGrid` by equality, and only those in cut cells
    the edges of their row; keys are not repeated.
    """
    found = PolygonGrid(edges).containing(points, key)
    return (found if boundary else found.where("open")).drop("open")


def inside(points: DataFrame, edges: DataFrame, key: str, boundary: bool = False) -> DataFrame:
    """The points with a polygon around them; ``key`` tells them apart. No pairs are made of points in cells inside a polygon."""
    places = points.select("lon", "lat").distinct()
    return points.join(PolygonGrid(edges).inside(places, boundary), ["lon", "lat"], "left_semi").select(points.columns)


def wet(rows: DataFrame, water: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows whose rounded coordinates are those of a water point."""
    near = water.select(*[c.alias(k) for k, c in keys.items()]).distinct()
    return rows.withColumns(keys).join(near, list(keys), "left_semi").drop(*keys)


def polygon_report(edges: DataFrame, lon: float, lat: float) -> DataFrame:
    """Per polygon: its bounds, whether it holds a place, and the place's distance from its edges in degrees."""
    x, y = F.lit(lon), F.lit(lat)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.least(F.greatest(((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    away = F.sqrt(F.pow(F.col("x1") + along * dx - x, 2) + F.pow(F.col("y1") + along * dy - y, 2))
    rows = edges.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"),
        F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"),
        (F.sum(_crossing(x, y)) % 2 == 1).alias("holds"), F.min(away).alias("edge_distance"),
    )
    return rows.withColumn("distance", F.when(F.col("holds"), 0.0).otherwise(F.col("edge_distance"))).drop("edge_distance")


def mask_bounds(points: DataFrame, fallback: tuple[float, float, float, float], outer: bool = False) -> DataFrame:
    """Bounds of all polygons, or of their outer rings alone (ring 0); the fallback for none."""
    points = points.where("ring_id = 0") if outer else points
    parts = zip(("west", "east", "south", "north"), (F.min("x"), F.max("x"), F.min("y"), F.max("y")), fallback)
    return points.agg(*[F.coalesce(c, F.lit(d)).alias(n) for n, c, d in parts])
