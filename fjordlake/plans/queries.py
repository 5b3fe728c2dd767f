"""One registered query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CONTROL_POINTS, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, PARAMETERS, RAMPS
from ..functions import colours as C
from ..functions import hours as H
from ..functions import layout as L
from ..functions import sun as S
from ..functions import vectors as V
from ..operators import lattices as W
from ..operators import mask as M
from ..operators import merge as P
from ..operators import nearest as N
from ..operators import raster as R
from ..operators import regions as G
from ..operators import scan
from ..operators import search as Q
from ..operators import series as E
from ..operators.dilate import dilate
from ..operators.ranges import numbered
from ..sinks.documents import Documents, Folder
from ..sinks.files import feature_collections, features, missing, shared_path, write_document
from ..sinks.versions import Versions
from ..sources import area, catalog, coverage, geometry
from ..sources.coverages import Coverages
from ..sources.observations import observations, table
from .fixtures import BASE, DAY, LAT, LON, RADIUS, TOLERANCE, event_rings, ring_points

BOX = (LON_MIN, LON_MAX, LAT_MIN, LAT_MAX)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column) -> Column:
    return F.round(c, 6)


def day(c: str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def of_day(rows: DataFrame) -> DataFrame:
    start = F.lit(DAY).cast("timestamp_ntz")
    return rows.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))


def points(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select("point_id", "lat", "lon").distinct()


def mask_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the polygons around the points of the events."""
    return geometry.edges(event_rings(observations(spark, folder)))


@query
def arrows_at_hour(spark, folder):
    """Arrows of one day: first entry of each point, zero components missing, regions looked up."""
    first = E.first_entry(of_day(observations(spark, folder)).select("point_id", "ts", "event_id", "lat", "lon", "u", "v"), "point_id")
    u, v = F.nullif("u", F.lit(0.0)), F.nullif("v", F.lit(0.0))
    size = V.magnitude(F.col("u"), F.col("v"))
    kept = first.where(u.isNotNull() & v.isNotNull() & (size >= 0.01) & E.is_apart(F.col("lat"), F.col("lon"), CONTROL_POINTS))
    return kept.select(
        "point_id", "lat", "lon", r6(size).alias("magnitude"), r6(V.rotation(F.col("u"), F.col("v"))).alias("rotation"),
        G.region_of(F.col("lon"), F.col("lat"))["region"].alias("region"),
    )


@query
def vector_magnitude_bearing(spark, folder):
    u, v = F.col("u"), F.col("v")
    away = V.haversine_km(F.col("lat"), F.col("lon"), F.lit(LAT), F.lit(LON))
    return observations(spark, folder).select(
        "event_id", r6(V.magnitude(u, v)).alias("magnitude"), r6(V.bearing(u, v)).alias("bearing"),
        r6(V.rotation(u, v)).alias("rotation"), F.round(away, 4).alias("away_km"),
        r6(V.planar(F.col("lat") - LAT, F.col("lon") - LON)).alias("away_degrees"),
    )


@query
def knots_bins(spark, folder):
    speed = V.knots(V.magnitude(F.col("u"), F.col("v")))
    rows = observations(spark, folder).select(speed.alias("s"))
    return rows.groupBy(V.knot_bin(F.col("s")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.min("s")).alias("least"), r6(F.max("s")).alias("most"),
        F.count_if(V.is_slow(F.col("s"))).alias("n_slow"),
    )


@query
def hour_offsets(spark, folder):
    base = F.lit(BASE).cast("timestamp_ntz")
    hour = H.hour_offset(F.col("ts"), base)
    return observations(spark, folder).select("event_id", "ts", hour.alias("hour")).select(
        "event_id", "hour", H.offset_label(F.col("hour")).alias("label"), H.long_offset_label(F.col("hour")).alias("long_label"),
        H.fold(F.col("hour")).cast("bigint").alias("of_day"), H.hour_prefix(F.col("ts")).alias("prefix"),
        H.base_hour(F.col("ts")).alias("base"),
    )


@query
def file_names(spark, folder):
    name = F.lit(PARAMETERS["current"][2])
    stamp = H.iso(F.col("ts"))
    return observations(spark, folder).select("event_id", stamp.alias("stamp"), H.image_name(name, stamp).alias("file"))


@query
def nearest_available_hour(spark, folder):
    hour = H.hour_offset(F.col("ts"), F.lit(BASE).cast("timestamp_ntz"))
    rows = observations(spark, folder).select(hour.alias("hour"), "event_type")
    return G.nearest_hours(rows.select(F.col("hour").alias("target")).distinct(), rows.where("event_type = 'error'").select("hour"))


@query
def hour_steps(spark, folder):
    """Steps of an hour and a day each way, snapped; and hours from slider positions."""
    hour = H.hour_offset(F.col("ts"), F.lit(BASE).cast("timestamp_ntz"))
    rows = observations(spark, folder).select(hour.alias("hour"), "event_type")
    steps = rows.select("hour").distinct().select("hour", F.explode(F.array(*map(F.lit, (-24, -1, 1, 24)))).alias("step"))
    wanted = steps.withColumn("target", F.col("hour") + F.col("step"))
    snapped = G.nearest_hours(wanted.select("target").distinct(), rows.where("event_type = 'error'").select("hour"))
    share = (F.col("hour") + 400) / F.lit(700.0)
    return wanted.join(snapped, "target").select("hour", "step", "nearest", H.position_to_hour(share, -120, 120).alias("slider"), H.knob_to_hour(share, -120, 120).alias("knob"))


@query
def first_entry_per_point(spark, folder):
    """The first entry of each point and day decides, even where it lacks the temperature."""
    rows = observations(spark, folder).select("point_id", "ts", "event_id", "temperature").withColumn("day", day())
    first = E.first_entry(rows, "point_id", "day")
    return first.where("temperature IS NOT NULL").select("point_id", "day", r6(F.col("temperature")).alias("temperature"))


@query
def series_by_point(spark, folder):
    rows = E.series(observations(spark, folder), "point_id", "ts", "event_id")
    ids = F.array_join(F.transform("entries", lambda e: e["event_id"].cast("string")), ",")
    return rows.select(
        "point_id", F.size("entries").cast("bigint").alias("n"), F.get("entries", F.lit(0))["ts"].alias("first_ts"), ids.alias("ids")
    )


@query
def series_validity(spark, folder):
    """Whether all entries of a point have both values, and whether some entry has more than nulls: clicks lack a salinity, which counts."""
    values = P.present(temperature=(F.col("temperature"), F.lit(True)), salinity=(F.col("salinity"), F.col("event_type") != "click"))
    rows = observations(spark, folder).select("point_id", values.alias("values"))
    names = ("temperature", "salinity")
    held = F.col("values")
    return rows.groupBy("point_id").agg(
        F.bool_and(P.all_there(held, names)).alias("all_valid"), F.bool_or(P.any_not_null(held, names)).alias("any_valid"),
        F.count_if(P.any_not_null(held, ["salinity"])).alias("n_salinity"),
    )


@query
def merge_parameter_batches(spark, folder):
    """Series of temperatures with two batches merged in by position: one of the same times, one that lacks some of them."""
    rows = observations(spark, folder)
    fields = ("ts", "event_id", "event_type", "u", "v", "temperature", "salinity")
    always = F.lit(True)

    def nested(part, current, values):
        entry = lambda e: F.struct(e["ts"].alias("time"), P.present(**current(e)).alias("current"), P.present(**values(e)).alias("values"))
        ordered = F.sort_array(F.collect_list(F.struct(*fields)))
        return part.groupBy(F.col("point_id").alias("position")).agg(ordered.alias("e")).select("position", F.transform("e", entry).alias("entries"))

    base = nested(rows, lambda e: {"u": (e["u"], always)}, lambda e: {"temperature": (e["temperature"], always)})
    same = nested(rows, lambda e: {"v": (e["v"], always)}, lambda e: {"salinity": (e["salinity"], e["event_type"] != "click")})
    some = nested(
        rows.where("event_type <> 'error'"),
        lambda e: {"u": (-e["u"], e["event_type"] == "purchase")}, lambda e: {"temperature": (e["v"], e["event_type"] != "click")},
    )
    merged = P.merge_by_position(base, [same, None, some])
    out = merged.select("position", F.posexplode("entries").alias("k", "e"))
    at = lambda m, k: r6(F.col(f"e.{m}")[k]).alias(k)
    return out.select("position", "k", F.size("e.values").alias("n_values"), at("current", "u"), at("current", "v"), at("values", "temperature"), at("values", "salinity"))


@query
def union_control_points(spark, folder):
    return E.with_control_points(points(spark, folder), CONTROL_POINTS).select("point_id", "lat", "lon", "name", "is_point_specific")


@query
def dedup_by_key(spark, folder):
    keys = {"lat_key": V.key4(F.col("lat")), "lon_key": V.key4(F.col("lon"))}
    found = E.dedup_points(observations(spark, folder), keys, ("ts", "event_id"), ["temperature", "salinity"])
    return found.withColumns({c: r6(F.col(c)) for c in ("lat", "lon", "temperature", "salinity")})


@query
def keyed_series(spark, folder):
    """Series by three-place keys, as a map would hold them."""
    rows = observations(spark, folder).withColumns({"lat_key": V.key3(F.col("lat")), "lon_key": V.key3(F.col("lon"))})
    return rows.groupBy("lat_key", "lon_key").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query
def region_offset(spark, folder):
    return points(spark, folder).select("point_id", G.region_of(F.col("lon"), F.col("lat")).alias("r")).select("point_id", "r.*")


@query
def region_summary(spark, folder):
    found = points(spark, folder).select(G.region_of(F.col("lon"), F.col("lat"))["region"].alias("region")).groupBy("region").count()
    rows = G.regions(spark).join(found, "region", "left")
    return rows.select(
        "idx", "region", r6(F.col("area")).alias("area"), r6(F.col("centre_lon")).alias("centre_lon"),
        r6(F.col("centre_lat")).alias("centre_lat"), F.coalesce("count", F.lit(0)).alias("n_points"),
    )


@query
def overlay_corners(spark, folder):
    """Corners of each day's overlay, the box of its observations moved by the offsets of its region."""
    names = {"west": F.min("lon"), "east": F.max("lon"), "south": F.min("lat"), "north": F.max("lat")}
    boxes = observations(spark, folder).groupBy(day().alias("day")).agg(*[c.alias(k) for k, c in names.items()])
    box = [F.col(k) for k in names]
    found = boxes.withColumn("r", G.region_of_box(*box))
    rows = found.select("day", F.posexplode(G.corners(F.col("r.lat_offset"), F.col("r.lon_offset"), box)).alias("corner", "p"))
    return rows.select("day", "corner", r6(F.col("p.lon")).alias("lon"), r6(F.col("p.lat")).alias("lat"))


@query
def exclude_control_points(spark, folder):
    """Observations a few thousandths of a degree beside control points, by their event: those within the tolerance go."""
    rows = observations(spark, folder)
    control = F.array(*[F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon"), F.lit(n).alias("name")) for y, x, n in CONTROL_POINTS])
    near = rows.select("event_id", control[(F.col("event_id") % len(CONTROL_POINTS)).cast("int")].alias("c"), ((F.col("event_id") % 31 - 15) / F.lit(10_000.0)).alias("step"))
    moved = near.select("event_id", "c.name", (F.col("c.lat") + F.col("step")).alias("lat"), (F.col("c.lon") + F.col("step")).alias("lon"))
    return moved.where(E.is_apart(F.col("lat"), F.col("lon"), CONTROL_POINTS)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), r6(F.max("lat")).alias("north"))


@query
def deterministic_sample(spark, folder):
    place = F.floor(F.col("lat") * 1000) + F.floor(F.col("lon") * 1000)
    return points(spark, folder).where(place % 20 == 0)


@query
def bbox_filter(spark, folder):
    rows = Q.within_box(observations(spark, folder), 7.5, 13.5, 54.5, 58.0)
    return rows.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("u")).alias("max_u"))


@query
def first_lattice_points(spark, folder):
    """The first hundred points of a stepped lattice that are in a box and in the water, in order of making."""
    cells = geometry.stepped_lattice(spark, (LON_MIN, LON_MAX), (LAT_MIN, LAT_MAX), 0.1)
    boxed = Q.within_box(cells, 11.0, 13.5, 55.5, 58.0).withColumn("cell", F.col("i") * 1000 + F.col("j"))
    return M.inside(boxed, mask_edges(spark, folder), "cell").orderBy("i", "j").limit(100).drop("cell")


@query
def tolerance_topk(spark, folder):
    rows = points(spark, folder).withColumn("seq", F.col("point_id"))
    found = Q.nearest_points(rows, LAT, LON, TOLERANCE).unionByName(Q.nearest_points(rows, 40.0, LON, 0.05))
    return found.select("point_id", r6(F.col("dist")).alias("dist"), "in_box")


@query
def radius_stats(spark, folder):
    found = Q.radius_stats(observations(spark, folder), LAT, LON, RADIUS)
    return found.select("n", r6(F.col("min_knots")).alias("min_knots"), r6(F.col("max_knots")).alias("max_knots"))


@query
def coverage_counts(spark, folder):
    return Q.coverage_counts(observations(spark, folder).withColumn("day", day()), "day")


@query
def bbox_gaps(spark, folder):
    gaps = Q.box_gaps(observations(spark, folder), *BOX)
    return gaps.select([r6(F.col(c)).alias(c) for c in gaps.columns])


@query
def raster_stats_by_hour(spark, folder):
    """Statistics of a day's salinities, held at 0 and above, and of its missing and negative values."""
    rows = observations(spark, folder).select(day().alias("day"), (F.col("salinity") - 2).alias("x"))
    value = V.clamp_parameter(F.lit("salinity"), F.col("x"))
    return rows.groupBy("day").agg(
        r6(F.min(value)).alias("least"), r6(F.max(value)).alias("most"), F.round(F.avg(value), 4).alias("mean"),
        F.count(value).alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing"), F.count_if(F.col("x") < 0).alias("n_negative"),
        r6(F.count_if(F.col("x").isNull()) / F.count(F.lit(1)) * 100).alias("missing_share"),
    )


@query
def point_in_polygon(spark, folder):
    found = M.PolygonGrid(mask_edges(spark, folder)).containing(points(spark, folder), "point_id")
    both = F.when(F.col("open"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    return found.select("point_id", "poly_id", F.explode(both).alias("closed"))


@query
def water_semi_join(spark, folder):
    """Observations whose rounded coordinates are those of a point in the water."""
    rows = observations(spark, folder).select("point_id", "event_id", "lat", "lon")
    water = M.inside(points(spark, folder), mask_edges(spark, folder), "point_id")
    keys = {"lat_key": V.key4(F.col("lat")), "lon_key": V.key4(F.col("lon"))}
    return M.wet(rows, water, keys).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


@query
def mask_grid(spark, folder):
    cells = geometry.lattice(spark.range(1).drop("id"), 48, *BOX).withColumn("cell", F.col("i") * 48 + F.col("j"))
    return M.inside(cells, mask_edges(spark, folder), "cell").groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.min("j").alias("first_j"), F.max("j").alias("last_j")
    )


@query
def mask_bounds(spark, folder):
    rings = event_rings(observations(spark, folder))
    return M.mask_bounds(rings, (7.5, 13.5, 54.5, 58.0)).withColumn("of", F.lit("all")).unionByName(
        M.mask_bounds(rings.where("poly_id < 3"), (7.5, 13.5, 54.5, 58.0), outer=True).withColumn("of", F.lit("outer"))
    ).unionByName(M.mask_bounds(rings.where("false"), (7.5, 13.5, 54.5, 58.0)).withColumn("of", F.lit("none")))


@query
def polygon_report(spark, folder):
    found = M.polygon_report(mask_edges(spark, folder), LON, LAT)
    return found.withColumns({c: r6(F.col(c)) for c in ("west", "east", "south", "north", "distance")})


@query
def edge_nearest(spark, folder):
    """Values on the edge of the box on each day, from the nearest observation of the day."""
    rows = observations(spark, folder).withColumn("day", day()).where("temperature IS NOT NULL")
    edge = N.box_edge(rows.select("day").distinct(), 25, *BOX)
    found = N.nearest(edge, rows, "id", "temperature", "event_id", ["day"])
    return found.select("day", "id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"), r6(F.col("temperature")).alias("temperature"))


@query
def nearest_raster(spark, folder):
    """A masked raster of each day's speeds from the nearest observations."""
    rows = observations(spark, folder).withColumns({"day": day(), "speed": V.magnitude(F.col("u"), F.col("v"))})
    cell = F.col("i") * 24 + F.col("j")
    cells = geometry.lattice(rows.select("day").distinct(), 24, *BOX).withColumn("cell", cell)
    one = geometry.lattice(spark.range(1).drop("id"), 24, *BOX).withColumn("cell", cell)
    wet = M.inside(one, mask_edges(spark, folder), "cell").select("cell", F.lit(True).alias("wet"))
    found = N.nearest(cells, rows, "cell", "speed", "event_id", ["day"]).join(wet, "cell", "left")
    return found.select("day", "i", "j", r6(F.when(F.col("wet"), F.col("speed"))).alias("speed"))


@query
def color_ramp(spark, folder):
    rows = observations(spark, folder)
    parts = [
        rows.select(F.lit(p).alias("parameter"), C.ramp(p, c).alias("c"))
        for p, c in (("current", V.magnitude(F.col("u"), F.col("v"))), ("temperature", F.col("temperature")), ("salinity", F.col("salinity")))
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("parameter", "c.r", "c.g", "c.b").agg(F.count(F.lit(1)).alias("n"))


@query
def arrow_color(spark, folder):
    colour = C.arrow_colour(V.magnitude(F.col("u"), F.col("v")))
    return observations(spark, folder).select("event_id", colour.alias("c")).select("event_id", "c.*")


@query
def progress_colors(spark, folder):
    hour = H.hour_offset(F.col("ts"), F.lit(BASE).cast("timestamp_ntz"))
    rows = observations(spark, folder).select(hour.alias("hour")).distinct()
    return rows.select("hour", C.progress_colour(F.col("hour"), -340, 380).alias("colour"))


@query
def legend_stops(spark, folder):
    """Stops of the legends with the number of observations from each stop up to the next."""
    rows = [(p, i, v, c, len(s)) for p, s in RAMPS.items() for i, (v, c) in enumerate(s)]
    stops = spark.createDataFrame(rows, "parameter string, idx int, value double, colour string, n int")
    at = F.lit(None).cast("int")
    for p, stops_of in RAMPS.items():
        reached = F.lit(None).cast("int")
        for i, (v, _) in enumerate(stops_of):
            reached = F.when(F.col("value") >= v, i).otherwise(reached)
        at = F.when(F.col("parameter") == p, reached).otherwise(at)
    counted = _values(observations(spark, folder)).where("value IS NOT NULL").groupBy("parameter", at.alias("idx")).count()
    found = stops.join(counted, ["parameter", "idx"], "left")
    return found.select("parameter", "idx", "value", "colour", r6(C.legend_share(F.col("idx"), F.col("n"))).alias("share"), F.coalesce("count", F.lit(0)).alias("n_observations"))


@query
def sun_times(spark, folder):
    days = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    rise, fall = S.sun_times(F.col("date"))
    return days.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.round(rise, 4).alias("rise"), F.round(fall, 4).alias("fall"),
        S.is_summer_time(F.col("date")).alias("summer"),
    )


@query
def day_night_opacity(spark, folder):
    rows = observations(spark, folder).select("event_id", F.col("ts").cast("date").alias("date"), F.hour("ts").alias("hour"))
    rise, fall = S.sun_times(F.col("date"))
    named = rows.withColumns({"rise": rise, "fall": fall})
    share = S.sun_share(F.col("hour"), F.col("rise"), F.col("fall"))
    return named.select(
        "event_id", F.round(share, 4).alias("sun"), F.round(1 - share, 4).alias("moon"),
        S.is_day(F.col("hour"), F.col("rise"), F.col("fall")).alias("is_day"),
    )


@query
def relative_day_label(spark, folder):
    base = F.lit("2024-01-15 10:00:00").cast("timestamp_ntz")
    return observations(spark, folder).select(
        "event_id", H.day_label(F.col("ts"), base).alias("label"), H.full_date(F.col("ts")).alias("full_date"),
        F.hour(H.local(F.col("ts"))).alias("local_hour"),
    )


@query
def layout_classes(spark, folder):
    """Layout, zoom and sizes for made-up screens."""
    size = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1400 + 200).alias("w"), (F.col("p_partkey") * 53 % 1100 + 200).alias("h"))
    kind = L.layout(F.col("w"), F.col("h"))
    mobile = L.has_mobile_slider(kind)
    zoom = L.initial_zoom(F.col("w"), F.col("h"))
    return size.select(
        "p_partkey", kind.alias("layout"), L.has_sidebar(kind).alias("sidebar"), L.has_menu(kind).alias("menu"), mobile.alias("slider"),
        L.screen_size(F.col("w")).alias("screen"), r6(zoom).alias("zoom"), L.arrow_size(mobile, F.col("p_partkey") % 5 + 4).alias("arrow"),
        r6(V.clamp(F.col("w"), 300, 900)).alias("held"), r6(V.normalise(F.col("w"), 200, 1600)).alias("share"),
    )


@query
def drag_sessions(spark, folder):
    return E.gap_sessions(table(spark, folder, "events"), "user_id", "2 hours").select("user_id", "first_ts", "last_ts", "n")


@query
def debounced_last(spark, folder):
    found = E.gap_sessions(table(spark, folder, "events"), "user_id", "30 minutes")
    return found.select("user_id", "last_ts", "last_event")


@query
def throttled_events(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id")
    return scan.throttled(rows, "user_id", 6 * 3_600_000).select("user_id", "event_id", "emitted_ms")


@query
def accepted_changes(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id", (F.col("value") / 500).alias("share"))
    return scan.accepted_changes(rows, "user_id", "share", ["ts", "event_id"], 0.5).select("user_id", "event_id", r6(F.col("share")).alias("share"))


@query
def cube_decode(spark, folder):
    """A flat range of values by time, y and x, decoded."""
    rows = observations(spark, folder)
    flat = rows.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "salinity"))).alias("flat"))
    cells = flat.select("point_id", F.posexplode("flat").alias("pos", "e"))
    t, y, x = coverage.decode(F.col("pos"), F.lit(3), F.lit(2))
    return cells.select("point_id", t.alias("t"), y.alias("y"), x.alias("x"), r6(F.col("e.salinity")).alias("value"))


@query
def coverage_scan(spark, folder):
    """A cube for each day by two batches of parameters, written as coverages and scanned within bounds."""
    spark.dataSource.register(Coverages)
    rows = observations(spark, folder).withColumns({"day": day(), "speed": r6(V.magnitude(F.col("u"), F.col("v")))})
    path = shared_path(spark, "coverages")
    cells = rows.groupBy("day", (F.col("point_id") % 5).alias("y"), (F.col("point_id") % 7).alias("x"))
    cells = cells.agg(F.max("speed").alias("speed"), F.max("event_id").cast("double").alias("event"))
    days = cells.select("day").distinct()
    lattice = days.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(6))))
    flat = lattice.join(cells, ["day", "y", "x"], "left").groupBy("day").agg(F.sort_array(F.collect_list(F.struct("y", "x", "speed", "event"))).alias("c"))
    axis = lambda first, n: F.struct(F.lit(first).alias("start"), F.lit(first + n - 1).alias("stop"), F.lit(n).alias("num"))
    cube = F.struct(F.lit("Grid").alias("domainType"), F.struct(F.struct(F.array("day").alias("values")).alias("t"), axis(55.0, 5).alias("y"), axis(10.0, 7).alias("x")).alias("axes"))
    values = lambda c: F.struct(F.transform("c", lambda e: e[c]).alias("values")).alias(c)
    for names in (("speed", "event"), ("event",)):
        document = flat.select(cube.alias("domain"), F.struct(*[values(c) for c in names]).alias("ranges"))
        document.write.option("ignoreNullFields", "false").json(f"{path}/cube/{'+'.join(names)}")
    scan_ = spark.read.format("coverages").options(base=path, kind="cube", parameters="speed\nevent\nevent", box="10,55,16,59", mode="skip").load()
    near = scan_.where((F.col("lat") >= 56.0) & (F.col("lon") <= 14.0))
    return near.groupBy("parameter", "lat", "lon").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), r6(F.max("value")).alias("most"))


@query
def catalog_filter(spark, folder):
    """Names that hold a text in any case, their first words, and addresses without a query."""
    rows = table(spark, folder, "pages").where(F.lower("url").contains("a"))
    bare = F.split("url", r"\?")[0]
    return rows.select("page_id", bare.alias("address"), F.array_join(F.slice(F.split(bare, "/"), 1, 3), "/").alias("head"))


@query
def parameter_batches(spark, folder):
    return E.batches(table(spark, folder, "nation").select("n_nationkey", "n_name"), "n_nationkey", 4)


@query
def skip_existing(spark, folder):
    """Customers that no urgent order names: what is left to write."""
    there = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return missing(table(spark, folder, "customer").select("c_custkey", "c_name"), there, "c_custkey")


@query
def parameter_ranges(spark, folder):
    speed = V.magnitude(F.col("u"), F.col("v"))
    return observations(spark, folder).agg(
        r6(F.min(speed)).alias("least"), r6(F.max(speed)).alias("most"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("point_id").alias("n_points"), r6(F.min("lat")).alias("south"), r6(F.max("lat")).alias("north"),
    )


@query
def neighbour_mean(spark, folder):
    """Mean of the cells around each empty cell of a raster of points."""
    cell = {"i": F.floor((F.col("lat") - LAT_MIN) * 4).cast("int"), "j": F.floor((F.col("lon") - LON_MIN) * 4).cast("int")}
    full = observations(spark, folder).withColumns(cell).groupBy("i", "j").agg(F.avg("u").alias("z"))
    step = F.sequence(F.lit(-1), F.lit(1))
    around = full.withColumn("di", F.explode(step)).withColumn("dj", F.explode(step)).where("di <> 0 OR dj <> 0")
    near = around.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "z")
    return near.join(full.select("i", "j"), ["i", "j"], "left_anti").groupBy("i", "j").agg(F.round(F.avg("z"), 4).alias("z"), F.count(F.lit(1)).alias("n"))


@query
def dilated_raster(spark, folder):
    """Each day's lattice of quarter degrees with mean speeds of failed events, its gaps filled from their edges."""
    rows = observations(spark, folder).where("event_type = 'error'").withColumn("day", day())
    cell = {"i": F.floor((F.col("lat") - LAT_MIN) * 4).cast("int"), "j": F.floor((F.col("lon") - LON_MIN) * 4).cast("int")}
    full = rows.withColumns(cell).groupBy("day", "i", "j").agg(F.avg(V.magnitude(F.col("u"), F.col("v"))).alias("z"))
    lattice = full.select("day").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(18)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(25))))
    cells = lattice.join(full, ["day", "i", "j"], "left").withColumns({"lat": F.col("i") * 0.25, "lon": F.col("j") * 0.25})
    return dilate(cells, "z", ["day"]).select("day", "i", "j", "sweep", F.round("z", 4).alias("z"))


@query
def linear_raster(spark, folder):
    return _rasters(spark, folder, "linear", False)


@query
def cubic_raster(spark, folder):
    return _rasters(spark, folder, "cubic", True)


def _rasters(spark, folder, method, fill):
    rows = observations(spark, folder).select(F.lit("temperature").alias("parameter"), day().alias("day"), "lon", "lat", "temperature", "event_id")
    found = R.rasters(rows, ["parameter", "day"], "temperature", 40, BOX, method, fill, "event_id")
    there = F.filter("values", lambda v: v.isNotNull())
    return found.select(
        "parameter", "day", "n_points", F.size(there).alias("n_values"), F.round(F.array_min(there), 4).alias("least"), F.round(F.array_max(there), 4).alias("most")
    )


@query
def convex_hull(spark, folder):
    """The hull of each day's places: its corners, and whether it holds a place."""
    found = R.hulls(observations(spark, folder).select(day().alias("day"), "lon", "lat"), ["day"], LON, LAT)
    corner = found.select("day", "n_corners", "holds", r6(F.col("corner_distance")).alias("corner_distance"), F.explode("corners").alias("c"))
    return corner.select("day", "n_corners", "holds", "corner_distance", r6(F.col("c.lon")).alias("lon"), r6(F.col("c.lat")).alias("lat"))


@query
def png_raster(spark, folder):
    rows = observations(spark, folder).select(day().alias("day"), "lon", "lat", "temperature", "event_id")
    found = R.pictures(R.rasters(rows, ["day"], "temperature", 40, BOX, seq="event_id"), 40, ["day"], "temperature")
    return found.select("day", F.octet_length("png").alias("n_bytes"), F.sha2("png", 256).alias("sha256"))


@query
def geojson_features(spark, folder):
    rows = arrows_at_hour(spark, folder).withColumn("opacity", F.lit(0.8))
    return features(rows, "magnitude", "rotation", "opacity").select("point_id", "feature")


@query
def arrow_features(spark, folder):
    """Arrows of each day as a collection for each region, with colour, opacity and size, written as documents and read back."""
    rows = observations(spark, folder).withColumn("day", day()).select("point_id", "day", "ts", "event_id", "lat", "lon", "u", "v")
    first = E.first_entry(rows, "point_id", "day")
    size, c = V.magnitude(F.col("u"), F.col("v")), C.arrow_colour(V.magnitude(F.col("u"), F.col("v")))
    colour = F.concat(F.lit("rgb("), F.concat_ws(", ", *[c[k].cast("string") for k in "rgb"]), F.lit(")"))
    mobile, zoom = F.col("point_id") % 2 == 0, (F.col("point_id") % 4 + 5).cast("double")
    arrows = first.where((F.col("u") != 0) & (F.col("v") != 0)).withColumns({
        "color": colour, "magnitude": r6(size), "opacity": F.when(mobile, 0.8).otherwise(1.0), "rotation": r6(V.rotation(F.col("u"), F.col("v"))),
        "size": L.arrow_size(mobile, zoom), "region": G.region_of(F.col("lon"), F.col("lat"))["region"],
    })
    names = ("color", "magnitude", "opacity", "rotation", "size")
    path = shared_path(spark, "arrows")
    made = feature_collections(arrows, ["day", "region"], "point_id", *names)
    made.write.json(path)
    read = spark.read.schema(made.schema).json(path).where("type = 'FeatureCollection'")
    found = read.select("day", "region", F.posexplode("features").alias("k", "f"))
    xy = F.col("f.geometry.coordinates")
    return found.select("day", "region", "k", *[F.col(f"f.properties.{n}").alias(n) for n in names], r6(xy[0]).alias("lon"), r6(xy[1]).alias("lat"))


@query
def region_of_boxes(spark, folder):
    """The region of the box around each day's events of a kind, by its centre, and the offsets by its name."""
    rows = observations(spark, folder).groupBy(day().alias("day"), "event_type").agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("low", F.min), ("high", F.max))])
    box = [F.col(c) for c in ("low_lon", "high_lon", "low_lat", "high_lat")]
    found = rows.select("day", "event_type", G.region_of_box(*box)["region"].alias("region"))
    return found.select("day", "event_type", "region", G.offsets_named(F.col("region")).alias("o")).select("day", "event_type", "region", "o.*")


@query
def dedup_by_key_and_time(spark, folder):
    """Of each place and hour the last values, with the place's first coordinates."""
    keys = {"lat_key": V.key3(F.col("lat")), "lon_key": V.key3(F.col("lon"))}
    rows = observations(spark, folder).withColumn("hour", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    found = E.dedup_series(rows, keys, "hour", ("ts", "event_id"), ["temperature", "salinity"])
    return found.withColumns({c: r6(F.col(c)) for c in ("lat", "lon", "temperature", "salinity")})


def control_series(spark, folder):
    """Observations at the control points: those of the nearest point of the grid."""
    control = spark.createDataFrame(CONTROL_POINTS, "lat double, lon double, name string")
    near = N.nearest(control, points(spark, folder), "name", "point_id", "point_id").select("name", "lat", "lon", "point_id")
    rows = observations(spark, folder).drop("lat", "lon")
    return rows.join(F.broadcast(near), "point_id")  # a row for each control point


@query
def control_point_series(spark, folder):
    """Grid points and control points, each with its series."""
    rows = E.with_control_series(observations(spark, folder), control_series(spark, folder))
    entry = F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), r6(F.max("temperature")).alias("most")
    return rows.groupBy("is_point_specific", "name", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon")).agg(*entry)


@query
def area_counts(spark, folder):
    rows = E.with_control_series(observations(spark, folder), control_series(spark, folder))
    water = M.inside(points(spark, folder), mask_edges(spark, folder), "point_id")
    return E.area_counts(rows, ("lat", "lon"), water)


@query
def keyed_maps(spark, folder):
    """Series by latitude as maps from longitude to the last event, looked up for each point and its neighbour to the east."""
    keys = {"lat_key": V.key3(F.col("lat")), "lon_key": V.key3(F.col("lon"))}
    last = observations(spark, folder).withColumns(keys).groupBy(*keys).agg(F.max("event_id").alias("last_event"))
    maps = last.groupBy("lat_key").agg(F.map_from_entries(F.collect_list(F.struct("lon_key", "last_event"))).alias("m"))
    asked = points(spark, folder).withColumns(keys).join(maps, "lat_key")
    return asked.select("point_id", F.size("m").alias("n_keys"), F.try_element_at("m", "lon_key").alias("here"), F.try_element_at("m", F.col("lon_key") + 470).alias("east"))


@query
def first_of_area(spark, folder):
    """The three first rows of each day by time, as a top-k of each group."""
    rows = observations(spark, folder).withColumn("day", day())
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("day", "rank", "event_id")


def _values(rows: DataFrame) -> DataFrame:
    """Values of all three parameters, a row each."""
    values = {"current": V.magnitude(F.col("u"), F.col("v")), "temperature": F.col("temperature"), "salinity": F.col("salinity") - 2}
    parts = F.array(*[F.struct(F.lit(p).alias("parameter"), v.alias("value")) for p, v in values.items()])
    return rows.select(day().alias("day"), "lon", "lat", F.col("event_id").alias("seq"), F.explode(parts).alias("p")).select("day", "lon", "lat", "seq", "p.*")


def _values_of_day(spark, folder):
    """A day's values of all three parameters."""
    return _values(of_day(observations(spark, folder)))


def raster_job(spark, folder, n=64, method="cubic", draw=True, parameters=None):
    """The rasters of a day, from edges to pictures."""
    edges = [tuple(r) for r in geometry.edges(ring_points(spark)).select("poly_id", "x1", "y1", "x2", "y2").collect()]
    rows = _values_of_day(spark, folder)
    rows = rows.where(F.col("parameter").isin(*parameters)) if parameters else rows
    return R.raster_job(rows, ["parameter", "day"], n, BOX, edges, method, draw=draw)


@query
def raster_pictures(spark, folder):
    found = raster_job(spark, folder)
    return found.select("parameter", "day", "n_points", "n_values", "n_empty", F.octet_length("png").alias("n_bytes"))


@query
def raster_job_statistics(spark, folder):
    """Edges, nearest values, clamp, mask and statistics of the rasters of each day and parameter, as joins."""
    rows, by = _values(observations(spark, folder)), ["parameter", "day"]
    counted = rows.groupBy(*by).agg(F.count("value").alias("n_points"))
    found = W.statistics(W.nearest_rasters(rows, by, 32, BOX, mask_edges(spark, folder)), by, 32).join(counted, by)
    numbers = [r6(F.col(c)).alias(c) for c in ("least", "most")]
    return found.select(*by, "n_points", "n_values", "n_empty", *numbers, F.round("mean", 4).alias("mean"))


@query
def exact_time(spark, folder):
    """Observations at one time: that of event 7."""
    rows = observations(spark, folder)
    at = rows.where("event_id = 7").agg(F.min("ts").alias("ts"))  # one row
    return rows.join(F.broadcast(at), "ts").select("event_id", "point_id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query
def hour_prefix(spark, folder):
    """Observations whose time begins with a day and the first figure of an hour."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return observations(spark, folder).where(time.startswith(f"{DAY}T1")).select("event_id", time.alias("time"))


@query
def wanted_parameters(spark, folder):
    """Values of the wanted parameters, with ``all`` standing for every one, counted by day."""
    wanted = Q.expand_all(["salinity", "temperature"], list(PARAMETERS))
    everything = Q.expand_all(["all"], list(PARAMETERS))
    rows = _values(observations(spark, folder))
    kept = rows.where(Q.is_wanted(F.col("parameter"), wanted)).withColumn("asked", F.lit("two"))
    kept = kept.unionByName(rows.where(Q.is_wanted(F.col("parameter"), everything)).withColumn("asked", F.lit("all")))
    return kept.groupBy("asked", "parameter").agg(F.count("value").alias("n"), r6(F.max("value")).alias("most"))


@query
def first_images(spark, folder):
    """The first five hours of the time axis, and all of them."""
    hours = observations(spark, folder).select(F.date_trunc("hour", "ts").alias("hour")).distinct()
    few, every = (Q.first_times(hours, "hour", most) for most in (5, 0))
    label = F.date_format("hour", "yyyy-MM-dd HH")
    return few.select(F.lit("first").alias("of"), label.alias("hour")).unionByName(every.select(F.lit("all").alias("of"), label.alias("hour")))


@query
def mask_document(spark, folder):
    """The mask as GeoJSON, collections of 1,024 polygons each, written to the shared folder and read back as points of rings."""
    rings = event_rings(observations(spark, folder)).groupBy("poly_id", "ring_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.array("x", "y").alias("xy")))).alias("p"))
    polygons = rings.groupBy("poly_id").agg(F.sort_array(F.collect_list(F.struct("ring_id", "p"))).alias("r"))
    shape = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.transform("r", lambda r: F.transform(r["p"], lambda p: p["xy"])).alias("coordinates")).alias("geometry"),
        F.struct(F.col("poly_id").alias("number")).alias("properties"),
    )
    feature = numbered(polygons.select("poly_id", shape.alias("f")), "poly_id")
    path = shared_path(spark, "mask")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "f"))), lambda x: x["f"])
    collection = feature.groupBy(F.floor(F.col("place") / 1024).alias("part")).agg(F.min("place").alias("first"), listed.alias("features"))
    collection.select(F.lit("FeatureCollection").alias("type"), "first", "features").write.json(path)
    found = geometry.read_mask(spark, path, lines=True)
    return found.select((F.col("poly_id") / 1_000_000).cast("bigint").alias("feature"), "ring_id", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query
def area_documents(spark, folder):
    """Observations as nested documents of 64 points each, written gzipped and read back as a long table."""
    rows = observations(spark, folder).withColumn("time_str", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    named = rows.select("point_id", "lat", "lon", F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_point_specific"), "time_str", "u", "v", "temperature", "salinity")
    nested = area.document(named, "point_id").withColumn("doc", F.floor(F.col("point_id") / 64)).drop("point_id")
    path = shared_path(spark, "area")
    write_document(area.with_metadata(nested, "doc", ["current", "temperature", "salinity"]), path)
    found = area.long_table(area.read_area(spark, path))
    values = [r6(F.col(c)).alias(c) for c in ("lat", "lon", "u", "v", "temperature", "salinity")]
    return found.select("time_str", "seq", "is_point_specific", *values)


@query
def document_sizes(spark, folder):
    """Events written as documents by kind, one kind written again: rows and bytes by the manifest, and rows read back."""
    spark.dataSource.register(Documents)
    rows = table(spark, folder, "events")
    body = F.to_json(F.struct("event_id", "user_id", "event_type")).alias("body")
    path = shared_path(spark, "documents")
    for part in (rows, rows.where("event_type = 'click' AND value > 250")):
        part.select(F.col("event_type").alias("kind"), body).write.format("documents_by_kind").mode("append").save(path)
    listed = spark.createDataFrame(Folder(path).manifest(), "kind string, file string, rows long, raw_bytes long, bytes long")
    sizes = listed.groupBy("kind").agg(
        F.sum("rows").alias("n_rows"), F.sum("raw_bytes").alias("raw_bytes"), (F.sum("bytes") < F.sum("raw_bytes")).alias("smaller")
    )
    back = spark.read.format("documents_by_kind").load(path).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_read"), F.max(F.get_json_object("body", "$.event_id").cast("long")).alias("last_event")
    )
    return sizes.join(back, "kind")


@query
def refreshed_table(spark, folder):
    """Rows by user of a table's first version, read after it was refreshed, and of its second."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    versions = Versions(spark, shared_path(spark, "versions"))
    versions.write(rows.where("event_type <> 'click'"))
    open_ = versions.read()
    versions.write(rows)
    counted = lambda frame, name: frame.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")).withColumn("version", F.lit(name))
    return counted(open_, "first").unionByName(counted(versions.read(), "second"))


@query
def image_of_hour(spark, folder):
    """The picture of each hour of each day by the metadata of all pictures, written and read back."""
    rows = observations(spark, folder)
    times = rows.select(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"))
    listed = times.distinct().agg(F.sort_array(F.collect_list("time")).alias("timestamps"))
    meta = listed.select(F.explode(F.array(*[F.lit(p) for p in PARAMETERS])).alias("parameter"), "timestamps")
    path = shared_path(spark, "metadata")
    write_document(meta, path)
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    asked = rows.select(day().alias("day")).distinct().select("day", hours.alias("h")).select(F.concat("day", F.lit("T"), F.lpad(F.col("h").cast("string"), 2, "0")).alias("hour"))
    return catalog.images_for_hours(catalog.raster_metadata(spark, path), asked)
