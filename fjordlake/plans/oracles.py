"""DuckDB SQL that says the same as the registered queries."""

from __future__ import annotations

from ..constants import ARROW_COLOURS, ARROW_TOP, CONTROL_POINTS, FUTURE, KNOT_BINS, MONTHS, PAST, RAMPS, REGIONS, WEEKDAYS, rgb
from .fixtures import BASE, DAY, HOLE, LAT, LON, OUTER, RADIUS, RINGS, TOLERANCE


def _d(x) -> str:
    return f"{x!r}::DOUBLE"


def _values(rows) -> str:
    cell = lambda x: f"'{x}'" if isinstance(x, str) else _d(x) if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)


_OBS = """obs AS (SELECT event_id, user_id AS point_id, 54.9::DOUBLE + (user_id*37 % 470)/100::DOUBLE AS lat,
 10.3::DOUBLE + (user_id*61 % 630)/100::DOUBLE AS lon, ts, (event_id*17 % 401 - 200)/100::DOUBLE AS u,
 (event_id*29 % 401 - 200)/200::DOUBLE AS v,
 CASE WHEN event_type<>'error' THEN value/20::DOUBLE - 1::DOUBLE END AS temperature,
 CASE WHEN event_type<>'view' THEN value/15::DOUBLE END AS salinity, event_type FROM events),
pts AS (SELECT DISTINCT point_id, lat, lon FROM obs)"""
_REGION = "region(idx, region, lon_min, lon_max, lat_min, lat_max, lat_offset, lon_offset) AS (VALUES " + _values(
    (i, *r) for i, r in enumerate(REGIONS)
) + ")"
_CONTROL = "control(lat, lon, name) AS (VALUES " + _values(CONTROL_POINTS) + ")"
_RING = "ring(poly_id, ring_id, seq, x, y) AS (VALUES " + _values(
    (p, r, i, x, y) for p, r, corners in RINGS for i, (x, y) in enumerate(corners)
) + """), edge AS (SELECT * FROM (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
 FROM ring WINDOW w AS (PARTITION BY poly_id, ring_id ORDER BY seq)) WHERE x2 IS NOT NULL)"""
_RINGS_OF = "corner(ring_id, seq, dx, dy) AS (VALUES " + _values(
    (k, i, x, y) for k, corners in enumerate((OUTER, HOLE)) for i, (x, y) in enumerate(corners)
) + """), sized AS (SELECT point_id, lat, lon, count(*) AS n, 0.1::DOUBLE + count(*) % 5 * 0.1::DOUBLE AS hx,
 0.1::DOUBLE + count(*) FILTER (event_type = 'error') % 4 * 0.08::DOUBLE AS hy FROM obs GROUP BY ALL),
ring AS (SELECT point_id AS poly_id, ring_id::INT AS ring_id, seq::INT AS seq, lon + dx*hx AS x, lat + dy*hy AS y FROM sized, corner WHERE ring_id = 0 OR n % 3 = 0),
edge AS (SELECT * FROM (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
 FROM ring WINDOW w AS (PARTITION BY poly_id, ring_id ORDER BY seq)) WHERE x2 IS NOT NULL)"""
_CROSS = """CASE WHEN least(y1,y2) <= lat AND lat < greatest(y1,y2)
 THEN (lon < x1 + (lat - y1)*(x2 - x1)/(y2 - y1))::INT ELSE 0 END"""
_ON = """((x2-x1)*(lat-y1) - (y2-y1)*(lon-x1) = 0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2)
 AND lat BETWEEN least(y1,y2) AND greatest(y1,y2))"""
_IN_REGION = "lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max"
_AREA = "(lon_max - lon_min)*(lat_max - lat_min)"
_DAY = f"ts >= TIMESTAMP '{DAY}' AND ts < TIMESTAMP '{DAY}' + INTERVAL 1 DAY"
_SPEED = "sqrt(u*u+v*v)"
_HOUR = f"floor((epoch_us(ts) - epoch_us(TIMESTAMP '{BASE}'))/1000000::DOUBLE/3600 + 0.5::DOUBLE)::BIGINT"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _inside(cells: str, key: str) -> str:
    return f"""sides AS (SELECT {key}, poly_id, sum({_CROSS}) % 2 = 1 AS odd, bool_or({_ON}) AS on_edge
 FROM {cells} JOIN edge ON least(y1,y2) <= lat AND lat <= greatest(y1,y2) GROUP BY ALL),
 wet AS (SELECT DISTINCT {key} FROM sides WHERE odd AND NOT on_edge)"""


def _lattice(n: int) -> str:
    return f"""cells AS (SELECT a.i::INT AS i, b.j::INT AS j, (a.i*{n}+b.j)::INT AS cell,
 54.9::DOUBLE + a.i*(59.6::DOUBLE-54.9::DOUBLE)/{n - 1}::DOUBLE AS lat, 10.3::DOUBLE + b.j*(16.6::DOUBLE-10.3::DOUBLE)/{n - 1}::DOUBLE AS lon
 FROM range({n}) a(i), range({n}) b(j))"""


def _piecewise(x: str, stops: list[tuple[float, float]]) -> str:
    out = f"CASE WHEN {x} < {_d(float(stops[0][0]))} THEN {_d(float(stops[0][1]))}"
    for (a, p), (b, q) in zip(stops, stops[1:]):
        out += f" WHEN {x} < {_d(float(b))} THEN {_d(float(p))} + ({x} - {_d(float(a))})*{_d(float(q) - float(p))}/{_d(float(b) - float(a))}"
    return out + f" ELSE {_d(float(stops[-1][1]))} END"


def _whole(x: str) -> str:
    return f"floor({x} + 0.5::DOUBLE)::INT"


def _ramp(parameter: str, value: str) -> str:
    stops = RAMPS[parameter]
    low, high = stops[0][0], stops[-1][0]
    level = f"(least(greatest(floor(({value} - {_d(low)})/{_d(high - low)}*256),0),255)/255::DOUBLE)"
    parts = [_whole(_piecewise(level, [((at - low) / (high - low), rgb(c)[k]) for at, c in stops])) for k in range(3)]
    cells = ", ".join(f"CASE WHEN {value} IS NOT NULL THEN {p} END AS {n}" for p, n in zip(parts, "rgb"))
    return f"SELECT '{parameter}' AS parameter, {cells} FROM obs"


def _arrow(k: int) -> str:
    step = ARROW_TOP / (len(ARROW_COLOURS) - 1)
    return _whole(_piecewise(_SPEED, [(i * step, rgb(c)[k]) for i, c in enumerate(ARROW_COLOURS)]))


def _progress(share: str, table) -> str:
    parts = [f"floor({_piecewise(share, [(at, c[k]) for at, *c in table])} + 0.5::DOUBLE)::BIGINT::VARCHAR" for k in range(3)]
    return "'rgb(' || " + " || ',' || ".join(parts) + " || ')'"


def _names(number: str, names: list[str], first: int) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, first)) + " END"


def _sun(date: str) -> str:
    """Columns rise, fall, summer for a relation s(date, ...)."""
    return f"""s1 AS (SELECT *, (date - DATE '1970-01-01') + 2440588 AS jd,
 (SELECT max(d) FROM (SELECT make_date(year(date)::INT, 3, k::INT) AS d FROM range(25, 32) q(k)) WHERE dayofweek(d) = 0) AS spring,
 (SELECT max(d) FROM (SELECT make_date(year(date)::INT, 10, k::INT) AS d FROM range(25, 32) q(k)) WHERE dayofweek(d) = 0) AS autumn FROM {date}),
 s2 AS (SELECT *, date >= spring AND date < autumn AS summer, ceil(jd - 2451545::DOUBLE + 0.0008::DOUBLE) - 13.0007::DOUBLE/360 AS noon FROM s1),
 s3 AS (SELECT *, radians((357.5291::DOUBLE + 0.98560028::DOUBLE*noon) % 360) AS m FROM s2),
 s4 AS (SELECT *, radians(((357.5291::DOUBLE + 0.98560028::DOUBLE*noon) % 360 + 1.9148::DOUBLE*sin(m) + 0.02::DOUBLE*sin(m*2)
  + 0.0003::DOUBLE*sin(m*3) + 282.9372::DOUBLE) % 360) AS l FROM s3),
 s5 AS (SELECT *, 2451545::DOUBLE + noon + 0.0053::DOUBLE*sin(m) - 0.0069::DOUBLE*sin(l*2) AS transit,
  sin(l)*sin(radians(23.4397::DOUBLE)) AS tilt FROM s4),
 s6 AS (SELECT *, degrees(acos((sin(radians(-0.833::DOUBLE)) - sin(radians(55.6061::DOUBLE))*tilt)
  / (cos(radians(55.6061::DOUBLE))*cos(asin(tilt)))))/360 AS half FROM s5),
 sun AS (SELECT *, floor((floor((transit - half - 2440587.5::DOUBLE)*86400000) + (1 + summer::INT)*3600000) % 86400000 / 1000)/3600 AS rise,
  floor((floor((transit + half - 2440587.5::DOUBLE)*86400000) + (1 + summer::INT)*3600000) % 86400000 / 1000)/3600 AS fall FROM s6)"""


_LABEL = """CASE WHEN hour = 0 THEN 'Nu' ELSE (CASE WHEN hour > 0 THEN '+' ELSE '-' END) ||
 CASE WHEN abs(hour) >= 24 THEN (abs(hour)//24)::VARCHAR || 'd ' ELSE '' END || (abs(hour) % 24)::VARCHAR || 'h' END"""
_LONG = """'+' || CASE WHEN floor(hour/24::DOUBLE) > 0 THEN floor(hour/24::DOUBLE)::BIGINT::VARCHAR ||
 CASE WHEN floor(hour/24::DOUBLE) > 1 THEN ' dagar ' ELSE ' dag ' END ELSE '' END || (hour % 24)::VARCHAR || 'h'"""
_NEAREST = """nearest AS (SELECT target, arg_min(h, (abs(h - target), h)) AS nearest FROM targets, avail GROUP BY target)"""
_NEAR_CONTROL = """near AS (SELECT c.name, any_value(c.lat) AS lat, any_value(c.lon) AS lon,
 arg_min(p.point_id, ((p.lon-c.lon)*(p.lon-c.lon)+(p.lat-c.lat)*(p.lat-c.lat), p.point_id)) AS point_id FROM control c, pts p GROUP BY c.name)"""
_SESSION = """marked AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL {gap}, true)::INT AS fresh FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM marked)"""

ORACLES: dict[str, str] = {
    "arrows_at_hour": _with(_OBS, _REGION, _CONTROL) + f"""
, f AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ts, event_id) AS k FROM obs WHERE {_DAY})
SELECT point_id, lat, lon, round({_SPEED}, 6) AS magnitude, round(90 - degrees(atan2(v, u)), 6) AS rotation,
 coalesce((SELECT arg_min(region, ({_AREA}, idx)) FROM region WHERE {_IN_REGION}), 'Default_Östersjön') AS region
FROM f WHERE k = 1 AND u <> 0 AND v <> 0 AND {_SPEED} >= 0.01::DOUBLE
 AND NOT EXISTS (SELECT 1 FROM control c WHERE abs(c.lat - f.lat) < 0.001::DOUBLE AND abs(c.lon - f.lon) < 0.001::DOUBLE)""",
    "vector_magnitude_bearing": _with(_OBS) + f"""
SELECT event_id, round({_SPEED}, 6) AS magnitude, round(degrees(atan2(u, v)), 6) AS bearing, round(90 - degrees(atan2(v, u)), 6) AS rotation,
 round(2*6371::DOUBLE*asin(sqrt(pow(sin(radians({_d(LAT)} - lat)/2), 2) + cos(radians(lat))*cos(radians({_d(LAT)}))*pow(sin(radians({_d(LON)} - lon)/2), 2))), 4) AS away_km,
 round(sqrt((lat - {_d(LAT)})*(lat - {_d(LAT)}) + (lon - {_d(LON)})*(lon - {_d(LON)})), 6) AS away_degrees FROM obs""",
    "knots_bins": _with(_OBS) + f""", k AS (SELECT {_SPEED}*1.944::DOUBLE AS s FROM obs)
SELECT (CASE {" ".join(f"WHEN s < {_d(t)} THEN {i}" for i, t in enumerate(KNOT_BINS, 1))} ELSE 10 END)::INT AS bin, count(*) AS n,
 round(min(s), 6) AS least, round(max(s), 6) AS most, count(*) FILTER (s < 1) AS n_slow FROM k GROUP BY 1""",
    "hour_offsets": _with(_OBS) + f""", h AS (SELECT event_id, ts, {_HOUR} AS hour FROM obs)
SELECT event_id, hour, {_LABEL} AS label, {_LONG} AS long_label, ((hour % 24) + 24) % 24 AS of_day,
 strftime(ts, '%Y-%m-%dT%H') AS prefix, date_trunc('hour', ts) AS base FROM h""",
    "file_names": _with(_OBS) + """, s AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp FROM obs)
SELECT event_id, stamp, 'current_magnitude_' || replace(replace(stamp, ':', '-'), '+', 'plus') || '.png' AS file FROM s""",
    "nearest_available_hour": _with(_OBS, f"targets AS (SELECT DISTINCT {_HOUR} AS target FROM obs)", f"avail AS (SELECT DISTINCT {_HOUR} AS h FROM obs WHERE event_type = 'error')", _NEAREST) + "SELECT target, nearest FROM nearest",
    "hour_steps": _with(_OBS, f"steps AS (SELECT hour, step::INT AS step, hour + step AS target FROM (SELECT DISTINCT {_HOUR} AS hour FROM obs), (VALUES (-24), (-1), (1), (24)) s(step))", "targets AS (SELECT DISTINCT target FROM steps)", f"avail AS (SELECT DISTINCT {_HOUR} AS h FROM obs WHERE event_type = 'error')", _NEAREST) + """
SELECT hour, step, nearest, floor(least(greatest((hour + 400)/700::DOUBLE, 0), 1)*240 - 120 + 0.5::DOUBLE)::BIGINT AS slider,
 CASE WHEN floor((hour + 400)/700::DOUBLE*240 - 120 + 0.5::DOUBLE) BETWEEN -120 AND 120 THEN floor((hour + 400)/700::DOUBLE*240 - 120 + 0.5::DOUBLE)::BIGINT END AS knob FROM steps JOIN nearest USING (target)""",
    "first_entry_per_point": _with(_OBS) + """, f AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY point_id, ts::DATE ORDER BY ts, event_id) AS k FROM obs)
SELECT point_id, day, round(temperature, 6) AS temperature FROM f WHERE k = 1 AND temperature IS NOT NULL""",
    "series_by_point": _with(_OBS) + """SELECT point_id, count(*) AS n, min(ts) AS first_ts, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM obs GROUP BY point_id""",
    "series_validity": _with(_OBS) + """SELECT point_id, bool_and(temperature IS NOT NULL AND salinity IS NOT NULL AND event_type <> 'click') AS all_valid,
 bool_or(temperature IS NOT NULL OR salinity IS NOT NULL OR event_type = 'click') AS any_valid, count(*) FILTER (event_type = 'click' OR salinity IS NOT NULL) AS n_salinity FROM obs GROUP BY point_id""",
    "merge_parameter_batches": _with(_OBS) + """, a AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ts, event_id) - 1 AS k FROM obs),
b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ts, event_id) - 1 AS k FROM obs WHERE event_type <> 'error')
SELECT a.point_id AS position, a.k::INT AS k, (CASE WHEN a.event_type <> 'click' THEN 2 ELSE 1 END)::INT AS n_values,
 round(CASE WHEN b.event_type = 'purchase' THEN -b.u ELSE a.u END, 6) AS u, round(a.v, 6) AS v,
 round(CASE WHEN b.event_type <> 'click' THEN b.v ELSE a.temperature END, 6) AS temperature,
 round(CASE WHEN a.event_type <> 'click' THEN a.salinity END, 6) AS salinity
FROM a LEFT JOIN b ON b.point_id = a.point_id AND b.k = a.k AND b.ts = a.ts""",
    "union_control_points": _with(_OBS, _CONTROL) + """SELECT point_id, lat, lon, NULL::VARCHAR AS name, false AS is_point_specific FROM pts
UNION ALL SELECT NULL::BIGINT, lat, lon, name, true FROM control""",
    "dedup_by_key": _with(_OBS) + """SELECT round(lat*10000)::BIGINT AS lat_key, round(lon*10000)::BIGINT AS lon_key, round(arg_min(lat, (ts, event_id)), 6) AS lat,
 round(arg_min(lon, (ts, event_id)), 6) AS lon, round(arg_max(temperature, (ts, event_id)) FILTER (temperature IS NOT NULL), 6) AS temperature,
 round(arg_max(salinity, (ts, event_id)) FILTER (salinity IS NOT NULL), 6) AS salinity FROM obs GROUP BY 1, 2""",
    "keyed_series": _with(_OBS) + "SELECT round(lat*1000)::BIGINT AS lat_key, round(lon*1000)::BIGINT AS lon_key, count(*) AS n, max(event_id) AS last_event FROM obs GROUP BY 1, 2",
    "region_offset": _with(_OBS, _REGION) + f""", m AS (SELECT point_id, arg_min(idx, ({_AREA}, idx)) AS idx FROM pts JOIN region ON {_IN_REGION} GROUP BY point_id)
SELECT point_id, region, lat_offset, lon_offset FROM pts LEFT JOIN m USING (point_id) JOIN region ON region.idx = coalesce(m.idx, 25)""",
    "region_summary": _with(_OBS, _REGION) + f""", m AS (SELECT point_id, arg_min(idx, ({_AREA}, idx)) AS idx FROM pts JOIN region ON {_IN_REGION} GROUP BY point_id),
c AS (SELECT coalesce(m.idx, 25) AS idx, count(*) AS n FROM pts LEFT JOIN m USING (point_id) GROUP BY 1)
SELECT idx::INT AS idx, region, round({_AREA}, 6) AS area, round((lon_min + lon_max)/2, 6) AS centre_lon, round((lat_min + lat_max)/2, 6) AS centre_lat,
 coalesce(n, 0) AS n_points FROM region LEFT JOIN c USING (idx)""",
    "overlay_corners": _with(_OBS, _REGION) + f""", b AS (SELECT strftime(ts, '%Y-%m-%d') AS day, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, (min(lon) + max(lon))/2 AS lon, (min(lat) + max(lat))/2 AS lat FROM obs GROUP BY 1),
m AS (SELECT day, arg_min(idx, ({_AREA}, idx)) AS idx FROM b JOIN region ON {_IN_REGION} GROUP BY day),
r AS (SELECT b.*, lat_offset, lon_offset FROM b LEFT JOIN m USING (day) JOIN region ON region.idx = coalesce(m.idx, 25))
SELECT day, corner::INT AS corner, round(CASE WHEN corner IN (0, 3) THEN west ELSE east END + lon_offset, 6) AS lon, round(CASE WHEN corner < 2 THEN north ELSE south END + lat_offset, 6) AS lat
FROM r, range(4) c(corner)""",
    "exclude_control_points": _with(_OBS, _CONTROL) + f""", m AS (SELECT event_id, c.name, c.lat + (event_id % 31 - 15)/10000::DOUBLE AS lat, c.lon + (event_id % 31 - 15)/10000::DOUBLE AS lon
 FROM obs JOIN (VALUES {", ".join(f"({i}, '{n}')" for i, (_, _, n) in enumerate(CONTROL_POINTS))}) k(i, name) ON k.i = event_id % {len(CONTROL_POINTS)} JOIN control c ON c.name = k.name)
SELECT name, count(*) AS n, round(max(lat), 6) AS north FROM m
WHERE NOT EXISTS (SELECT 1 FROM control c WHERE abs(c.lat - m.lat) < 0.001::DOUBLE AND abs(c.lon - m.lon) < 0.001::DOUBLE) GROUP BY name""",
    "deterministic_sample": _with(_OBS) + "SELECT point_id, lat, lon FROM pts WHERE (floor(lat*1000)::BIGINT + floor(lon*1000)::BIGINT) % 20 = 0",
    "bbox_filter": _with(_OBS) + "SELECT point_id, count(*) AS n, round(max(u), 6) AS max_u FROM obs WHERE lon BETWEEN 7.5::DOUBLE AND 13.5::DOUBLE AND lat BETWEEN 54.5::DOUBLE AND 58.0::DOUBLE GROUP BY point_id",
    "first_lattice_points": _with(_OBS, _RINGS_OF).replace("WITH", "WITH RECURSIVE", 1) + f""", y(i, lat) AS (SELECT 0, 54.9::DOUBLE UNION ALL SELECT i + 1, lat + 0.1::DOUBLE FROM y WHERE lat + 0.1::DOUBLE <= 59.6::DOUBLE),
x(j, lon) AS (SELECT 0, 10.3::DOUBLE UNION ALL SELECT j + 1, lon + 0.1::DOUBLE FROM x WHERE lon + 0.1::DOUBLE <= 16.6::DOUBLE),
l AS (SELECT i::INT AS i, j::INT AS j, i*1000 + j AS cell, round(lat, 4) AS lat, round(lon, 4) AS lon FROM y, x
 WHERE round(lon, 4) BETWEEN 11.0::DOUBLE AND 13.5::DOUBLE AND round(lat, 4) BETWEEN 55.5::DOUBLE AND 58.0::DOUBLE), {_inside("l", "cell")}
SELECT i, j, lat, lon FROM l JOIN wet USING (cell) ORDER BY i, j LIMIT 100""",
    "tolerance_topk": _with(_OBS) + f""", a AS (SELECT point_id, sqrt((lat - {_d(LAT)})*(lat - {_d(LAT)}) + (lon - {_d(LON)})*(lon - {_d(LON)})) AS dist FROM pts
 WHERE abs(lat - {_d(LAT)}) <= {_d(TOLERANCE)} AND abs(lon - {_d(LON)}) <= {_d(TOLERANCE)} ORDER BY dist, point_id LIMIT 3),
b AS (SELECT point_id, sqrt((lat - 40::DOUBLE)*(lat - 40::DOUBLE) + (lon - {_d(LON)})*(lon - {_d(LON)})) AS dist
 FROM (SELECT * FROM pts ORDER BY point_id LIMIT 100) ORDER BY dist, point_id LIMIT 5)
SELECT point_id, round(dist, 6) AS dist, true AS in_box FROM a UNION ALL SELECT point_id, round(dist, 6), false FROM b""",
    "radius_stats": _with(_OBS) + f"""SELECT count(*) AS n, round(min({_SPEED}*1.944::DOUBLE), 6) AS min_knots, round(max({_SPEED}*1.944::DOUBLE), 6) AS max_knots FROM obs
WHERE sqrt((lat - {_d(LAT)})*(lat - {_d(LAT)}) + (lon - {_d(LON)})*(lon - {_d(LON)})) <= {_d(RADIUS)}""",
    "coverage_counts": _with(_OBS) + """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) AS n_current, count(temperature) AS n_temperature, count(salinity) AS n_salinity,
 count(*) FILTER (temperature IS NOT NULL AND temperature <> 0) AS nonzero_temperature FROM obs GROUP BY 1""",
    "bbox_gaps": _with(_OBS) + """, g AS (SELECT min(lon) - 10.3::DOUBLE AS west, 16.6::DOUBLE - max(lon) AS east, min(lat) - 54.9::DOUBLE AS south, 59.6::DOUBLE - max(lat) AS north FROM obs)
SELECT round(west, 6) AS west, round(east, 6) AS east, round(south, 6) AS south, round(north, 6) AS north, round(west*111, 6) AS west_km, round(east*111, 6) AS east_km,
 round(south*111, 6) AS south_km, round(north*111, 6) AS north_km FROM g""",
    "raster_stats_by_hour": _with(_OBS) + """, s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, salinity - 2 AS x, CASE WHEN salinity - 2 < 0 THEN 0::DOUBLE ELSE salinity - 2 END AS y FROM obs)
SELECT day, round(min(y), 6) AS least, round(max(y), 6) AS most, round(avg(y), 4) AS mean, count(y) AS n, count(*) FILTER (x IS NULL) AS n_missing,
 count(*) FILTER (x < 0) AS n_negative, round(count(*) FILTER (x IS NULL)/count(*)::DOUBLE*100, 6) AS missing_share FROM s GROUP BY day""",
    "point_in_polygon": _with(_OBS, _RINGS_OF, _inside("pts", "point_id")) + "SELECT point_id, poly_id::BIGINT AS poly_id, false AS closed FROM sides WHERE odd AND NOT on_edge UNION ALL SELECT point_id, poly_id::BIGINT, true FROM sides WHERE odd OR on_edge",
    "water_semi_join": _with(_OBS, _RINGS_OF, _inside("pts", "point_id")) + """SELECT point_id, count(*) AS n FROM obs WHERE (round(lat*10000)::BIGINT, round(lon*10000)::BIGINT) IN
 (SELECT (round(lat*10000)::BIGINT, round(lon*10000)::BIGINT) FROM pts JOIN wet USING (point_id)) GROUP BY point_id""",
    "mask_grid": _with(_OBS, _RINGS_OF, _lattice(48), _inside("cells", "cell")) + "SELECT i, count(*) AS n, min(j) AS first_j, max(j) AS last_j FROM cells JOIN wet USING (cell) GROUP BY i",
    "mask_bounds": _with(_OBS, _RINGS_OF) + """SELECT min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north, 'all' AS of FROM ring UNION ALL
SELECT min(x), max(x), min(y), max(y), 'outer' FROM ring WHERE ring_id = 0 AND poly_id < 3 UNION ALL SELECT 7.5::DOUBLE, 13.5::DOUBLE, 54.5::DOUBLE, 58::DOUBLE, 'none'""",
    "polygon_report": _with(_OBS, _RINGS_OF) + f""", p AS (SELECT *, {_d(LON)} AS lon, {_d(LAT)} AS lat, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS size FROM edge),
q AS (SELECT *, least(greatest(((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/size, 0), 1) AS t FROM p)
SELECT poly_id::BIGINT AS poly_id, round(min(least(x1,x2)), 6) AS west, round(max(greatest(x1,x2)), 6) AS east, round(min(least(y1,y2)), 6) AS south, round(max(greatest(y1,y2)), 6) AS north, sum({_CROSS}) % 2 = 1 AS holds,
 round(CASE WHEN sum({_CROSS}) % 2 = 1 THEN 0::DOUBLE ELSE min(sqrt(pow(x1+t*(x2-x1)-lon, 2)+pow(y1+t*(y2-y1)-lat, 2))) END, 6) AS distance FROM q GROUP BY poly_id""",
    "edge_nearest": _with(_OBS) + """, o AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM obs WHERE temperature IS NOT NULL),
e AS (SELECT s*25 + k AS id, s, k/24::DOUBLE AS f FROM range(4) a(s), range(25) b(k)),
p AS (SELECT id, CASE WHEN s < 2 THEN 10.3::DOUBLE + f*(16.6::DOUBLE-10.3::DOUBLE) WHEN s = 2 THEN 10.3::DOUBLE ELSE 16.6::DOUBLE END AS lon,
 CASE WHEN s = 0 THEN 54.9::DOUBLE WHEN s = 1 THEN 59.6::DOUBLE ELSE 54.9::DOUBLE + f*(59.6::DOUBLE-54.9::DOUBLE) END AS lat FROM e)
SELECT day, id::INT AS id, round(any_value(p.lon), 6) AS lon, round(any_value(p.lat), 6) AS lat,
 round(arg_min(temperature, ((o.lon-p.lon)*(o.lon-p.lon)+(o.lat-p.lat)*(o.lat-p.lat), event_id)), 6) AS temperature FROM p, o GROUP BY day, id""",
    "nearest_raster": _with(_OBS, _RINGS_OF, _lattice(24), _inside("cells", "cell")) + f""", o AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, {_SPEED} AS speed FROM obs),
n AS (SELECT day, cell, arg_min(speed, ((o.lon-c.lon)*(o.lon-c.lon)+(o.lat-c.lat)*(o.lat-c.lat), event_id)) AS speed FROM cells c, o GROUP BY day, cell)
SELECT day, i, j, CASE WHEN wet.cell IS NOT NULL THEN round(speed, 6) END AS speed FROM cells JOIN n USING (cell) LEFT JOIN wet USING (cell)""",
    "color_ramp": _with(_OBS) + ", c AS (" + " UNION ALL ".join([_ramp("current", _SPEED), _ramp("temperature", "temperature"), _ramp("salinity", "salinity")]) + ") SELECT parameter, r, g, b, count(*) AS n FROM c GROUP BY ALL",
    "arrow_color": _with(_OBS) + f"SELECT event_id, {_arrow(0)} AS r, {_arrow(1)} AS g, {_arrow(2)} AS b FROM obs",
    "progress_colors": _with(_OBS) + f""", h AS (SELECT DISTINCT {_HOUR} AS hour FROM obs)
SELECT hour, CASE WHEN hour = 0 THEN 'rgb(255, 223, 0)' WHEN hour < 0 THEN {_progress("least(abs(hour)/340::DOUBLE, 1::DOUBLE)", PAST)}
 ELSE {_progress("least(hour/380::DOUBLE, 1::DOUBLE)", FUTURE)} END AS colour FROM h""",
    "legend_stops": _with(_OBS) + f""", s AS (SELECT parameter, idx::INT AS idx, value::DOUBLE AS value, colour, n, lead(value::DOUBLE) OVER (PARTITION BY parameter ORDER BY idx) AS until FROM (VALUES """ + _values((p, i, v, c, len(s)) for p, s in RAMPS.items() for i, (v, c) in enumerate(s)) + f""") t(parameter, idx, value, colour, n)),
p AS (SELECT {_SPEED} AS current, temperature, salinity - 2 AS salinity FROM obs), val AS (UNPIVOT p ON current, temperature, salinity INTO NAME parameter VALUE x)
SELECT s.parameter, idx, s.value, colour, round(idx/(n-1)::DOUBLE*100, 6) AS share, (SELECT count(*) FROM val WHERE val.parameter = s.parameter AND x >= s.value AND (until IS NULL OR x < until)) AS n_observations FROM s""",
    "sun_times": _with("days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)", _sun("days")) + "SELECT strftime(date, '%Y-%m-%d') AS date, round(rise, 4) AS rise, round(fall, 4) AS fall, summer FROM sun",
    "day_night_opacity": _with(_OBS, "days AS (SELECT DISTINCT ts::DATE AS date FROM obs)", _sun("days")) + """
, t AS (SELECT event_id, hour(ts) AS h, rise, fall FROM obs JOIN sun ON ts::DATE = date),
o AS (SELECT *, CASE WHEN h BETWEEN rise - 1 AND rise + 1 THEN 0.5::DOUBLE*(1 - cos((h - (rise - 1))/2*pi()))
 WHEN h BETWEEN fall - 1 AND fall + 1 THEN 1 - 0.5::DOUBLE*(1 - cos((h - (fall - 1))/2*pi())) WHEN h BETWEEN rise AND fall THEN 1::DOUBLE ELSE 0::DOUBLE END AS s FROM t)
SELECT event_id, round(s, 4) AS sun, round(1 - s, 4) AS moon, h BETWEEN rise AND fall AS is_day FROM o""",
    "relative_day_label": _with(_OBS) + f""", l AS (SELECT event_id, ts + INTERVAL 1 HOUR AS t, date_diff('day', DATE '2024-01-15', (ts + INTERVAL 1 HOUR)::DATE) AS d FROM obs)
SELECT event_id, CASE d WHEN 0 THEN 'Idag' WHEN 1 THEN 'Imorgon' WHEN -1 THEN 'Igår' WHEN -2 THEN 'Överigår' ELSE {_names("dayofweek(t)", WEEKDAYS, 0)} END AS label,
 day(t)::VARCHAR || ' ' || {_names("month(t)", MONTHS, 1)} || ' ' || year(t)::VARCHAR AS full_date, hour(t)::INT AS local_hour FROM l""",
    "layout_classes": """WITH s AS (SELECT p_partkey, p_partkey*37 % 1400 + 200 AS w, p_partkey*53 % 1100 + 200 AS h FROM part),
l AS (SELECT *, CASE WHEN w >= 1200 THEN 'desktop' WHEN greatest(w,h) >= 720 AND least(w,h) >= 500 THEN 'tabletLandscape' WHEN w > h AND h <= 500 THEN 'mobileLandscape'
 WHEN h > w AND w <= 600 THEN 'mobilePortrait' ELSE 'tablet' END AS layout FROM s)
SELECT p_partkey, layout, layout IN ('desktop','tabletLandscape') AS sidebar, layout IN ('tablet','mobilePortrait','mobileLandscape') AS menu,
 layout IN ('mobilePortrait','mobileLandscape') AS slider, CASE WHEN w <= 375 THEN 'small' WHEN w <= 414 THEN 'medium' ELSE 'large' END AS screen,
 round(least(greatest(CASE WHEN w/h::DOUBLE > 1.4::DOUBLE THEN 6.5::DOUBLE - log2(h/600::DOUBLE) ELSE 6.2::DOUBLE - log2(w/400::DOUBLE) END, 6), 6.8::DOUBLE), 6) AS zoom,
 CASE WHEN layout IN ('mobilePortrait','mobileLandscape') THEN CASE WHEN p_partkey % 5 + 4 < 6 THEN 0.010::DOUBLE WHEN p_partkey % 5 + 4 < 7 THEN 0.013::DOUBLE ELSE 0.016::DOUBLE END ELSE 0.025::DOUBLE END AS arrow,
 least(greatest(w, 300), 900) AS held, round((w - 200)/1400::DOUBLE, 6) AS share FROM l""",
    "drag_sessions": _with(_SESSION.format(gap="2 HOURS")) + "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM grouped GROUP BY user_id, g",
    "debounced_last": _with(_SESSION.format(gap="30 MINUTES")) + "SELECT user_id, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_event FROM grouped GROUP BY user_id, g",
    "cube_decode": _with(_OBS) + """, p AS (SELECT point_id, salinity, row_number() OVER (PARTITION BY point_id ORDER BY event_id) - 1 AS pos FROM obs)
SELECT point_id, (pos // 6)::INT AS t, (pos // 3 % 2)::INT AS y, (pos % 3)::INT AS x, round(salinity, 6) AS value FROM p""",
    "coverage_scan": _with(_OBS) + f""", c AS (SELECT ts::DATE AS day, point_id % 5 AS y, point_id % 7 AS x, max(round({_SPEED}, 6)) AS speed, max(event_id)::DOUBLE AS event FROM obs GROUP BY ALL),
l AS (SELECT d.day, a.y, b.x, speed, event FROM (SELECT DISTINCT day FROM c) d, range(1, 5) a(y), range(0, 5) b(x) LEFT JOIN c ON c.day = d.day AND c.y = a.y AND c.x = b.x)
SELECT parameter, 55.0::DOUBLE + y AS lat, 10.0::DOUBLE + x AS lon, count(value) AS n, count(*) - count(value) AS n_missing, round(max(value), 6) AS most
FROM (SELECT y, x, 'speed' AS parameter, speed AS value FROM l UNION ALL SELECT y, x, 'event', event FROM l UNION ALL SELECT y, x, 'event', event FROM l) GROUP BY ALL""",
    "catalog_filter": """SELECT page_id, split_part(url, '?', 1) AS address, array_to_string(string_split(split_part(url, '?', 1), '/')[1:3], '/') AS head FROM pages WHERE contains(lower(url), 'a')""",
    "parameter_batches": "SELECT n_nationkey, n_name, ((row_number() OVER (ORDER BY n_nationkey) - 1)//4)::INT AS batch FROM nation",
    "skip_existing": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "parameter_ranges": _with(_OBS) + f"SELECT round(min({_SPEED}), 6) AS least, round(max({_SPEED}), 6) AS most, count(*) AS n, count(DISTINCT point_id) AS n_points, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM obs",
    "neighbour_mean": _with(_OBS) + """, f AS (SELECT floor((lat - 54.9::DOUBLE)*4)::INT AS i, floor((lon - 10.3::DOUBLE)*4)::INT AS j, avg(u) AS z FROM obs GROUP BY 1, 2),
a AS (SELECT i + di AS i, j + dj AS j, z FROM f, (VALUES (-1), (0), (1)) p(di), (VALUES (-1), (0), (1)) q(dj) WHERE di <> 0 OR dj <> 0)
SELECT i::INT AS i, j::INT AS j, round(avg(z), 4) AS z, count(*) AS n FROM a WHERE (i, j) NOT IN (SELECT (i, j) FROM f) GROUP BY i, j""",
    "dilated_raster": _with(_OBS).replace("WITH", "WITH RECURSIVE", 1) + f""", f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, floor((lat - 54.9::DOUBLE)*4)::INT AS i, floor((lon - 10.3::DOUBLE)*4)::INT AS j, avg({_SPEED}) AS z
 FROM obs WHERE event_type = 'error' GROUP BY ALL),
g AS (SELECT d.day, a.i::INT AS i, b.j::INT AS j, f.z FROM (SELECT DISTINCT day FROM f) d, range(19) a(i), range(26) b(j) LEFT JOIN f ON f.day = d.day AND f.i = a.i AND f.j = b.j),
r(k, day, i, j, z, sweep) AS (SELECT 0, day, i, j, z, CASE WHEN z IS NOT NULL THEN 0 END FROM g UNION ALL
 SELECT any_value(c.k) + 1, c.day, c.i, c.j, coalesce(any_value(c.z), CASE WHEN bool_or(n.z IS NOT NULL AND (n.i = c.i OR n.j = c.j)) THEN avg(n.z) END),
  coalesce(any_value(c.sweep), CASE WHEN any_value(c.z) IS NULL AND bool_or(n.z IS NOT NULL AND (n.i = c.i OR n.j = c.j)) THEN any_value(c.k) + 1 END)
 FROM r c JOIN r n ON n.day = c.day AND n.i BETWEEN c.i - 1 AND c.i + 1 AND n.j BETWEEN c.j - 1 AND c.j + 1 WHERE c.k < 20 GROUP BY c.day, c.i, c.j)
SELECT day, i, j, sweep::INT AS sweep, round(z, 4) AS z FROM r WHERE k = 20""",
    "arrow_features": _with(_OBS, _REGION) + f""", f AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM obs QUALIFY row_number() OVER (PARTITION BY point_id, ts::DATE ORDER BY ts, event_id) = 1),
a AS (SELECT *, coalesce((SELECT arg_min(region, ({_AREA}, idx)) FROM region WHERE {_IN_REGION}), 'Default_Östersjön') AS region, point_id % 4 + 5 AS zoom FROM f WHERE u <> 0 AND v <> 0)
SELECT day, region, (row_number() OVER (PARTITION BY day, region ORDER BY point_id) - 1)::INT AS k,
 'rgb(' || {_arrow(0)} || ', ' || {_arrow(1)} || ', ' || {_arrow(2)} || ')' AS color, round({_SPEED}, 6) AS magnitude, CASE WHEN point_id % 2 = 0 THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS opacity,
 round(90 - degrees(atan2(v, u)), 6) AS rotation, CASE WHEN point_id % 2 <> 0 THEN 0.025::DOUBLE WHEN zoom < 6 THEN 0.010::DOUBLE WHEN zoom < 7 THEN 0.013::DOUBLE ELSE 0.016::DOUBLE END AS size,
 round(lon, 6) AS lon, round(lat, 6) AS lat FROM a""",
    "region_of_boxes": _with(_OBS, _REGION) + f""", b AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, (min(lon) + max(lon))/2 AS lon, (min(lat) + max(lat))/2 AS lat FROM obs GROUP BY ALL),
m AS (SELECT day, event_type, arg_min(idx, ({_AREA}, idx)) AS idx FROM b JOIN region ON {_IN_REGION} GROUP BY ALL)
SELECT b.day, b.event_type, region, lat_offset, lon_offset FROM b LEFT JOIN m USING (day, event_type) JOIN region ON region.idx = coalesce(m.idx, 25)""",
    "dedup_by_key_and_time": _with(_OBS) + """, k AS (SELECT *, round(lat*1000)::BIGINT AS lat_key, round(lon*1000)::BIGINT AS lon_key, date_trunc('day', ts)::TIMESTAMP AS hour FROM obs),
p AS (SELECT lat_key, lon_key, arg_min(lat, (ts, event_id)) AS lat, arg_min(lon, (ts, event_id)) AS lon FROM k GROUP BY ALL)
SELECT lat_key, lon_key, hour, round(any_value(p.lat), 6) AS lat, round(any_value(p.lon), 6) AS lon,
 round(arg_max(temperature, (ts, event_id)) FILTER (temperature IS NOT NULL), 6) AS temperature, round(arg_max(salinity, (ts, event_id)) FILTER (salinity IS NOT NULL), 6) AS salinity
FROM k JOIN p USING (lat_key, lon_key) GROUP BY lat_key, lon_key, hour""",
    "control_point_series": _with(_OBS, _CONTROL, _NEAR_CONTROL) + """SELECT is_point_specific, name, round(lat, 6) AS lat, round(lon, 6) AS lon, count(*) AS n, min(ts) AS first_ts, round(max(temperature), 6) AS most
FROM (SELECT false AS is_point_specific, NULL::VARCHAR AS name, lat, lon, ts, temperature FROM obs UNION ALL
 SELECT true, c.name, c.lat, c.lon, ts, temperature FROM obs JOIN near c USING (point_id)) GROUP BY 1, 2, 3, 4""",
    "area_counts": _with(_OBS, _CONTROL, _NEAR_CONTROL, _RINGS_OF, _inside("pts", "point_id")) + """, q AS (SELECT lat, lon, false AS c, bool_or(temperature IS NOT NULL OR salinity IS NOT NULL) AS valid FROM obs GROUP BY lat, lon UNION ALL
 SELECT c.lat, c.lon, true, bool_or(temperature IS NOT NULL OR salinity IS NOT NULL) FROM obs JOIN near c USING (point_id) GROUP BY c.lat, c.lon)
SELECT count(*) AS n_points, count(*) FILTER (NOT c) AS n_grid, count(*) FILTER (c) AS n_control, count(*) FILTER (valid) AS n_valid,
 count(*) FILTER ((lat, lon) IN (SELECT (lat, lon) FROM pts JOIN wet USING (point_id))) AS n_water FROM q""",
    "keyed_maps": _with(_OBS) + """, k AS (SELECT round(lat*1000)::BIGINT AS lat_key, round(lon*1000)::BIGINT AS lon_key, max(event_id) AS last_event FROM obs GROUP BY ALL),
p AS (SELECT point_id, round(lat*1000)::BIGINT AS lat_key, round(lon*1000)::BIGINT AS lon_key FROM pts)
SELECT point_id, (SELECT count(*) FROM k WHERE k.lat_key = p.lat_key)::INT AS n_keys, h.last_event AS here, e.last_event AS east FROM p
 LEFT JOIN k h ON h.lat_key = p.lat_key AND h.lon_key = p.lon_key LEFT JOIN k e ON e.lat_key = p.lat_key AND e.lon_key = p.lon_key + 470""",
    "convex_hull": _with(_OBS) + f""", p AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, lon, lat FROM obs),
x AS (SELECT a.day, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_, c.lon AS cx, c.lat AS cy, (b.lon-a.lon)*(c.lat-a.lat) - (b.lat-a.lat)*(c.lon-a.lon) AS side
 FROM p a JOIN p b ON a.day = b.day AND (a.lon <> b.lon OR a.lat <> b.lat) JOIN p c ON c.day = a.day),
e AS (SELECT day, ax, ay, bx, by_ FROM x GROUP BY ALL HAVING bool_and(side > 1e-9 OR (abs(side) <= 1e-9 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, by_) AND greatest(ay, by_)))),
s AS (SELECT day, count(*) AS n_corners, bool_and((bx-ax)*({_d(LAT)}-ay) - (by_-ay)*({_d(LON)}-ax) > 0) AS holds,
 min(sqrt((ax-{_d(LON)})*(ax-{_d(LON)}) + (ay-{_d(LAT)})*(ay-{_d(LAT)}))) AS away FROM e GROUP BY day)
SELECT day, n_corners, holds, round(away, 6) AS corner_distance, round(ax, 6) AS lon, round(ay, 6) AS lat FROM e JOIN s USING (day)""",
    "first_of_area": _with(_OBS) + """, r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS rank FROM obs)
SELECT day, rank::INT AS rank, event_id FROM r WHERE rank <= 3""",
    "raster_job_statistics": _with(_OBS, _RINGS_OF, _lattice(32), _inside("cells", "cell")) + f""", p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id AS seq, lon, lat, {_SPEED} AS current, temperature, salinity - 2 AS salinity FROM obs),
val AS (UNPIVOT p ON current, temperature, salinity INTO NAME parameter VALUE value),
e AS (SELECT s*25 + k AS id, s, k/24::DOUBLE AS f FROM range(4) a(s), range(25) b(k)),
g AS (SELECT id, CASE WHEN s < 2 THEN 10.3::DOUBLE + f*(16.6::DOUBLE-10.3::DOUBLE) WHEN s = 2 THEN 10.3::DOUBLE ELSE 16.6::DOUBLE END AS lon,
 CASE WHEN s = 0 THEN 54.9::DOUBLE WHEN s = 1 THEN 59.6::DOUBLE ELSE 54.9::DOUBLE + f*(59.6::DOUBLE-54.9::DOUBLE) END AS lat FROM e),
h AS (SELECT parameter, day, id + 1000000000000 AS seq, any_value(g.lon) AS lon, any_value(g.lat) AS lat,
 arg_min(value, ((val.lon-g.lon)*(val.lon-g.lon)+(val.lat-g.lat)*(val.lat-g.lat), val.seq)) AS value FROM g, val GROUP BY parameter, day, id),
a AS (SELECT parameter, day, seq, lon, lat, value FROM val UNION ALL SELECT parameter, day, seq, lon, lat, value FROM h),
n AS (SELECT parameter, day, cell, arg_min(value, ((a.lon-c.lon)*(a.lon-c.lon)+(a.lat-c.lat)*(a.lat-c.lat), seq)) AS raw FROM cells c, a GROUP BY ALL),
z AS (SELECT parameter, day, CASE WHEN parameter <> 'temperature' AND raw < 0 THEN 0 ELSE raw END AS value FROM n JOIN wet USING (cell)),
c AS (SELECT parameter, day, count(*) AS n_points FROM val GROUP BY parameter, day)
SELECT parameter, day, any_value(n_points) AS n_points, count(*) AS n_values, 1024 - count(*) AS n_empty,
 round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 4) AS mean FROM z JOIN c USING (parameter, day) GROUP BY parameter, day""",
    "exact_time": _with(_OBS) + "SELECT event_id, point_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM obs WHERE ts = (SELECT ts FROM obs WHERE event_id = 7)",
    "hour_prefix": _with(_OBS) + f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time FROM obs WHERE starts_with(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '{DAY}T1')",
    "wanted_parameters": _with(_OBS) + f""", p AS (SELECT {_SPEED} AS current, temperature, salinity - 2 AS salinity FROM obs),
val AS (UNPIVOT p ON current, temperature, salinity INTO NAME parameter VALUE value)
SELECT asked, parameter, count(value) AS n, round(max(value), 6) AS most FROM val, (VALUES ('two'), ('all')) w(asked)
 WHERE asked = 'all' OR parameter IN ('salinity', 'temperature') GROUP BY ALL""",
    "first_images": _with(_OBS) + """, h AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM obs)
SELECT 'all' AS of, strftime(hour, '%Y-%m-%d %H') AS hour FROM h UNION ALL SELECT * FROM (SELECT 'first', strftime(hour, '%Y-%m-%d %H') FROM h ORDER BY hour LIMIT 5)""",
    "mask_document": _with(_OBS, _RINGS_OF) + "SELECT (dense_rank() OVER (ORDER BY poly_id) - 1)::BIGINT AS feature, ring_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM ring",
    "area_documents": _with(_OBS) + f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time_str,
 (row_number() OVER (PARTITION BY point_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), u, v, temperature, salinity) - 1)::INT AS seq, false AS is_point_specific,
 round(lat, 6) AS lat, round(lon, 6) AS lon, u, v, round(temperature, 6) AS temperature, round(salinity, 6) AS salinity FROM obs""",
    "document_sizes": """WITH w AS (SELECT * FROM events WHERE event_type <> 'click' OR value > 250)
SELECT event_type AS kind, count(*) AS n_rows, sum(strlen('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}') + 1)::BIGINT AS raw_bytes,
 true AS smaller, count(*) AS n_read, max(event_id) AS last_event FROM w GROUP BY event_type""",
    "refreshed_table": """SELECT user_id, count(*) AS n, max(event_id) AS last_event, 'first' AS version FROM events WHERE event_type <> 'click' GROUP BY user_id
UNION ALL SELECT user_id, count(*), max(event_id), 'second' FROM events GROUP BY user_id""",
    "image_of_hour": _with(_OBS) + """, t AS (SELECT DISTINCT strftime(ts, '%Y-%m-%dT%H') AS hour FROM obs),
a AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || 'T' || lpad(h::VARCHAR, 2, '0') AS hour FROM obs, range(24) r(h))
SELECT parameter, a.hour, t.hour || ':00:00.000Z' AS timestamp FROM a LEFT JOIN t ON t.hour = a.hour, (VALUES ('current'), ('temperature'), ('salinity')) p(parameter)""",
    "accepted_changes": """WITH RECURSIVE x AS (SELECT user_id, event_id, value/500 AS share, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, share, n, true AS kept, share AS last FROM x WHERE n = 1 UNION ALL
 SELECT x.user_id, x.event_id, x.share, x.n, abs(x.share - w.last) <= 0.5, CASE WHEN abs(x.share - w.last) <= 0.5 THEN x.share ELSE w.last END
 FROM w JOIN x ON x.user_id = w.user_id AND x.n = w.n + 1)
SELECT user_id, event_id, round(share, 6) AS share FROM w WHERE kept""",
    "throttled_events": """WITH RECURSIVE x AS (SELECT user_id, event_id, epoch_us(ts)//1000 AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, NULL::BIGINT AS late_id, NULL::BIGINT AS late_ms, event_id::BIGINT AS own_id, now AS own_ms, now + 21600000 AS due, NULL::BIGINT AS waiting FROM x WHERE n = 1 UNION ALL
 SELECT user_id, n, CASE WHEN fires THEN waiting END, CASE WHEN fires THEN due END, CASE WHEN opens THEN event_id END, CASE WHEN opens THEN now END,
  CASE WHEN opens THEN now + 21600000 ELSE next END, CASE WHEN opens THEN NULL ELSE event_id END
 FROM (SELECT *, now >= due AND now >= next AS opens FROM (SELECT *, CASE WHEN fires THEN due + 21600000 ELSE due END AS next
  FROM (SELECT x.user_id, x.n, x.event_id::BIGINT AS event_id, x.now, w.due, w.waiting, x.now >= w.due AND w.waiting IS NOT NULL AS fires
   FROM w JOIN x ON x.user_id = w.user_id AND x.n = w.n + 1))))
SELECT user_id, late_id AS event_id, late_ms AS emitted_ms FROM w WHERE late_id IS NOT NULL UNION ALL
SELECT user_id, own_id, own_ms FROM w WHERE own_id IS NOT NULL UNION ALL
SELECT user_id, waiting, due FROM w WHERE waiting IS NOT NULL AND (user_id, n) IN (SELECT (user_id, max(n)) FROM x GROUP BY user_id)""",
}
