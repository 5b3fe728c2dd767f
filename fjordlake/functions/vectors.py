"""Column expressions on vectors, distances and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_KM, KM_PER_DEGREE, KNOT_BINS, KNOTS


def magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def bearing(u: Column, v: Column) -> Column:
    """Degrees clockwise from north, in (-180, 180]."""
    return F.degrees(F.atan2(u, v))


def rotation(u: Column, v: Column) -> Column:
    """Degrees that turn an icon that points up, in [-90, 270)."""
    return F.lit(90.0) - F.degrees(F.atan2(v, u))


def planar(d_lat: Column, d_lon: Column) -> Column:
    return F.sqrt(d_lat * d_lat + d_lon * d_lon)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def knots(speed: Column) -> Column:
    return speed * F.lit(KNOTS)


def kilometres(degrees: Column) -> Column:
    return degrees * F.lit(KM_PER_DEGREE)


def knot_bin(speed: Column) -> Column:
    """Bin 1 to 10 of a speed in knots; each is open above."""
    out = F.lit(len(KNOT_BINS) + 1)
    for n, top in reversed(list(enumerate(KNOT_BINS, 1))):
        out = F.when(speed < top, n).otherwise(out)
    return F.when(speed.isNotNull(), out)


def is_slow(speed: Column) -> Column:
    return speed < 1.0


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clamp_parameter(parameter: Column, value: Column) -> Column:
    """Speeds and salinities are not negative; temperatures may be. Null stays null."""
    return F.when(parameter.isin("current", "salinity") & (value < 0), F.lit(0.0)).otherwise(value)


def normalise(x: Column, low, high) -> Column:
    span = F.lit(high) - F.lit(low)
    return F.when(span != 0, (x - F.lit(low)) / span)


def key4(degrees: Column) -> Column:
    """Coordinate in ten-thousandths of a degree. Exact halves go away from zero."""
    return F.round(degrees * 10000).cast("bigint")


def key3(degrees: Column) -> Column:
    return F.round(degrees * 1000).cast("bigint")


def point_literal(lat: float, lon: float) -> str:
    """Well-known text of a point."""
    return f"POINT({lon} {lat})"
