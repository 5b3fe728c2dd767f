"""Column expressions for sunrise and sunset at a fixed place, summer time and day or night."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SUN_LATITUDE, SUN_LONGITUDE


def julian_day(date: Column) -> Column:
    return F.unix_date(date) + 2440588


def is_summer_time(date: Column) -> Column:
    """From the last Sunday of March up to, but not on, the last Sunday of October."""

    def last_sunday(month: int) -> Column:
        end = F.make_date(F.year(date), F.lit(month), F.lit(31))
        return F.date_sub(end, F.dayofweek(end) - 1)

    return (date >= last_sunday(3)) & (date < last_sunday(10))


def sun_times(date: Column) -> tuple[Column, Column]:
    """Local decimal hours of sunrise and sunset, to the second.

    Days are counted from noon of 2000-01-01, plus one, as the count is
    rounded up. Without a sunrise both are 12, without a sunset 0 and 24.
    """
    n = F.ceil(julian_day(date) - F.lit(2451545.0) + F.lit(0.0008))
    noon = n - F.lit(SUN_LONGITUDE / 360)
    mean = (F.lit(357.5291) + F.lit(0.98560028) * noon) % 360
    m = F.radians(mean)
    centre = F.lit(1.9148) * F.sin(m) + F.lit(0.02) * F.sin(m * 2) + F.lit(0.0003) * F.sin(m * 3)
    ecliptic = F.radians((mean + centre + F.lit(282.9372)) % 360)
    transit = F.lit(2451545.0) + noon + F.lit(0.0053) * F.sin(m) - F.lit(0.0069) * F.sin(ecliptic * 2)
    tilt = F.sin(ecliptic) * F.lit(math.sin(math.radians(23.4397)))
    place = math.radians(SUN_LATITUDE)
    across = (F.lit(math.sin(math.radians(-0.833))) - F.lit(math.sin(place)) * tilt) / (
        F.lit(math.cos(place)) * F.cos(F.asin(tilt))
    )
    half = F.degrees(F.acos(F.greatest(F.least(across, F.lit(1.0)), F.lit(-1.0)))) / 360
    zone = F.when(is_summer_time(date), 2).otherwise(1)

    def hours(julian: Column) -> Column:
        # milliseconds and then seconds are cut off, as a clock shows them
        ms = F.floor((julian - F.lit(2440587.5)) * F.lit(86400.0) * 1000)
        return F.floor(F.pmod(ms + zone * 3_600_000, F.lit(86_400_000)) / 1000) / F.lit(3600.0)

    rise = F.when(across > 1, 12.0).when(across < -1, 0.0).otherwise(hours(transit - half))
    fall = F.when(across > 1, 12.0).when(across < -1, 24.0).otherwise(hours(transit + half))
    return rise, fall


def sun_share(hour: Column, rise: Column, fall: Column) -> Column:
    """Opacity of the sun from 0 to 1; it changes along a cosine from an hour before to an hour after either time."""
    time = F.pmod(hour, F.lit(24))

    def ease(middle: Column) -> Column:
        share = F.least(F.greatest((time - (middle - 1)) / 2, F.lit(0.0)), F.lit(1.0))
        return (1 - F.cos(share * math.pi)) * 0.5

    return (
        F.when(time.between(rise - 1, rise + 1), ease(rise))
        .when(time.between(fall - 1, fall + 1), 1 - ease(fall))
        .when(time.between(rise, fall), 1.0)
        .otherwise(0.0)
    )


def is_day(hour: Column, rise: Column, fall: Column) -> Column:
    return F.pmod(hour, F.lit(24)).between(rise, fall)
