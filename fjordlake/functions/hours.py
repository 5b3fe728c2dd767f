"""Column expressions on hours: prefixes, offsets from a base hour, labels. The base hour is always given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MONTHS, WEEKDAYS


def iso(ts: Column) -> Column:
    """``2025-06-29T12:00:00.000Z``"""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hour_prefix(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def round_half_up(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + 0.5).cast("bigint")


def base_hour(now: Column) -> Column:
    return F.date_trunc("HOUR", now).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def hour_offset(ts: Column, base: Column) -> Column:
    return round_half_up((seconds(ts) - seconds(base)) / 3600)


def fold(hour: Column) -> Column:
    return F.pmod(hour, F.lit(24))


def safe_name(timestamp: Column) -> Column:
    return F.replace(F.replace(timestamp, F.lit(":"), F.lit("-")), F.lit("+"), F.lit("plus"))


def image_name(name: Column, timestamp: Column) -> Column:
    return F.concat(name, F.lit("_"), safe_name(timestamp), F.lit(".png"))


def offset_label(hour: Column) -> Column:
    """``Nu``, ``+1d 3h``, ``-5h``"""
    size = F.abs(hour)
    days, hours = F.floor(size / 24).cast("string"), (size % 24).cast("string")
    long = F.concat(days, F.lit("d "), hours, F.lit("h"))
    text = F.when(size >= 24, long).otherwise(F.concat(hours, F.lit("h")))
    return F.when(hour == 0, "Nu").otherwise(F.concat(F.when(hour > 0, "+").otherwise("-"), text))


def long_offset_label(hour: Column) -> Column:
    """``+2 dagar 2h``; hours below a day, and all negative ones, as ``+-5h``"""
    days = F.floor(hour / 24)
    hours = (hour % 24).cast("string")
    unit = F.when(days > 1, " dagar ").otherwise(" dag ")
    return F.concat(F.lit("+"), F.when(days > 0, F.concat(days.cast("string"), unit)).otherwise(""), hours, F.lit("h"))


def local(ts: Column, zone: str = "Europe/Stockholm") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def _pick(number: Column, names: list[str], first: int) -> Column:
    start = F.lit(None).cast("string")
    return reduce(lambda out, x: F.when(number == x[0], x[1]).otherwise(out), enumerate(names, first), start)


def day_label(ts: Column, base: Column, zone: str = "Europe/Stockholm") -> Column:
    """Relative name of a local calendar day, or its short name."""
    there = local(ts, zone)
    days = F.datediff(there.cast("date"), local(base, zone).cast("date"))
    name = _pick(F.dayofweek(there), WEEKDAYS, 1)
    near = {0: "Idag", 1: "Imorgon", -1: "Igår", -2: "Överigår"}
    return reduce(lambda out, x: F.when(days == x[0], x[1]).otherwise(out), near.items(), name)


def full_date(ts: Column, zone: str = "Europe/Stockholm") -> Column:
    """``29 juni 2025``"""
    there = local(ts, zone)
    return F.concat_ws(" ", F.dayofmonth(there).cast("string"), _pick(F.month(there), MONTHS, 1), F.year(there).cast("string"))


def position_to_hour(position: Column, low, high) -> Column:
    """Hour at a share of a slider's length, which is held to its ends."""
    share = F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0))
    return round_half_up(share * (F.lit(high) - F.lit(low)) + F.lit(low))


def knob_to_hour(position: Column, low, high) -> Column:
    """Hour at a share of a knob's turn; null for a position whose hour is out of range, which a knob rejects."""
    hour = round_half_up(position * (F.lit(high) - F.lit(low)) + F.lit(low))
    return F.when(hour.between(low, high), hour)
