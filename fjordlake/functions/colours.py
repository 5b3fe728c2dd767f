"""Column expressions for colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ARROW_COLOURS, ARROW_TOP, FUTURE, PAST, RAMPS, rgb
from .hours import round_half_up


def piecewise(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between stops, level outside them."""
    out = F.lit(float(stops[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(x < b, F.lit(float(p)) + (x - F.lit(a)) * F.lit(float(q) - float(p)) / F.lit(b - a)).otherwise(out)
    return F.when(x < stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def _channels(x: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> list[Column]:
    return [piecewise(x, [(at, colour[c]) for at, colour in stops]) for c in range(3)]


def ramp(parameter: str, value: Column) -> Column:
    """Struct ``r, g, b`` (0 to 255) of a value on its parameter's ramp of 256 levels; null for null and NaN."""
    stops = RAMPS[parameter]
    low, high = stops[0][0], stops[-1][0]
    share = (value - F.lit(low)) / F.lit(high - low)
    level = F.least(F.greatest(F.floor(share * 256), F.lit(0)), F.lit(255))
    parts = _channels(level / F.lit(255.0), [((at - low) / (high - low), rgb(c)) for at, c in stops])
    whole = [F.floor(p + 0.5).cast("int").alias(n) for p, n in zip(parts, "rgb")]
    return F.when(value.isNotNull() & ~F.isnan(value), F.struct(*whole))


def arrow_colour(speed: Column) -> Column:
    """Struct ``r, g, b`` of a speed, over five evenly spaced colours."""
    step = ARROW_TOP / (len(ARROW_COLOURS) - 1)
    parts = _channels(speed, [(i * step, rgb(c)) for i, c in enumerate(ARROW_COLOURS)])
    return F.struct(*[F.floor(p + 0.5).cast("int").alias(n) for p, n in zip(parts, "rgb")])


def progress_colour(hour: Column, first: int, last: int) -> Column:
    """``rgb(r,g,b)`` of an hour from ``first`` (below 0) to ``last``."""

    def text(share: Column, table) -> Column:
        parts = [round_half_up(p) for p in _channels(share, [(at, c) for at, *c in table])]
        return F.concat(F.lit("rgb("), F.concat_ws(",", *[p.cast("string") for p in parts]), F.lit(")"))

    past = text(F.least(F.abs(hour) / F.lit(float(abs(first) or 1)), F.lit(1.0)), PAST)
    future = text(F.least(hour / F.lit(float(last or 1)), F.lit(1.0)), FUTURE)
    return F.when(hour == 0, "rgb(255, 223, 0)").when(hour < 0, past).otherwise(future)


def legend_share(index: Column, count: Column) -> Column:
    """Per cent of a legend's length at which a stop stands: evenly by number, not by value."""
    return index / (count - 1) * 100
