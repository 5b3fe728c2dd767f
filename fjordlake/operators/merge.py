"""Batches of parameters merged into nested series by position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry of a series; a name that a map lacks is absent, one with a null value is there.
ENTRY = "struct<time: timestamp_ntz, current: map<string, double>, values: map<string, double>>"


def present(**values: tuple[Column, Column]) -> Column:
    """A map of the named values, each given with the condition under which it is there."""
    parts = [F.when(there, F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))) for k, (v, there) in values.items()]
    return F.map_from_entries(F.filter(F.array(*parts), lambda p: p.isNotNull()))


def _over(base: Column, new: Column) -> Column:
    """A map with another's values over it."""
    none = F.create_map().cast("map<string, double>")
    base, new = F.coalesce(base, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k)), new)


def merged_entry(base: Column, new: Column) -> Column:
    """A base entry with the values of a new one of the same time; entries of other times, or missing ones, change nothing."""
    whole = F.struct(
        base["time"].alias("time"), _over(base["current"], new["current"]).alias("current"), _over(base["values"], new["values"]).alias("values")
    )
    return F.when(base["time"] == new["time"], whole).otherwise(base)


def merge_by_position(base: DataFrame, batches: Sequence[DataFrame | None], position: str = "position") -> DataFrame:
    """``base`` series (``entries`` of type :data:`ENTRY`) with the batches merged in, in order.

    A batch's point of a position goes to the base's point there, its k-th
    entry to the k-th of that. Both components of a current are merged on
    their own; a value that is there replaces the base's even if it is null.
    Entries and points that the base lacks are left out. A batch that failed
    (None), or a point that a batch lacks, leaves the base as it is.
    """

    def merge(done: DataFrame, batch: DataFrame | None) -> DataFrame:
        if batch is None:
            return done
        new = batch.select(F.col(position).alias("__at"), F.col("entries").alias("__new"))
        joined = done.join(new, done[position] == new["__at"], "left")
        zipped = F.zip_with("entries", F.slice("__new", F.lit(1), F.size("entries")), merged_entry)
        return joined.withColumn("entries", F.when(F.col("__new").isNull(), F.col("entries")).otherwise(zipped)).drop("__at", "__new")

    return reduce(merge, batches, base)


def all_there(values: Column, names: Sequence[str]) -> Column:
    """Whether a map has a value that is not null for each name."""
    return reduce(Column.__and__, [values[n].isNotNull() for n in names])


def any_not_null(values: Column, names: Sequence[str]) -> Column:
    """Whether a map has anything but a null for some name: a name that is absent counts."""
    return reduce(Column.__or__, [~F.map_contains_key(values, n) | values[n].isNotNull() for n in names])
