"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that is not the smallest of its component.

    ``component`` is the smallest node reachable. Each step groups by node
    for a minimum, combined before it is shuffled, and joins it back; no
    group is gathered anywhere. Edges are written to the shared folder after
    every round, until every node hangs on the smallest of its component.
    Loops and repeated edges do not matter; edges with a null end are ignored.
    """
    ends = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
    edge = materialize(ends.where("u > v AND v IS NOT NULL").distinct(), "edges")
    while not _are_stars(edge):
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        edge = materialize(small.distinct(), "edges")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _are_stars(edge: DataFrame) -> bool:
    """Whether every edge's larger end has this edge alone."""
    ends = edge.select(F.col("u").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = ends.unionByName(edge.select(F.col("v").alias("x"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    role = ends.groupBy("x").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return role.where("above > 1 OR (above > 0 AND below > 0)").isEmpty()
