"""The long table of observations, one row for a point and a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """Observations made from a table of events, whose users are points of the standard area."""
    user, event = F.col("user_id"), F.col("event_id")
    return events.select(
        "event_id",
        user.alias("point_id"),
        (F.lit(54.9) + (user * 37 % 470) / F.lit(100.0)).alias("lat"),
        (F.lit(10.3) + (user * 61 % 630) / F.lit(100.0)).alias("lon"),
        "ts",
        ((event * 17 % 401 - 200) / F.lit(100.0)).alias("u"),
        ((event * 29 % 401 - 200) / F.lit(200.0)).alias("v"),
        F.when(F.col("event_type") != "error", F.col("value") / F.lit(20.0) - F.lit(1.0)).alias("temperature"),
        F.when(F.col("event_type") != "view", F.col("value") / F.lit(15.0)).alias("salinity"),
        "event_type",
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(table(spark, folder, "events"))
