"""The session that the package's results are stated for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that hours do not depend on the machine; adaptive plans split skewed joins and size partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("fjordlake").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
