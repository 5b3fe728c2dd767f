"""Coverage documents: dense cubes over time, y and x, and series of single positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COVERAGE_SCHEMA = (
    "domain struct<domainType:string,axes:struct<t:struct<values:array<string>>,"
    "x:struct<start:double,stop:double,num:int,values:array<double>>,"
    "y:struct<start:double,stop:double,num:int,values:array<double>>,"
    "lon:struct<values:array<double>>,lat:struct<values:array<double>>>>,"
    "ranges map<string,struct<values:array<double>>>"
)

# Names of the ranges and of the columns they become.
PARAMETER_COLUMNS = {"current-u": "u", "current-v": "v", "water-temperature": "temperature", "salinity": "salinity"}


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COVERAGE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def axis(name: str, other: str) -> Column:
    """Values of an axis: from start, stop and number for a grid (none may be 0), else listed, else by its other name."""
    a = F.col(f"domain.axes.{name}")
    step = (a["stop"] - a["start"]) / F.nullif(a["num"] - 1, F.lit(0))
    made = F.transform(F.sequence(F.lit(0), a["num"] - 1), lambda i: a["start"] + i * step)
    grid = (F.col("domain.domainType") == "Grid") & (a["start"] != 0) & (a["stop"] != 0) & (a["num"] != 0)
    return F.when(grid, made).otherwise(F.coalesce(a["values"], F.col(f"domain.axes.{other}.values")))


def decode(pos: Column, nx: Column, ny: Column) -> tuple[Column, Column, Column]:
    """Place in time, y and x of a place in a flat range."""
    return F.floor(pos / (nx * ny)).cast("int"), (F.floor(pos / nx) % ny).cast("int"), (pos % nx).cast("int")


def cube_rows(cubes: DataFrame) -> DataFrame:
    """One row per point and time of grids, nulls kept. A cube without ranges, times or axes raises."""
    named = cubes.select(axis("x", "lon").alias("xs"), axis("y", "lat").alias("ys"), F.col("domain.axes.t.values").alias("ts"), "ranges")
    sound = F.coalesce(F.col("ranges").isNotNull() & (F.size("ts") > 0) & (F.size("xs") > 0) & (F.size("ys") > 0), F.lit(False))
    checked = F.when(sound, F.col("ranges")).otherwise(F.raise_error(F.lit("incomplete coverage")))
    flat = named.select("xs", "ys", "ts", F.explode(checked).alias("parameter", "range"))
    flat = flat.select("xs", "ys", "ts", "parameter", F.posexplode("range.values").alias("pos", "value"))
    t, y, x = decode(F.col("pos"), F.size("xs"), F.size("ys"))
    rows = flat.select(
        F.get("ys", y).alias("lat"), F.get("xs", x).alias("lon"), F.get("ts", t).alias("time_str"), "parameter", "value"
    )
    values = [F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(c) for p, c in PARAMETER_COLUMNS.items()]
    return rows.groupBy("lat", "lon", "time_str").agg(*values)


def position_rows(series: DataFrame, strict: bool = False) -> DataFrame:
    """``time_str, u, v`` of single positions. Strict: components must be there and of equal number."""
    u, v = (F.coalesce(F.col("ranges")[p]["values"], F.array().cast("array<double>")) for p in ("current-u", "current-v"))
    named = series.select(F.col("domain.axes.t.values").alias("ts"), u.alias("us"), v.alias("vs"))
    if strict:
        sound = (F.size("us") > 0) & (F.size("us") == F.size("vs"))
        named = named.where(F.assert_true(sound, "empty or unequal components").isNull())
    zipped = named.select(F.explode(F.arrays_zip("us", "vs", "ts")).alias("z"))
    time = F.coalesce("z.ts", F.lit("")) if strict else F.col("z.ts")
    rows = zipped.select(time.alias("time_str"), F.col("z.us").alias("u"), F.col("z.vs").alias("v"))
    return rows if strict else rows.where("time_str IS NOT NULL")
