"""Hand-calculated values of column functions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fjordlake import constants as K
from fjordlake.functions import colours as C
from fjordlake.functions import hours as H
from fjordlake.functions import sun as S
from fjordlake.functions import vectors as V
from fjordlake.operators import regions as G


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_turning(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)], "u double, v double")
    got = rows.select(V.rotation(F.col("u"), F.col("v")), V.bearing(F.col("u"), F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(90, 90), (0, 0), (-90, -90), (180, 180)]


@pytest.mark.parametrize("knots,number", [(0.249, 1), (0.25, 2), (0.5, 3), (2.49, 9), (2.5, 10)])
def test_knot_bins(spark, knots, number):
    assert one(spark, V.knot_bin(F.lit(knots))) == number


@pytest.mark.parametrize("x,y", [(-0.5, 0), (0.5, 1), (1.5, 2), (-1.5, -1)])
def test_halves_go_up(spark, x, y):
    assert one(spark, H.round_half_up(F.lit(x))) == y


@pytest.mark.parametrize("hour,text", [(0, "Nu"), (27, "+1d 3h"), (-5, "-5h"), (-24, "-1d 0h"), (3, "+3h")])
def test_offset_labels(spark, hour, text):
    assert one(spark, H.offset_label(F.lit(hour))) == text


@pytest.mark.parametrize("hour,text", [(27, "+1 dag 3h"), (50, "+2 dagar 2h"), (-5, "+-5h")])
def test_long_offset_labels(spark, hour, text):
    assert one(spark, H.long_offset_label(F.lit(hour))) == text


def test_names(spark):
    stamp = F.lit("2025-06-29T12:00:00.000Z")
    assert one(spark, H.safe_name(stamp)) == "2025-06-29T12-00-00.000Z"
    assert one(spark, H.iso(F.lit(dt.datetime(2025, 6, 29, 12)).cast("timestamp_ntz"))) == "2025-06-29T12:00:00.000Z"


@pytest.mark.parametrize(
    "lon,lat,region",
    [
        (13.45, 57.25, "Default_Östersjön"), (12.6, 56.0, "Öresund_Nord"), (12.0, 57.8, "Västkusten_Göteborg"),
        (11.5, 57.5, "Västkusten_Göteborg"), (14.5, 56.2, "Hanöbukten"), (14.5, 55.5, "Skåne_Sydkust"), (13.0, 55.55, "Öresund_Syd"),
        (16.0, 56.6, "Kalmar_Sund"), (18.75, 59.1, "Stockholm_Yttre_Skärgård"), (18.5, 57.0, "Gotland_Väst"), (5.0, 50.0, "Default_Östersjön"),
    ],
)
def test_regions(spark, lon, lat, region):
    assert one(spark, G.region_of(F.lit(lon), F.lit(lat)))["region"] == region


def test_nearest_hours(spark):
    hours = spark.createDataFrame([(h,) for h in (-3, 0, 3, 6)], "hour long")
    targets = spark.createDataFrame([(1.0,), (2.0,), (-2.0,), (4.5,)], "target double")
    got = {r.target: r.nearest for r in G.nearest_hours(targets, hours).collect()}
    assert got == {1.0: 0, 2.0: 3, -2.0: -3, 4.5: 3}


@pytest.mark.parametrize(
    "date,rise,fall,summer",
    [
        ("2024-02-29", 6.9756, 17.7069, False), ("2025-03-30", 6.6922, 19.7083, True), ("2025-06-29", 4.4733, 21.9103, True),
        ("2025-10-26", 7.0483, 16.6767, False), ("2025-12-21", 8.5919, 15.6256, False),
    ],
)
def test_sun(spark, date, rise, fall, summer):
    day = F.lit(date).cast("date")
    up, down = S.sun_times(day)
    row = spark.range(1).select(F.round(up, 4).alias("a"), F.round(down, 4).alias("b"), S.is_summer_time(day).alias("s")).first()
    assert tuple(row) == (rise, fall, summer)


def test_ramp_ends_and_missing(spark):
    rows = spark.createDataFrame([(-5.0,), (-1.0,), (24.0,), (90.0,), (None,), (float("nan"),)], "x double")
    got = [r.c and tuple(r.c) for r in rows.select(C.ramp("temperature", F.col("x")).alias("c")).collect()]
    assert got == [(0, 0, 128), (0, 0, 128), (255, 0, 0), (255, 0, 0), None, None]


def test_clamp_and_keys(spark):
    assert one(spark, V.clamp_parameter(F.lit("current"), F.lit(-0.02))) == 0
    assert one(spark, V.clamp_parameter(F.lit("temperature"), F.lit(-0.02))) == -0.02
    assert one(spark, V.key4(F.lit(55.00004))) == one(spark, V.key4(F.lit(55.00001))) == 550000
    assert V.point_literal(55.5, 12.5) == "POINT(12.5 55.5)"


def test_unknown_parameter():
    with pytest.raises(ValueError):
        K.parameter("waves")
    assert json.dumps(K.parameter("salinity")[0]) == '"g/kg"'
