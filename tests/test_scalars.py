"""Column helpers on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from platewise.functions import scalars as X


def test_minute_boundaries_counts_boundaries(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 10, 0, 59), dt.datetime(2024, 1, 1, 10, 1, 1)),
         (dt.datetime(2024, 1, 1, 10, 0, 0), dt.datetime(2024, 1, 1, 10, 59, 59)),
         (dt.datetime(2024, 1, 1, 23, 59, 0), dt.datetime(2024, 1, 2, 0, 0, 30))],
        "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(X.minute_boundaries("a", "b")).collect()]
    assert got == [1, 59, 1]


def test_clip_abs_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-200.0,), (3.0,), (60.0,)], "x double")
    got = [r[0] for r in df.select(X.clip_abs("x", 5, 120)).collect()]
    assert got == [None, 120.0, 5.0, 60.0]


def test_parse_money(spark):
    df = spark.createDataFrame([("$12.50",), ("$1,250",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(X.parse_money("s")).collect()]
    assert got == [12.5, 1250.0, None, None]


def test_parse_clock_seconds(spark):
    df = spark.createDataFrame([("10:15:30",), ("NaN",), ("25:00:00",), ("7:05",)], "s string")
    got = [r[0] for r in df.select(X.parse_clock_seconds("s")).collect()]
    assert got == [36930, None, None, 7 * 3600 + 300]


def test_day_of_week_sunday_is_zero(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2023, 1, 7),)], "d date")
    got = df.select(X.day_of_week0("d"), X.is_weekend("d")).collect()
    assert [tuple(r) for r in got] == [(0, True), (6, True)]


def test_day_part_and_am_pm(spark):
    df = spark.createDataFrame([(h,) for h in (4, 5, 11, 12, 16, 17, 20, 21)], "h int")
    got = [tuple(r) for r in df.select(X.day_part("h"), X.am_pm("h")).collect()]
    assert [g[0] for g in got] == ["Night", "Morning", "Morning", "Afternoon", "Afternoon",
                                   "Evening", "Evening", "Night"]
    assert [g[1] for g in got] == ["AM", "AM", "AM", "PM", "PM", "PM", "PM", "PM"]


def test_ordinal(spark):
    df = spark.createDataFrame([("Jam",), ("Low",), ("Unknown",)], "t string")
    got = [r[0] for r in df.select(X.ordinal("t", X.TRAFFIC_ORDER)).collect()]
    assert got == [3, 0, None]


def test_money_sum_is_order_independent(spark):
    vals = [(0.1,), (0.2,), (0.3,)] * 50
    a = spark.createDataFrame(vals, "x double").repartition(7)
    b = spark.createDataFrame(list(reversed(vals)), "x double").coalesce(1)
    assert a.agg(X.money_sum("x")).first()[0] == b.agg(X.money_sum("x")).first()[0] == 30.0


def test_mean_of_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert df.agg(X.mean("x")).first()[0] == 1.5
    assert df.where(F.col("x").isNull()).agg(X.mean("x")).first()[0] is None
