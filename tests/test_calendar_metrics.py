"""Calendar dimensions and dashboard datasets on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from platewise.operators import calendar
from platewise.plans import metrics as K


def test_dim_date_defaults(spark):
    d = calendar.dim_date(spark)
    assert d.count() == 1825
    agg = d.agg(F.min("date_id"), F.max("date_id"), F.min("date_sk"), F.max("date_sk")).first()
    assert (str(agg[0]), str(agg[1]), agg[2], agg[3]) == ("2020-01-01", "2024-12-29", 1, 1825)
    first = d.where(F.col("date_id") == "2023-01-01").first()
    assert first["day_of_week"] == 0 and first["day_of_week_name"] == "Sun"
    assert first["is_weekend"] and first["week_of_year"] == 52
    assert first["month_name"] == "Jan" and first["quarter"] == 1


def test_dim_date_covering_and_holidays(spark):
    dates = spark.createDataFrame([(dt.date(1999, 3, 4),), (dt.date(2001, 7, 1),)], "d date")
    hol = spark.createDataFrame([(dt.date(2000, 1, 1), "New Year")],
                                "holiday_date date, holiday_name string")
    d = calendar.dim_date_covering(dates, hol)
    assert d.count() == 365 + 366 + 365
    ny = d.where(F.col("date_id") == "2000-01-01").first()
    assert ny["is_holiday"] and ny["holiday_name"] == "New Year" and ny["date_sk"] == 366


def test_dim_time(spark):
    t = calendar.dim_time(spark)
    assert t.count() == 1440
    r = t.where(F.col("minute_of_day") == 17 * 60 + 5).first()
    assert (r["time_sk"], r["time_id"], r["am_pm"], r["time_of_day_category"]) == \
        (17 * 60 + 6, "17:05:00", "PM", "Evening")


def _orders(spark, days):
    return spark.createDataFrame([(f"o{i}", d, "Delivered") for i, d in enumerate(days)],
                                 "order_id string, order_date timestamp_ntz, order_status string")


def test_mom_growth_one_and_two_months(spark):
    one = K.mom_growth(_orders(spark, [dt.datetime(2024, 1, 5)] * 3)).first()
    assert one["order_count"] == 3 and one["mom_growth_pct"] is None
    two = K.mom_growth(_orders(spark, [dt.datetime(2024, 1, 5)] * 4
                                + [dt.datetime(2024, 2, 1)] * 5)).first()
    assert str(two["month"]) == "2024-02-01" and two["mom_growth_pct"] == 25.0


def test_daily_orders_filter_pushes_down(spark, tmpdir_path):
    _orders(spark, [dt.datetime(2024, 1, d) for d in range(1, 11)]).write.parquet(tmpdir_path + "/o")
    o = spark.read.parquet(tmpdir_path + "/o")
    df = K.daily_orders(o, K.Filters(start="2024-01-03", end="2024-01-05"))
    assert [r["order_count"] for r in df.collect()] == [1, 1, 1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "order_date" in plan


def test_traffic_order_and_weather(spark):
    m = spark.createDataFrame(
        [("d1", "Sunny", "Jam", 600), ("d2", "Sunny", "Low", 300), ("d3", "Foggy", "High", None),
         ("d4", "Foggy", "Medium", 900)],
        "delivery_id string, weather_conditions string, traffic_density string, "
        "delivery_seconds bigint")
    t = [r["traffic_density"] for r in K.traffic_impact(m).collect()]
    assert t == ["Low", "Medium", "High", "Jam"]
    w = {r[0]: r[1] for r in K.weather_impact(m).collect()}
    assert w == {"Sunny": 7.5, "Foggy": 15.0}


def test_delivery_minutes_fixture(spark):
    rows = [("1", "Sunny", "Low", "10:00:00", "10:00:30"),   # 0.5 min → 5
            ("2", "Sunny", "Low", "23:50:00", "00:10:00"),   # crosses midnight → 120
            ("3", "Sunny", "Low", "10:00:00", "NaN"),        # unparsable → null
            ("4", "Sunny", "Low", "10:00:00", "11:00:00")]   # 60
    d = spark.createDataFrame(rows, "ID string, Weatherconditions string, "
                              "Road_traffic_density string, Time_Orderd string, "
                              "Time_Order_picked string")
    got = [r["delivery_time_minutes"] for r in K.delivery_minutes(d).orderBy("delivery_id").collect()]
    assert got == [5.0, 120.0, None, 60.0]


def test_dashboard_filters_all_means_no_filter(spark):
    r = spark.createDataFrame(
        [("1", "A", "C1", "Rome", 4.0), ("2", "B", "C2", "Rome", 5.0), ("3", "C", "C1", "Oslo", 3.0)],
        "restaurant_id string, restaurant_name string, cuisine_type string, city string, "
        "rating double")
    assert [x["restaurant_id"] for x in K.top_restaurants(r).collect()] == ["2", "1", "3"]
    rome = K.top_restaurants(r, f=K.Filters(city="Rome", cuisine="All"))
    assert [x["restaurant_id"] for x in rome.collect()] == ["2", "1"]
    c1 = K.top_restaurants(r, f=K.Filters(city="All", cuisine="C1"))
    assert [x["restaurant_id"] for x in c1.collect()] == ["1", "3"]
    d = spark.createDataFrame([("1", "Sunny", "Low", "10:00:00", "10:30:00"),
                               ("2", "Foggy", "Low", "10:00:00", "10:10:00")],
                              "ID string, Weatherconditions string, Road_traffic_density string, "
                              "Time_Orderd string, Time_Order_picked string")
    got = K.delivery_minutes(d, K.Filters(weather="Foggy")).collect()
    assert [(x["delivery_id"], x["delivery_time_minutes"]) for x in got] == [("2", 10.0)]


def test_dim_date_covering_pinned_start_keeps_keys(spark):
    a = calendar.dim_date_covering(
        spark.createDataFrame([(dt.date(2001, 5, 1),)], "d date"))
    b = calendar.dim_date_covering(
        spark.createDataFrame([(dt.date(2003, 2, 1),)], "d date"), start="2001-01-01")
    ka = a.where(F.col("date_id") == "2001-05-01").first()["date_sk"]
    kb = b.where(F.col("date_id") == "2001-05-01").first()["date_sk"]
    assert ka == kb and b.agg(F.max("date_id")).first()[0] == dt.date(2003, 12, 31)
