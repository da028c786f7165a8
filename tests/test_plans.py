"""Plan-shape guards for the scale properties the design relies on."""

import re

from pyspark.sql import functions as F

from core_paths import SF001
from platewise.operators.keys import is_unique
from platewise.operators.sequence import with_neighbor
from platewise.plans import catalog, views


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_change_log_window_is_split_by_bucket(spark):
    log = spark.range(100).select((F.col("id") % 3).cast("string").alias("k"),
                                  F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz")
                                  .alias("ts"), F.col("id").alias("v"))
    df = with_neighbor(log, ["k"], ["ts", "v"], F.col("v"), "p",
                       F.date_trunc("DAY", F.col("ts")), "prev")
    plan = _plan(df)
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # the window over the log rows is partitioned by (key, day) …
    assert any(re.search(r"\], \[k#\d+, _b#\d+\], \[ts", w) for w in windows)
    # … and the only key-only window runs over the per-(key, day) boundary rows
    for w in windows:
        if re.search(r"\], \[k#\d+\], \[", w):
            assert "_ev" in w


def test_view_over_stored_tables_prunes_and_pushes(spark, tmpdir_path):
    from platewise.operators import calendar
    d = calendar.dim_date(spark, "2024-01-01", 31)
    d.write.parquet(tmpdir_path + "/d")
    spark.createDataFrame([(1, "r1", "R", "C", "X", "Y", True, "unused")],
                          "restaurant_sk bigint, restaurant_id string, restaurant_name string, "
                          "cuisine_type string, city string, state string, is_current boolean, "
                          "extra string").write.parquet(tmpdir_path + "/r")
    spark.createDataFrame([("o1", 1, 5, 10.0, 1.0, "unused")],
                          "order_id string, restaurant_sk bigint, order_date_sk bigint, "
                          "order_total double, tip_amount double, payment_method string"
                          ).write.parquet(tmpdir_path + "/f")
    rd = spark.read.parquet
    v = views.restaurant_order_performance(rd(tmpdir_path + "/f"), rd(tmpdir_path + "/r"),
                                           rd(tmpdir_path + "/d"))
    plan = _plan(v)
    assert "EqualTo(is_current,true)" in plan
    assert "payment_method" not in plan and "extra" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert v.first()["total_orders"] == 1


def test_unique_orders_are_counted_without_a_row_an_order(spark):
    s = catalog.star(spark, SF001)
    assert s.unique("order")
    o, day = s.fact("order"), s.dim("date")
    args = {"restaurant_order_performance": (o, s.dim("restaurant"), day),
            "customer_order_patterns": (o, s.dim("customer"), day, s.dim("restaurant")),
            "product_performance": (s.fact("order_item"), s.dim("product"), o, s.dim("restaurant"), day),
            "promotion_effectiveness": (o, s.dim("promotion"), day)}
    for name, given in args.items():
        view = getattr(views, name)
        fast = view(*given, unique_orders=True)
        assert sorted(map(repr, fast.collect())) == sorted(map(repr, view(*given).collect())), name
        plan = fast._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan and "distinct order_id" not in plan, name
    # an order that comes twice is one order, and isn't called unique
    twice = o.unionByName(o.limit(5))
    assert not is_unique(twice, "order_id")
    got = views.restaurant_order_performance(twice, s.dim("restaurant"), day).agg(F.sum("total_orders")).first()[0]
    assert got == views.restaurant_order_performance(o, s.dim("restaurant"), day).agg(F.sum("total_orders")).first()[0]
