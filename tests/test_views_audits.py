"""Views on a hand-made star (D12, D15) and the audits (Q1–Q3)."""

import datetime as dt

from pyspark.sql import functions as F

from platewise.operators import audits, calendar
from platewise.operators.keys import assign_keys
from platewise.plans import views

CUR = dt.datetime(2025, 1, 1)


def _date(spark):
    return calendar.dim_date(spark, "2024-01-01", 60)


def test_delivery_view_counts_each_delivery_once(spark):
    d = _date(spark)
    jan5 = d.where(F.col("date_id") == "2024-01-05").first()["date_sk"]
    fd = spark.createDataFrame(
        [("d1", 1, 10, jan5, 30, None), ("d2", 2, 10, jan5, 50, None)],
        "delivery_id string, order_sk bigint, delivery_person_sk bigint, "
        "delivery_date_sk bigint, delivery_duration_minutes bigint, delivery_distance double")
    dp = spark.createDataFrame([(10, "p1", True)],
                               "delivery_person_sk bigint, delivery_person_id string, "
                               "is_current boolean")
    # order 1 has two ratings, order 2 one
    fr = spark.createDataFrame([(1, 5), (1, 3), (2, 4)],
                               "order_sk bigint, delivery_rating int")
    per_order = views.delivery_performance(fd, dp, d, fr).first()
    assert per_order["total_deliveries"] == 2
    assert per_order["avg_delivery_time"] == 40.0
    assert per_order["avg_delivery_rating"] == 4.0
    literal = views.delivery_performance(fd, dp, d, fr, mode="literal").first()
    # the plain join counts delivery d1 twice and weights its duration twice
    assert literal["total_deliveries"] == 3
    assert abs(literal["avg_delivery_time"] - 110 / 3) < 1e-12


def test_history_modes_for_expired_versions(spark):
    d = _date(spark)
    jan5 = d.where(F.col("date_id") == "2024-01-05").first()["date_sk"]
    dim = spark.createDataFrame(
        [(1, "r1", "Old name", "C1", "X", "Y", False), (2, "r1", "New name", "C1", "X", "Y", True)],
        "restaurant_sk bigint, restaurant_id string, restaurant_name string, "
        "cuisine_type string, city string, state string, is_current boolean")
    fo = spark.createDataFrame([("o1", 1, jan5, 10.0, 1.0), ("o2", 2, jan5, 20.0, 2.0)],
                               "order_id string, restaurant_sk bigint, order_date_sk bigint, "
                               "order_total double, tip_amount double")
    stated = views.restaurant_order_performance(fo, dim, d).collect()
    assert [(r["restaurant_name"], r["total_orders"]) for r in stated] == [("New name", 1)]
    by_key = views.restaurant_order_performance(fo, dim, d, history="key").collect()
    assert [(r["restaurant_name"], r["total_orders"], r["total_revenue"]) for r in by_key] == \
        [("New name", 2, 30.0)]


def test_audits(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,)], "k bigint")
    child = spark.createDataFrame([(1,), (3,), (None,), (1,)], "fk bigint")
    pk = audits.audit_primary_keys({"p": parent}, {"p": "k"}).collect()
    assert [(r["table_name"], r["key_value"], r["occurrences"]) for r in pk] == [("p", "2", 2)]
    fk = audits.fk_check(child, "fk", parent, "k", "c", "p").first()
    assert (fk["child_rows"], fk["null_rows"], fk["orphan_rows"]) == (4, 1, 1)
    rec = audits.reconcile([("x", "clean", parent), ("x", "fact", child)]).collect()
    assert sorted((r["layer"], r["row_count"]) for r in rec) == [("clean", 3), ("fact", 4)]


def test_frozen_keys_are_dense_and_unique(spark, tmpdir_path):
    spark.range(0, 1000, numPartitions=5).write.parquet(tmpdir_path + "/t")
    t = spark.read.parquet(tmpdir_path + "/t")
    keys = [r["k"] for r in assign_keys(t, "k", [], offset=10, frozen=True).collect()]
    assert sorted(keys) == list(range(11, 1011))


def test_register_views_and_layers(spark, tmpdir_path):
    from platewise.plans import catalog
    from platewise.sources import store
    from core_paths import SF001
    names = views.register_views(catalog.star(spark, SF001))
    assert set(names) == set(views.VIEW_NAMES)
    n = spark.sql("SELECT COUNT(*) FROM vw_promotion_effectiveness").first()[0]
    assert n > 0
    assert store.create_layers(spark) == ["stage", "clean", "consumption"]
    dbs = {r[0] for r in spark.sql("SHOW DATABASES").collect()}
    assert {"stage", "clean", "consumption"} <= dbs
