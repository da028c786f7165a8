"""End-to-end batch load from CSV extracts into the layered store."""

import os

from platewise.plans import catalog, views
from platewise.plans.load import StoredStar, full_load
from platewise.sources import csv as csvsrc
from platewise.sources import testdata
from core_paths import SF001


def test_full_load_from_csv_extracts(spark, tmpdir_path):
    t = testdata.Tables(spark, SF001)
    paths = {}
    for name, fn in testdata.SOURCES.items():
        paths[name] = os.path.join(tmpdir_path, "extracts", name)
        csvsrc.write_extract(fn(t), paths[name])
    root = os.path.join(tmpdir_path, "warehouse")
    q = full_load(spark, paths, root, batch_id=1, batch_ts="2025-01-01 00:00:00")
    assert set(q.values()) == {0}
    s = StoredStar(spark, root)
    assert s.fact("order").count() == t.orders.count()
    assert s.fact("order_item").count() == t.lineitem.count()
    # the view over the loaded warehouse equals the registered query
    got = views.restaurant_order_performance(s.fact("order"), s.dim("restaurant"),
                                             s.dim("date"))
    want = catalog.QUERIES["vw_restaurant_order_performance"](spark, SF001)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == \
        sorted(map(tuple, want.select(*cols).collect()))
    # keys are unique across the fact
    f = s.fact("order_item")
    assert f.select("order_item_sk").distinct().count() == f.count()


def test_second_load_merges_dimensions(spark, tmpdir_path):
    from pyspark.sql import functions as F
    t = testdata.Tables(spark, SF001)
    root = os.path.join(tmpdir_path, "warehouse")
    cust = testdata.customers_source(t)
    orders = testdata.orders(t)
    paths0 = {"customers": os.path.join(tmpdir_path, "c0"),
              "orders": os.path.join(tmpdir_path, "o0"),
              "restaurants": os.path.join(tmpdir_path, "r0"),
              "promotions": os.path.join(tmpdir_path, "p0"),
              "delivery": os.path.join(tmpdir_path, "d0"),
              "products": os.path.join(tmpdir_path, "pr0"),
              "order_items": os.path.join(tmpdir_path, "i0")}
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    frames0 = {"customers": cust, "orders": orders.where(early),
               "restaurants": testdata.restaurants_source(t), "promotions": testdata.promotions(t),
               "delivery": testdata.delivery(t), "products": testdata.products(t),
               "order_items": testdata.order_items(t)}
    for n, df in frames0.items():
        csvsrc.write_extract(df, paths0[n])
    full_load(spark, paths0, root, batch_id=1, batch_ts="2025-01-01 00:00:00")
    moved = cust.withColumn("city", F.when(F.col("id") == "0", F.lit("Elsewhere"))
                            .otherwise(F.col("city")))
    paths1 = dict(paths0, customers=os.path.join(tmpdir_path, "c1"),
                  orders=os.path.join(tmpdir_path, "o1"))
    csvsrc.write_extract(moved, paths1["customers"])
    csvsrc.write_extract(orders.where(~early), paths1["orders"])
    full_load(spark, paths1, root, batch_id=2, batch_ts="2025-02-01 00:00:00")
    s = StoredStar(spark, root)
    c0 = s.dim("customer").where(F.col("customer_id") == "0").orderBy("effective_from").collect()
    assert [(r["city"], r["is_current"]) for r in c0] == [(c0[0]["city"], False),
                                                           ("Elsewhere", True)]
    fo = s.fact("order")
    assert fo.count() == t.orders.count()
    assert fo.select("order_sk").distinct().count() == fo.count()
    # every order date resolves to the (extended) calendar
    assert fo.where(F.col("order_date_sk").isNull()).count() == 0
