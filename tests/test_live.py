"""One warehouse through load, load and stream: versions, keys, late parents."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from platewise.plans import catalog, views
from platewise.plans.live import LiveWarehouse
from platewise.plans.load import StoredStar, full_load
from platewise.session import scratch_dir
from platewise.sources import csv as csvsrc
from platewise.sources import store, testdata
from platewise.sources.control import Control
from platewise.streaming import incremental
from core_paths import SF001

ITEM = "id string, order_id string, product_id string, item_quantity int, price double"
ORDER = ("id string, customer_id string, created_at timestamp_ntz, updated_at timestamp_ntz, "
         "updated_status string, tips double, rating int, restaurant_id string, promotion_id string, "
         "order_total double, delivery_rating int")
D0, D1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def orders(spark, rows, ts="2025-01-01 00:00:00", name="o.csv"):
    """rows: (id, total, updated_at)"""
    df = spark.createDataFrame([(str(i), "c", D0, u, "Delivered", 1.0, None, "r", "p", float(t), None)
                                for i, t, u in rows], ORDER)
    return csvsrc.with_provenance(df, "orders_csv", name, ts)


def items(spark, rows, ts="2025-01-01 00:00:00"):
    """rows: (id, order, quantity)"""
    df = spark.createDataFrame([(i, str(o), "x", q, 2.0) for i, o, q in rows], ITEM)
    return csvsrc.with_provenance(df, "items_csv", "i.csv", ts)


@pytest.fixture()
def live(spark, tmpdir_path):
    w = LiveWarehouse(spark, tmpdir_path)
    none = testdata.Tables(spark, SF001)
    for d, src in (("customer", testdata.customers_source(none)), ("restaurant", testdata.restaurants_source(none)),
                   ("promotion", testdata.promotions(none)), ("product", testdata.products(none))):
        from platewise.operators import clean as C
        entity = {"customer": "customers", "restaurant": "restaurants", "promotion": "promotions",
                  "product": "products"}[d]
        w.put_dimension(d, C.CLEANERS[entity](src.limit(3), "2025-01-01 00:00:00"), "2025-01-01 00:00:00", "load:0")
    return w


def land(spark, root, entity, rows, batch):
    incremental.land_batch(rows, root, entity, batch)
    return incremental.run_once(spark, root, entity, incremental.entity_handler(root, entity, dimension=False))


def test_control_versions_and_replays(spark, tmpdir_path):
    c = Control(spark, tmpdir_path)
    assert c.last("t") is None and c.version_for("t", "load:1") == 0
    c.commit("t", 0, "load:1", "full", 10)
    c.commit("t", c.version_for("t", "stream:x:0"), "stream:x:0", max_key=12)
    c = Control(spark, tmpdir_path)  # as another process sees it
    assert [(v.version, v.run, v.max_key) for v in c.versions("t")] == [(0, "load:1", 10), (1, "stream:x:0", 12)]
    assert c.version_for("t", "load:1") == 0 and c.version_for("t", "load:2") == 2
    assert c.before("t", 1).max_key == 10 and c.before("t", 0) is None
    c.commit("t", 0, "load:1", "full", 11)
    assert [v.max_key for v in Control(spark, tmpdir_path).versions("t")] == [11, 12]


def test_orders_are_upserted_and_keep_their_keys(spark, live):
    root = live.root
    land(spark, root, "orders", orders(spark, [(1, 10, D0), (2, 20, D0), (3, 30, D0)]), 0)
    first = {r.order_id: r.order_sk for r in LiveWarehouse(spark, root).fact("order").collect()}
    land(spark, root, "orders", orders(spark, [(2, 25, D1), (4, 40, D1)], "2025-01-02 00:00:00"), 1)
    got = {r.order_id: (r.order_sk, r.order_total) for r in LiveWarehouse(spark, root).fact("order").collect()}
    assert got == {"1": (first["1"], 10.0), "2": (first["2"], 25.0), "3": (first["3"], 30.0), "4": (got["4"][0], 40.0)}
    assert len({sk for sk, _ in got.values()}) == 4 and got["4"][0] > max(first.values())


def test_newest_state_of_an_order_in_one_batch(spark, live):
    root = live.root
    incremental.land_batch(orders(spark, [(1, 15, D1)], "2025-01-02 00:00:00"), root, "orders", 0)
    incremental.land_batch(orders(spark, [(1, 10, D0)], "2025-01-01 00:00:00"), root, "orders", 1)
    incremental.run_once(spark, root, "orders", incremental.entity_handler(root, "orders"))
    assert [r.order_total for r in LiveWarehouse(spark, root).fact("order").collect()] == [15.0]


def test_items_wait_for_their_order(spark, live):
    root = live.root
    land(spark, root, "orders", orders(spark, [(1, 10, D0)]), 0)
    land(spark, root, "order_items", items(spark, [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]), 0)
    w = LiveWarehouse(spark, root)
    assert [r.order_item_id for r in w.fact("order_item").collect()] == ["a"]
    assert sorted(r.order_item_id for r in w.pending("order_item").collect()) == ["b", "c"]
    land(spark, root, "orders", orders(spark, [(2, 20, D0)], "2025-01-02 00:00:00"), 1)
    w = LiveWarehouse(spark, root)
    assert sorted(r.order_item_id for r in w.fact("order_item").collect()) == ["a", "b"]
    assert [r.order_item_id for r in w.pending("order_item").collect()] == ["c"]
    land(spark, root, "order_items", items(spark, [("c", 3, 7), ("a", 1, 5)], "2025-01-03 00:00:00"), 1)
    land(spark, root, "orders", orders(spark, [(3, 30, D0)], "2025-01-04 00:00:00"), 2)
    w = LiveWarehouse(spark, root)
    link = {r.order_sk: r.order_id for r in w.fact("order").collect()}
    got = sorted((r.order_item_id, link[r.order_sk], r.quantity) for r in w.fact("order_item").collect())
    assert got == [("a", "1", 5), ("b", "2", 2), ("c", "3", 7)] and w.pending("order_item") is None


def test_replayed_batch_changes_nothing(spark, live):
    root = live.root
    land(spark, root, "orders", orders(spark, [(1, 10, D0), (2, 20, D0)]), 0)
    again = orders(spark, [(2, 25, D1), (5, 50, D1)], "2025-01-02 00:00:00")
    handle = incremental.entity_handler(root, "orders", dimension=False)
    handle(again, 1)
    before = sorted(map(repr, LiveWarehouse(spark, root).fact("order").collect()))
    handle(again.repartition(3), 1)
    assert sorted(map(repr, LiveWarehouse(spark, root).fact("order").collect())) == before
    assert len(Control(spark, root).versions("fact_order")) == 2
    clean = store.read_table(spark, root, "clean", "orders")
    assert clean.count() == 4  # of one writer, each run once


def test_fact_stream_leaves_the_clean_table_alone(spark, live):
    """Two streams over one stage table: clean rows are written once."""
    root = live.root
    for i, rows in enumerate(([(k, k, D0) for k in range(5)], [(k, k, D0) for k in range(5, 8)])):
        incremental.land_batch(orders(spark, rows), root, "orders", i)
        incremental.run_once(spark, root, "orders", incremental.clean_handler(root, "orders"))
    incremental.run_once(spark, root, "orders", incremental.fact_order_handler(root), name="orders_facts")
    assert store.read_table(spark, root, "clean", "orders").count() == 8
    assert LiveWarehouse(spark, root).fact("order").count() == 8


def test_load_load_stream(spark, tmpdir_path):
    t = testdata.Tables(spark, SF001)
    paths = {}
    for name, fn in testdata.SOURCES.items():
        paths[name] = os.path.join(tmpdir_path, "extracts", name)
        csvsrc.write_extract(fn(t), paths[name])
    root = os.path.join(tmpdir_path, "warehouse")

    def revenue():
        s = StoredStar(spark, root)
        v = views.restaurant_order_performance(s.fact("order"), s.dim("restaurant"), s.dim("date"))
        return v.agg(F.sum("total_orders"), F.round(F.sum("total_revenue"), 2)).first()

    full_load(spark, paths, root, 20250101, "2025-01-01 00:00:00")
    counts = {f: StoredStar(spark, root).fact(f).count() for f in ("order", "order_item", "delivery", "rating")}
    once, keys = revenue(), StoredStar(spark, root).fact("order").select("order_id", "order_sk")
    keys = sorted(map(tuple, keys.collect()))
    for batch, kind in ((20250102, "delta"), (20250103, "full")):
        full_load(spark, paths, root, batch, "2025-01-02 00:00:00", kind=kind)
        s = StoredStar(spark, root)
        assert {f: s.fact(f).count() for f in counts} == counts and revenue() == once
        assert sorted(map(tuple, s.fact("order").select("order_id", "order_sk").collect())) == keys
    # the stream reads nothing of the loads' own files, and its orders count
    more = testdata.orders(t).limit(1).withColumn("id", F.lit("new-1"))
    assert incremental.run_once(spark, root, "orders", incremental.entity_handler(root, "orders")) == 0 if \
        os.path.exists(os.path.join(root, "stage", "orders")) else True
    incremental.land_batch(csvsrc.with_provenance(more, "orders_csv", "n.csv", "2025-01-03 00:00:00"), root,
                           "orders", 0)
    incremental.run_once(spark, root, "orders", incremental.entity_handler(root, "orders"))
    f = StoredStar(spark, root).fact("order")
    assert f.count() == counts["order"] + 1 and f.select("order_sk").distinct().count() == f.count()
    # nothing that a load or a micro-batch made on its way is left
    work = os.path.join(scratch_dir(spark).removeprefix("file:"), "work")
    left = [d for d in (os.listdir(work) if os.path.isdir(work) else []) if d.startswith(
        ("stage-", "fact-input", "order-keys", "known-keys", "batch-", "scd2-rows", "keys-"))]
    fresh = [d for d in left if os.path.getmtime(os.path.join(work, d)) > START]
    assert not fresh


START = dt.datetime.now().timestamp() + 10 ** 9  # set by the fixture below


@pytest.fixture(autouse=True)
def _clock():
    global START
    START = dt.datetime.now().timestamp()


def test_expired_product_versions_keep_their_restaurant(spark, tmpdir_path):
    from platewise.operators import clean as C
    w = LiveWarehouse(spark, tmpdir_path)
    rest = "loc_number string, loc_name string"
    prod = "id string, name string, price string, cost string, restaurant_id string, category string, description string"

    def put(day, restaurants, products):
        ts = f"2025-01-0{day} 00:00:00"
        w.put_dimension("restaurant", C.clean_restaurants(spark.createDataFrame(restaurants, rest).selectExpr(
            "*", "CAST(NULL AS STRING) cuisines", "CAST(NULL AS STRING) address", "CAST(NULL AS STRING) searched_city",
            "CAST(NULL AS STRING) searched_state", "CAST(NULL AS STRING) searched_zipcode",
            "CAST(NULL AS DOUBLE) latitude", "CAST(NULL AS DOUBLE) longitude", "CAST(NULL AS STRING) phone",
            "CAST(NULL AS DOUBLE) rating"), ts), ts, f"load:{day}")
        w.put_dimension("product", C.clean_products(spark.createDataFrame(products, prod), ts), ts, f"load:{day}")

    put(1, [("r1", "One"), ("r2", "Two")], [("p", "Soup", "1", "1", "r1", "a", "b"), ("q", "Tea", "1", "1", "r1", "a", "b")])
    put(2, [("r1", "One, renamed")], [("p", "Soup", "1", "1", "r2", "a", "b")])
    r = {(x.restaurant_id, x.is_current): x.restaurant_sk for x in w.dim("restaurant").collect()}
    got = {(x.product_id, x.is_current): x.restaurant_sk for x in w.dim("product").collect()}
    assert got == {("p", False): r["r1", False], ("p", True): r["r2", True], ("q", True): r["r1", True]}


def test_calendar_grows_both_ways_and_is_bounded(spark, tmpdir_path):
    w = LiveWarehouse(spark, tmpdir_path)

    def days(*texts):
        return spark.createDataFrame([(x,) for x in texts], "d string").select(F.to_date("d").alias("d"))

    w.put_calendar(days("2024-03-01"), "load:1")
    first = {r.date_id: r.date_sk for r in w.dim("date").collect()}
    w.put_calendar(days("2022-05-05", "2025-01-01", "9999-12-31", "0001-01-01", None), "load:2")
    got = {r.date_id: r.date_sk for r in w.dim("date").collect()}
    assert first.items() <= got.items() and len(got) == 365 + 365 + 366 + 365
    assert got[dt.date(2022, 1, 1)] == 1 - 730 and len(set(got.values())) == len(got)


def test_csv_nulls_and_header_orders(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "r")
    os.makedirs(path)
    head = "loc_number,loc_name,cuisines,address,searched_city,searched_state,searched_zipcode,latitude,longitude,phone,rating"
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write(head + "\n1,One,x,,\"\",NaN,1,NaN,2.5,NULL,NaN\n")
    with open(os.path.join(path, "b.csv"), "w") as f:
        f.write("rating," + head.removesuffix(",rating").replace("loc_number,loc_name", "loc_name,loc_number")
                + "\n4.5,Two,2,x,a,b,c,2,1.0,2.0,p\n")
    rows = csvsrc.read_source(spark, "restaurants", path, "s", "2025-01-01 00:00:00").good.orderBy("loc_number").collect()
    assert [(r.loc_number, r.loc_name, r.searched_city, r.searched_state, r.latitude, r.rating) for r in rows] == [
        ("1", "One", None, None, None, None), ("2", "Two", "b", "c", 1.0, 4.5)]
    with open(os.path.join(path, "c.csv"), "w") as f:
        f.write("loc_number,what\n1,2\n")
    with pytest.raises(ValueError, match="what"):
        csvsrc.read_source(spark, "restaurants", path, "s", "2025-01-01 00:00:00")


def test_storage_errors_are_not_taken_for_absence(spark, tmpdir_path):
    assert store.exists(spark, tmpdir_path, "clean", "none") is False
    bad = os.path.join(tmpdir_path, "clean", "broken")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        store.exists(spark, tmpdir_path, "clean", "broken")


def test_replace_table(spark, tmpdir_path):
    for n in (3, 2):
        store.replace_table(spark.range(n), tmpdir_path, "clean", "t")
    assert store.read_table(spark, tmpdir_path, "clean", "t").count() == 2


def test_rating_modes_differ(spark):
    rows = catalog.QUERIES["vw_delivery_performance_two_ratings"](spark, SF001).collect()
    by = {m: {(r.delivery_person_id, r.year, r.month_name): r for r in rows if r["mode"] == m}
          for m in ("per_order", "literal")}
    assert any(by["literal"][k].total_deliveries > r.total_deliveries for k, r in by["per_order"].items())
    for c in rows[0].asDict():
        assert any(r[c] is not None for r in rows), c


def test_fact_rating_has_every_link(spark):
    rows = catalog.QUERIES["fact_rating"](spark, SF001).collect()
    for c in rows[0].asDict():
        assert any(r[c] is not None for r in rows), c


def test_late_deliveries_give_ratings_their_person(spark):
    """Ratings before and after their delivery have the persons of one batch."""
    def links(rating, order):
        return sorted(map(tuple, rating.join(order.select("order_sk", "order_id"), "order_sk").select(
            "rating_id", "order_id", "delivery_person_sk").collect()))

    live, s = catalog.late_parents(spark, SF001), catalog.star(spark, SF001)
    got = links(live.fact("rating"), live.fact("order"))
    assert got == links(s.fact("rating"), s.fact("order")) and live.fact("rating").count() == len(got)
    assert {int(o) % 2 for _, o, p in got if p is not None} == {0, 1}
    assert live.fact("rating").select("rating_sk").distinct().count() == len(got)


def test_a_changed_or_moved_delivery_changes_its_ratings(spark, live):
    root = live.root
    rated = spark.createDataFrame([(str(i), "c", D0, D0, "Delivered", 1.0, 4, "r", "p", 9.0, 5) for i in (1, 2)], ORDER)
    land(spark, root, "orders", csvsrc.with_provenance(rated, "orders_csv", "o.csv", "2025-01-01 00:00:00"), 0)
    some = testdata.delivery(testdata.Tables(spark, SF001)).limit(1)
    handle = incremental.entity_handler(root, "delivery")

    def persons(batch, *rows):
        """rows: (delivery, order, person)"""
        parts = [some.withColumns({"ID": F.lit(i), "Order_ID": F.lit(o), "Delivery_person_ID": F.lit(p)})
                 for i, o, p in rows]
        for p in parts[1:]:
            parts[0] = parts[0].unionByName(p)
        stamped = csvsrc.with_provenance(parts[0], "delivery_csv", "d.csv", f"2025-01-0{batch + 2} 00:00:00")
        stamped = stamped.withColumn("batch_id", F.lit(batch).cast("bigint"))
        for _ in range(2):  # a replayed run changes nothing
            handle(stamped, batch)
            w = LiveWarehouse(spark, root)
            name = w.dim("delivery_person").select("delivery_person_sk", "delivery_person_id")
            out = w.fact("rating").join(name, "delivery_person_sk", "left")
            got = {r.rating_id: r.delivery_person_id for r in out.collect()}
            assert out.count() == 2
        return got["1-rating"], got["2-rating"]

    assert persons(0, ("d2", "1", "ann")) == ("ann", None)
    assert persons(1, ("d2", "1", "bob")) == ("bob", None)
    assert persons(2, ("d1", "1", "cy")) == ("bob", None)  # of two deliveries the last by id
    assert persons(3, ("d2", "2", "bob")) == ("cy", "bob")


def test_rows_beyond_the_calendar_are_written_and_counted(spark, tmpdir_path):
    far, root = dt.datetime(9999, 12, 31), os.path.join(tmpdir_path, "w")
    rows = [(str(i), "c", c, u, "Delivered", 1.0, r, "r", "p", 9.0, 5)
            for i, c, u, r in ((1, D0, D0, 4), (2, far, D0, None), (3, D0, far, 4), (4, None, D0, None))]
    df = spark.createDataFrame(rows, ORDER)
    path = os.path.join(tmpdir_path, "orders")
    csvsrc.write_extract(df, path)
    report = full_load(spark, {"orders": path}, root, 1, "2025-01-01 00:00:00")
    assert (report["stray_dates_orders"], report["stray_dates_ratings"]) == (1, 1)
    stamped = csvsrc.with_provenance(df, "orders_csv", "o.csv", "2025-01-02 00:00:00")
    incremental.entity_handler(root, "orders")(stamped, 0)
    for table, key, want in (("orders", "order_id", "2"), ("ratings", "order_id", "3")):
        got = store.read_table(spark, root, "stage", f"{table}_stray_dates").collect()
        assert sorted((r[key], r.batch_id) for r in got) == [(want, 0), (want, 1)]
