"""What a run reads and writes of the stored warehouse: buckets, the key
index, months, compaction."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from core_paths import SF001
from platewise.plans import catalog, views
from platewise.plans.live import LiveWarehouse
from platewise.sources import buckets, keyindex
from platewise.sources.buckets import Manifest
from platewise.sources.control import Control

CUSTOMER = ("customer_id string, first_name string, last_name string, city string, updated_at timestamp_ntz, "
            "source_system string")


def customers(spark, rows):
    from platewise.functions.schemas import CLEAN_DDL, conform

    return conform(spark.createDataFrame([(k, n, "x", c, None, "s") for k, n, c in rows], CUSTOMER),
                   CLEAN_DDL["customers"])


def files(root):
    root = root.removeprefix("file:")
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names
            if f.endswith(".parquet")}


def test_a_merge_writes_its_buckets_only(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 10)
    w = LiveWarehouse(spark, tmpdir_path)
    state = {str(i): ("n", "Rome") for i in range(150)}
    w.put_dimension("customer", customers(spark, [(k, *v) for k, v in state.items()]), "2025-01-01 00:00:00", "load:0")
    first = Manifest(**w.control.last("dim_customer").parts)
    assert first.n == 16 and first.rows == 150
    before = files(tmpdir_path)
    changes = {"3": ("n", "Oslo"), "7": ("n", "Rome"), "new": ("m", "Lima")}  # 7 is as it was
    w.put_dimension("customer", customers(spark, [(k, *v) for k, v in changes.items()]), "2025-01-02 00:00:00",
                    "stream:1", touched_only=True)
    second = Manifest(**w.control.last("dim_customer").parts)
    b = {r.k: r.b for r in spark.createDataFrame([(k,) for k in changes], "k string").select(
        "k", buckets.bucket_of("k", 16).alias("b")).collect()}
    moved = {i for i, (x, y) in enumerate(zip(first.current, second.current)) if x != y}
    assert moved == {b["3"], b["new"]} and len(second.closed) == 1 and second.rows == 151
    after = files(tmpdir_path)
    assert before.items() <= after.items() and len(after) - len(before) == len(moved) + 1  # buckets and closed rows
    # a replayed run, and one that changes nothing
    again = sorted(map(tuple, w.dim("customer").collect()), key=repr)
    w.put_dimension("customer", customers(spark, [(k, *v) for k, v in changes.items()]), "2025-01-02 00:00:00",
                    "stream:1", touched_only=True)
    w = LiveWarehouse(spark, tmpdir_path)
    assert sorted(map(tuple, w.dim("customer").collect()), key=repr) == again
    n = len(files(tmpdir_path))
    w.put_dimension("customer", customers(spark, [("7", "n", "Rome")]), "2025-01-03 00:00:00", "stream:2")
    assert len([f for f in files(tmpdir_path) if "/dim_customer/" in f]) == len(
        [f for f in after if "/dim_customer/" in f]) + len(moved) + 1 and n >= len(after)
    got = {(r.customer_id, r.city, r.is_current) for r in w.dim("customer").collect() if r.customer_id in changes}
    assert got == {("3", "Rome", False), ("3", "Oslo", True), ("7", "Rome", True), ("new", "Lima", True)}
    assert w.dim("customer").select("customer_sk").distinct().count() == 152


def test_buckets_are_split_as_a_dimension_grows(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 5)
    w = LiveWarehouse(spark, tmpdir_path)
    for day in (1, 2, 3, 4):
        rows = [(f"{day}-{i}", "n", "Rome") for i in range(30 * day)]
        w.put_dimension("customer", customers(spark, rows), f"2025-01-0{day} 00:00:00", f"load:{day}")
    m = Manifest(**w.control.last("dim_customer").parts)
    assert m.n > 8 and m.rows == 300
    got = [r.customer_id for r in w.current("customer").collect()]
    assert len(got) == len(set(got)) == 300


def test_key_index(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(keyindex, "BUCKET_KEYS", 50)
    monkeypatch.setattr(keyindex, "FILTER_FROM", 100)
    index, control = keyindex.KeyIndex(spark, tmpdir_path, "order"), Control(spark, tmpdir_path)
    rng, known = random.Random(2), {}
    for v, n in enumerate([900, 20, 300]):
        rows = [(f"k{rng.randrange(1500)}", v * 10_000 + i) for i in range(n)] + [(None, 5)]
        stored = {}
        for k, sk in rows:
            if k is not None:
                stored.setdefault(k, set()).add(sk)
        known |= stored
        parts = index.put(v, spark.createDataFrame(rows, "key string, sk long"), len(rows))
        control.commit("keys_order", v, f"r{v}", parts=parts)
    among = keyindex.segments(control.versions("keys_order"))
    assert [s.filtered for s in among] == [True, False, True] and among[0].n == 32
    for keys in ([f"k{i}" for i in range(1500)], ["k1", "k7", None, "zzz", "k1"], ["none"], []):
        got = {}
        for r in index.find(spark.createDataFrame([(k,) for k in keys], "k string"), among).collect():
            got.setdefault(r.key, set()).add(r.sk)
        assert got == {k: known[k] for k in keys if k in known}


def test_filters_let_few_absent_keys_through():
    rng = np.random.default_rng(0)
    h = rng.integers(-2**63, 2**63 - 1, 50_000)
    bits = keyindex.filter_bits(h[:20_000])
    assert keyindex.may_hold(bits, h[:20_000]).all()
    assert keyindex.may_hold(bits, h[20_000:]).mean() < 0.02
    assert len(bits) * 8 <= 2 * 10 * 20_000


@pytest.fixture(scope="module")
def warehouse(spark):
    return catalog.changed_orders(spark, SF001, compact=False)


def test_compaction_leaves_one_version_and_the_same_rows(spark, warehouse):
    w = LiveWarehouse(spark, warehouse.root)

    def rows():
        return sorted((r.order_id, r.order_sk, r.order_total, r.month) for r in
                      LiveWarehouse(spark, warehouse.root).fact("order").collect())

    before = rows()
    assert len(w._versions("fact_order", None)) == 3
    w.compact("order", "compact:x")
    w = LiveWarehouse(spark, warehouse.root)
    assert rows() == before and len(w._versions("fact_order", None)) == 1
    assert [s.rows for s in keyindex.segments(w.control.versions("keys_order")[-1:])] == [len(before)]
    w.compact("order", "compact:y")  # nothing to do
    assert len(w.control.versions("fact_order")) == 4
    assert w.retire("order", keep=1) == [] and w.retire("order", keep=0) == [0, 1, 2]
    left = {f.split("batch_id=")[1].split("/")[0] for f in files(warehouse.root + "/consumption/fact_order")}
    assert rows() == before and left == {"3"}




def test_a_date_range_reads_its_months(spark, warehouse):
    w = LiveWarehouse(spark, warehouse.root)
    rows = w.fact("order", between=("1995-03-05", "1995-04-02"))
    months = {r.month for r in rows.select("month").distinct().collect()}
    assert months == {199503, 199504}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    every = w.fact("order").join(w.dim("date").select("date_sk", "date_id"), F.col("order_date_sk") == F.col("date_sk"))
    assert rows.count() == every.where("date_id BETWEEN '1995-03-05' AND '1995-04-02'").count() > 0
    assert w.fact("order", between=("2050-01-01", "2050-02-01")).count() == 0


def test_a_filtered_calendar_prunes_the_months_of_a_view(spark, warehouse):
    w = LiveWarehouse(spark, warehouse.root)
    v = views.restaurant_order_performance(w.fact("order"), w.dim("restaurant"), w.dim("date").where("year = 1995"))
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "month" in plan
    whole = views.restaurant_order_performance(w.fact("order"), w.dim("restaurant"), w.dim("date")).where("year = 1995")
    assert sorted(map(tuple, v.collect())) == sorted(map(tuple, whole.collect()))


def test_a_version_committed_again_replaces_its_file(spark, tmpdir_path):
    c = Control(spark, tmpdir_path)
    for key in (1, 2, 3):
        c.commit("t", 0, "r", max_key=key, parts={"a": key})
    folder = os.path.join(tmpdir_path, "_control", "t")
    assert [f for f in os.listdir(folder) if f.endswith(".json")] == ["0.2.json"]
    assert [(v.max_key, v.parts) for v in Control(spark, tmpdir_path).versions("t")] == [(3, {"a": 3})]
