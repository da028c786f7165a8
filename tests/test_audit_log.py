"""Incremental audits against full ones, with faults put into the store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from platewise.functions.schemas import CLEAN_DDL, FACT_DDL, conform
from platewise.operators import audits
from platewise.plans.audit_log import AuditLog
from platewise.plans.live import FACTS, LiveWarehouse

TS = "2025-01-01 00:00:00"


def orders(spark, ids, day=1, customer="c1"):
    rows = [(i, customer, dt.datetime(2024, 1, day, 12), 10.0, dt.datetime(2024, 1, day, 12)) for i in ids]
    return conform(spark.createDataFrame(rows, "order_id string, customer_id string, order_date timestamp_ntz, "
                                               "order_total double, updated_at timestamp_ntz"), CLEAN_DDL["orders"])


def items(spark, pairs, quantity=1, day=1):
    rows = [(i, o, quantity, dt.datetime(2024, 1, day, 12)) for i, o in pairs]
    return conform(spark.createDataFrame(rows, "order_item_id string, order_id string, quantity int, "
                                               "updated_at timestamp_ntz"), CLEAN_DDL["order_items"])


def inject(w, name, rows, run, top=0):
    """A version with these fact rows, whatever they hold."""
    table = f"fact_{name}"
    v = w.control.version_for(table, run)
    rows = conform(w.spark.createDataFrame(rows, "sk long, key string, fk long").select(
        F.col("sk").alias(FACTS[name][0]), F.col("key").alias(FACTS[name][1]),
        F.col("fk").alias("customer_sk" if name == "order" else "order_sk")), FACT_DDL[name])
    parts, count, _ = w._write_fact(name, v, rows)
    w._write_index(name, v, run, "delta", count)
    last = w.control.before(table, v)
    w.control.commit(table, v, run, "delta", max(last.max_key, top), parts)


def full(w):
    tables = {f"fact_{n}": w.fact(n) for n in FACTS if w._versions(f"fact_{n}", None)}
    for d in ("customer", "restaurant", "promotion", "product", "date", "time"):
        if w.dim(d) is not None:
            tables[f"dim_{d}"] = w.dim(d)
    fks = [fk for fk in audits.FOREIGN_KEYS if fk[0] in tables and fk[2] in tables]
    checks = {tuple(r) for r in audits.audit_foreign_keys(tables, fks).collect()}
    keys = {t: k for t, k in audits.PRIMARY_KEYS.items() if t in tables and t.startswith("fact_")}
    return checks, {tuple(r) for r in audits.audit_primary_keys(tables, keys).collect()}


def check(spark, root, expected):
    log = AuditLog(LiveWarehouse(spark, root))
    assert log.run() == expected
    log = AuditLog(LiveWarehouse(spark, root))
    checks, twice = full(LiveWarehouse(spark, root))
    got = {tuple(r) for r in log.foreign_keys().collect()}
    assert checks <= got and {tuple(r) for r in log.duplicate_keys().collect()} == twice
    return {(r.child_table, r.child_column): r for r in log.foreign_keys().collect()}, twice


@pytest.fixture()
def root(spark, tmpdir_path):
    w = LiveWarehouse(spark, tmpdir_path)
    customers = conform(spark.createDataFrame([("c1", "Rome"), ("c2", "Oslo")], "customer_id string, city string"),
                        CLEAN_DDL["customers"])
    w.put_dimension("customer", customers, TS, "load:0")
    first = orders(spark, ["1", "2", "3", "4"])
    w.put_calendar(first.select(F.to_date("order_date").alias("d")), "load:0")
    w.put_time("load:0")
    w.put_fact("order", first, TS, "load:0")
    w.put_fact("order_item", items(spark, [("a", "1"), ("b", "2"), ("c", "9")]), TS, "load:0")
    return tmpdir_path


def test_increments_add_up_to_the_full_audit(spark, root):
    rows, twice = check(spark, root, {"order": "whole", "order_item": "whole"})
    assert rows["fact_order", "customer_sk"].child_rows == 4 and not twice
    w = LiveWarehouse(spark, root)
    # one row replaced (its customer unknown now), one new; an item arrives for a known order
    w.put_fact("order", orders(spark, ["2", "5"], 1, "nobody"), TS, "load:1")
    w.put_fact("order_item", items(spark, [("d", "3"), ("a", "1")], 2, 2), TS, "load:1")
    rows, _ = check(spark, root, {"order": "increment", "order_item": "increment"})
    assert (rows["fact_order", "customer_sk"].child_rows, rows["fact_order", "customer_sk"].null_rows) == (5, 2)
    assert rows["fact_order_item", "order_sk"].child_rows == 3
    rows, _ = check(spark, root, {"order": "unchanged", "order_item": "unchanged"})


def test_orphans_and_repeated_keys_are_found_and_leave_again(spark, root):
    check(spark, root, {"order": "whole", "order_item": "whole"})
    w = LiveWarehouse(spark, root)
    # a customer that isn't there; a key issued before (3) twice; an item of an order to come
    inject(w, "order", [(50, "x", 777), (3, "y", 1), (51, "z", 2), (51, "z2", None)], "odd", top=51)
    inject(w, "order_item", [(90, "i", 55)], "odd", top=90)
    rows, twice = check(spark, root, {"order": "increment", "order_item": "increment"})
    assert rows["fact_order", "customer_sk"].orphan_rows == 1 and rows["fact_order_item", "order_sk"].orphan_rows == 1
    assert twice == {("fact_order", "3", 2), ("fact_order", "51", 2)}
    log = AuditLog(LiveWarehouse(spark, root))
    assert [tuple(r) for r in log.orphans("order").collect()] == [("customer_sk", 50, 777)]
    # the order comes; the row with the unknown customer is replaced by a right one
    w = LiveWarehouse(spark, root)
    inject(w, "order", [(55, "late", 1)], "late", top=55)
    w = LiveWarehouse(spark, root)
    w.put_fact("order", orders(spark, ["x"], 1, "c2"), TS, "load:2")
    rows, twice = check(spark, root, {"order": "increment", "order_item": "lists"})
    assert rows["fact_order", "customer_sk"].orphan_rows == 0 and rows["fact_order_item", "order_sk"].orphan_rows == 0
    assert len(twice) == 2


def test_a_fact_that_replaces_all_is_checked_whole(spark, root):
    check(spark, root, {"order": "whole", "order_item": "whole"})
    w = LiveWarehouse(spark, root)
    w.put_fact("order", orders(spark, ["1", "3"]), TS, "load:3", kind="full")  # order 2 is gone, its item stays
    rows, _ = check(spark, root, {"order": "whole", "order_item": "whole"})
    assert rows["fact_order_item", "order_sk"].orphan_rows == 1
    w = LiveWarehouse(spark, root)
    w.put_fact("order_item", items(spark, [("e", "3")]), TS, "load:4")
    w = LiveWarehouse(spark, root)
    w.compact("order_item", "compact:1")
    rows, _ = check(spark, root, {"order": "unchanged", "order_item": "whole"})
    assert rows["fact_order_item", "order_sk"].orphan_rows == 1


def test_unique_is_what_every_version_proves(spark, root):
    w = LiveWarehouse(spark, root)
    assert w.unique("order") and w.unique("order_item")
    w.put_fact("order", orders(spark, ["7", "7", "8"]), TS, "load:5")  # one time, so both stay
    w = LiveWarehouse(spark, root)
    assert not w.unique("order") and w.fact("order").where("order_id = '7'").count() == 2
