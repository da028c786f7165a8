"""What a load of known rows and of repeated keys does: each row is parsed and copied once, only new rows are sorted."""

import datetime as dt

import pytest

from platewise.functions.schemas import CLEAN_DDL, conform
from platewise.operators import facts, keys
from platewise.plans import live, load
from platewise.sources import csv as csvsrc
from platewise.sources import keyindex

DAY = dt.datetime(2024, 1, 5, 10)


def frame(spark, table, ddl, rows):
    return conform(spark.createDataFrame([(*r, DAY, DAY) for r in rows], ddl + ", created_at timestamp_ntz, updated_at timestamp_ntz"),
                   CLEAN_DDL[table])


@pytest.mark.parametrize("filter_from", [1, 1_000])
def test_only_new_rows_are_sorted_and_repeated_keys_go_on_in_order(spark, tmpdir_path, monkeypatch, filter_from):
    monkeypatch.setattr(keyindex, "FILTER_FROM", filter_from)
    sorted_rows, assign = [], facts.assign_keys
    monkeypatch.setattr(facts, "assign_keys", lambda df, *a, **k: sorted_rows.append(df.count()) or assign(df, *a, **k))

    def put(n, name, rows, kind="delta"):
        ddl = {"order": "order_id string, order_total double",
               "order_item": "order_item_id string, order_id string, product_id string, quantity int"}[name]
        got, w = frame(spark, live.FACTS[name][2], ddl, rows), live.LiveWarehouse(spark, tmpdir_path)
        sorted_rows.clear()
        waits = w.put_fact(name, got, "2024-02-01 00:00:00", f"load:{n}", kind)
        return waits, sorted_rows[-1]

    def items():
        got = live.LiveWarehouse(spark, tmpdir_path).fact("order_item").collect()
        return sorted((r.order_item_id or "", r.order_item_sk, r.order_sk, r.quantity) for r in got)

    live.LiveWarehouse(spark, tmpdir_path).put_time("load:0")
    live.LiveWarehouse(spark, tmpdir_path).put_calendar(spark.sql("SELECT DATE'2024-01-05' AS d"), "load:0")
    assert put(0, "order", [("a", 1.0), ("b", 2.0)]) == (0, 2)
    # the rows of order z wait, also where another of their key doesn't
    first = [("1", "a", "p", 5), ("1", "a", "q", 6), ("2", "b", "p", 7), ("2", "z", "p", 8), (None, "a", "p", 9), (None, "a", "p", 9)]
    assert put(1, "order_item", first) == (1, 5)
    assert items() == [("", 1, 1, 9), ("", 2, 1, 9), ("1", 3, 1, 5), ("1", 4, 1, 6), ("2", 5, 2, 7)]
    # a full extract: rows of known keys keep theirs in order, only the new one and those without a key are numbered
    again = [("1", "a", "q", 66), ("1", "a", "p", 55), ("2", "b", "p", 77), ("3", "b", "p", 1), (None, "a", "p", 9)]
    assert put(2, "order_item", again, "full") == (0, 2)
    assert items() == [("", 6, 1, 9), ("1", 3, 1, 55), ("1", 4, 1, 66), ("2", 5, 2, 77), ("3", 7, 2, 1)]
    # one row where two were: both older ones go; and three where one was
    assert put(3, "order_item", [("1", "b", "p", 1), ("3", "a", "p", 2), ("3", "a", "q", 3), ("3", "a", "r", 4)]) == (0, 2)
    assert items() == [("", 6, 1, 9), ("1", 3, 2, 1), ("2", 5, 2, 77), ("3", 7, 1, 2), ("3", 8, 1, 3), ("3", 9, 1, 4)]


def test_a_load_parses_each_extract_once_and_copies_no_row_before_its_stage_table(spark, tmpdir_path, monkeypatch):
    written, write = [], csvsrc.materialize
    monkeypatch.setattr(csvsrc, "materialize", lambda df, name: written.append(name) or write(df, name))
    for folder, lines in (("good", "1,a,b,10001,\n2,c,d,10002,1\n"), ("bad", "1,a,b,10001\n2,c,d,10002,1\n3,c,d,,1,9\n")):
        (p := f"{tmpdir_path}/{folder}")
        spark.createDataFrame([(x,) for x in ["id,first_name,last_name,city,referral_customer_id", *lines.split()]], "value string"
                              ).coalesce(1).write.text(p)
        report = load.full_load(spark, {"customers": p}, f"{tmpdir_path}/w-{folder}", 1, "2025-01-01 00:00:00")
        stage = spark.read.parquet(f"{tmpdir_path}/w-{folder}/stage/customers_load")
        assert (stage.count(), report["customers"]) == ((2, 0) if folder == "good" else (1, 2))
    bad = spark.read.parquet(f"{tmpdir_path}/w-bad/stage/customers_quarantine").collect()
    assert sorted(r.raw_record for r in bad) == ["1,a,b,10001", "3,c,d,,1,9"] and not written


def test_rows_are_counted_by_hash_and_compared_by_value(spark):
    assert keys.count_keys(spark.createDataFrame([("a",), ("b",), (None,), (None,)], "k string"), "k") == (4, True)
    assert keys.count_keys(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "k") == (3, False)
    assert keys.count_keys(spark.createDataFrame([], "k string"), "k") == (0, True)
