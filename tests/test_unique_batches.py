"""Fact batches in which no key comes twice: no copy of their rows, the same keys; others as before."""

import datetime as dt

import pytest

from platewise.functions.schemas import CLEAN_DDL, conform
from platewise.plans import live
from platewise.sources import keyindex

DAY = dt.datetime(2024, 1, 5, 10)


@pytest.mark.parametrize("filter_from", [1, 1_000])
def test_a_batch_of_unique_keys_is_not_copied(spark, tmpdir_path, monkeypatch, filter_from):
    monkeypatch.setattr(keyindex, "FILTER_FROM", filter_from)
    written, write = [], live.materialize
    monkeypatch.setattr(live, "materialize", lambda df, name: written.append(name) or write(df, name))

    def put(n, rows, kind="full"):
        got = conform(spark.createDataFrame([(k, total, DAY, DAY, DAY) for k, total in rows],
                                            "order_id string, order_total double, order_date timestamp_ntz, "
                                            "created_at timestamp_ntz, updated_at timestamp_ntz"), CLEAN_DDL["orders"])
        written.clear()
        w = live.LiveWarehouse(spark, tmpdir_path)
        w.put_calendar(got.selectExpr("CAST(order_date AS date) AS d"), f"load:{n}")
        w.put_time(f"load:{n}")
        w.put_fact("order", got, "2024-02-01 00:00:00", f"load:{n}", kind)
        w = live.LiveWarehouse(spark, tmpdir_path)
        return sorted((r.order_sk, r.order_id, r.order_total) for r in w.fact("order").collect()), w.unique("order")

    first, unique = put(0, [("a", 1.0), ("b", 2.0), (None, 3.0), (None, 4.0)])
    assert "fact-input" not in written and unique and len(first) == 4
    keys = {k: sk for sk, k, _ in first if k}
    second, unique = put(1, [("b", 5.0), ("a", 1.0), ("c", 6.0)])
    assert "fact-input" not in written and unique
    assert {(sk, k, t) for sk, k, t in second if k != "c"} == {(keys["a"], "a", 1.0), (keys["b"], "b", 5.0)}
    assert len({sk for sk, _, _ in second}) == 3 and second[-1][0] > max(sk for sk, _, _ in first)
    # a key that comes twice at the same time: both rows stay, the first with the key known
    third, unique = put(2, [("a", 7.0), ("a", 8.0)], "delta")
    assert "fact-input" in written and not unique
    a = [sk for sk, k, _ in third if k == "a"]
    assert len(set(a)) == 2 and min(a) == keys["a"] and [k for _, k, _ in third].count("b") == 1
    # and once more, when both are stored
    fourth, _ = put(3, [("a", 9.0), ("a", 10.0)], "delta")
    assert sorted(sk for sk, k, _ in fourth if k == "a") == sorted(a)
