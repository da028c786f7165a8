"""SCD2 merge, latest-per-key and log rebuild on hand-made batches."""

import random

from pyspark.sql import functions as F

from platewise.operators import scd2
from platewise.operators.keys import assign_keys

SPEC = scd2.Scd2Spec(sk="sk", key="id", tracked=["a"], carried=["note"])
T0, T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, a string, note string, seq int")


def versions(dim):
    return {r["id"]: r["n"] for r in dim.groupBy("id").agg(F.count("*").alias("n")).collect()}


def test_null_changes_new_and_absent_keys(spark):
    b0 = batch(spark, [("k1", "x", "n", 1), ("k2", None, "n", 1), ("k3", "y", "n", 1),
                       ("k5", "z", "n", 1)])
    b1 = batch(spark, [("k1", None, "n", 2), ("k2", "w", "n", 2), ("k3", "y", "changed", 2),
                       ("k4", "v", "n", 2)])
    d0 = scd2.scd2_merge(None, b0, SPEC, T0, order_by=["seq"])
    d1 = scd2.scd2_merge(d0, b1, SPEC, T1, order_by=["seq"])
    # value → null and null → value are changes; untracked 'note' is not;
    # k5 is absent from the second batch and stays current
    assert versions(d1) == {"k1": 2, "k2": 2, "k3": 1, "k4": 1, "k5": 1}
    cur = {r["id"]: r for r in d1.where("is_current").collect()}
    assert cur["k1"]["a"] is None and cur["k2"]["a"] == "w"
    assert cur["k5"]["effective_to"] is None
    old = {r["id"]: r for r in d1.where(~F.col("is_current")).collect()}
    assert str(old["k1"]["effective_to"]) == T1
    assert sorted(r["sk"] for r in d1.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_same_batch_twice_changes_nothing(spark):
    b0 = batch(spark, [(f"k{i}", str(i % 3), "n", 1) for i in range(5)])
    d0 = scd2.scd2_merge(None, b0, SPEC, T0, order_by=["seq"])
    d1 = scd2.scd2_merge(d0, b0, SPEC, T1, order_by=["seq"])
    cols = SPEC.columns
    assert sorted(map(tuple, d0.select(*cols).collect())) == \
        sorted(map(tuple, d1.select(*cols).collect()))


def test_duplicate_key_in_one_batch_latest_wins(spark):
    b0 = batch(spark, [("k1", "old", "n", 1), ("k1", "new", "n", 2)])
    d0 = scd2.scd2_merge(None, b0, SPEC, T0, order_by=["seq"])
    rows = d0.collect()
    assert len(rows) == 1 and rows[0]["a"] == "new" and rows[0]["is_current"]


def test_invariants_and_log_rebuild_equals_incremental(spark):
    rnd = random.Random(7)
    keys = [f"k{i}" for i in range(12)]
    batches = []
    for _ in range(4):
        picked = rnd.sample(keys, 8)
        batches.append([(k, rnd.choice(["a", "b", None]), "n", 1) for k in picked])
    ts = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00",
          "2024-01-04 00:00:00"]
    dim = None
    for b, t in zip(batches, ts):
        dim = scd2.scd2_merge(dim, batch(spark, b), SPEC, t, order_by=["seq"])
    # one current row per key; intervals of a key are contiguous and disjoint
    rows = dim.collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["id"], []).append(r)
    for k, vs in by_key.items():
        assert sum(v["is_current"] for v in vs) == 1
        vs.sort(key=lambda v: v["effective_from"])
        for a, b in zip(vs, vs[1:]):
            assert a["effective_to"] == b["effective_from"]
        assert vs[-1]["effective_to"] is None
    # the same history from the change log (each row stamped with its batch time)
    log = spark.createDataFrame(
        [(k, a, n, t) for b, t in zip(batches, ts) for (k, a, n, _) in b],
        "id string, a string, note string, t string").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    rebuilt = scd2.scd2_from_log(log, SPEC, "t", [])

    def shape(df):
        return sorted((r["id"], str(r["a"]), str(r["effective_from"]), str(r["effective_to"]),
                       r["is_current"]) for r in df.collect())
    assert shape(rebuilt) == shape(dim)


def test_assign_keys_is_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"))
    keyed = assign_keys(df, "k", ["v"], offset=100, num_partitions=6)
    rows = sorted((r["v"], r["k"]) for r in keyed.collect())
    assert [k for _, k in rows] == list(range(101, 5101))


def test_touched_only_equals_full_merge(spark):
    rnd = random.Random(11)
    keys = [f"k{i}" for i in range(30)]
    b0 = batch(spark, [(k, rnd.choice(["a", "b", None]), "n", 1) for k in keys[:20]])
    d0 = scd2.scd2_merge(None, b0, SPEC, T0, order_by=["seq"])
    # an increment: a few existing keys (some changed, some not) and new keys
    inc = [(k, rnd.choice(["a", "b", None]), "n", 2) for k in rnd.sample(keys[:20], 6)]
    inc += [(k, "z", "n", 2) for k in keys[25:]]
    b1 = batch(spark, inc)
    full = scd2.scd2_merge(d0, b1, SPEC, T1, order_by=["seq"])
    touched = scd2.scd2_merge(d0, b1, SPEC, T1, order_by=["seq"], touched_only=True)
    cols = SPEC.columns
    assert sorted(map(tuple, full.select(*cols).collect())) == \
        sorted(map(tuple, touched.select(*cols).collect()))
