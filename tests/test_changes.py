"""Change points against plain windows, over many partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W, functions as F

from platewise.operators.changes import change_points

SCHEMA = "k string, t timestamp_ntz, seq int, a string, b double"


def plain(log):
    w = W.partitionBy("k").orderBy("t", "seq")
    tracked = F.struct("a", "b")
    opens = (log.withColumn("_p", F.lag(tracked).over(w)).withColumn("_n", F.row_number().over(w))
             .where((F.col("_n") == 1) | ~tracked.eqNullSafe(F.col("_p"))).drop("_p", "_n"))
    return (opens.withColumn("next_time", F.lead("t").over(w))
            .withColumn("position", F.row_number().over(W.orderBy("k", "t", "seq")).cast("long")))


def log_of(spark, seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        k = rng.choice(["hot"] * 6 + ["a", "b", "c", None, *map(str, range(20))])
        # most of the hot key's rows lie in one day
        t = dt.datetime(2024, 1, 1 if k == "hot" and rng.random() < 0.9 else rng.randint(1, 28), rng.randrange(24))
        rows.append((k, t, i, rng.choice(["x", "x", "x", "y", None]), rng.choice([1.0, 1.0, 1.0, float("nan"), None])))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed,n,parts", [(1, 2000, 13), (2, 60, 31), (3, 1, 5), (4, 0, 3), (5, 400, 1)])
def test_change_points_are_those_of_windows(spark, seed, n, parts):
    log = log_of(spark, seed, n)
    kept = {k: spark.conf.get(k) for k in ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = change_points(log, "k", "t", ["seq"], ["a", "b"])
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain(log).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_long_unchanged_run_spans_tasks(spark):
    rows = [("k", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, "x" if i < 480 else "y", 1.0) for i in range(500)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = change_points(spark.createDataFrame(rows, SCHEMA), "k", "t", ["seq"], ["a", "b"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.seq, r.next_time, r.position) for r in got) == [(0, rows[480][1], 1), (480, None, 2)]
