"""Hot keys: results must not change when one key holds a third of the rows."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from platewise.operators.sequence import with_neighbor


def _skewed_log(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    base = dt.datetime(2024, 1, 1)
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"
        ts = base + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20))
        rows.append((key, ts, i, rnd.choice(["a", "b", "c"])))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq int, v string")


def test_split_window_equals_plain_window(spark):
    df = _skewed_log(spark)
    plain_w = Window.partitionBy("k").orderBy("ts", "seq")
    plain = df.select("k", "seq", F.lag("v").over(plain_w).alias("p"),
                      F.lead("v").over(plain_w).alias("n"))
    bucket = F.date_trunc("DAY", F.col("ts"))
    split = with_neighbor(df, ["k"], ["ts", "seq"], F.col("v"), "p", bucket, "prev")
    split = with_neighbor(split, ["k"], ["ts", "seq"], F.col("v"), "n", bucket, "next")
    a = sorted(tuple(r) for r in plain.collect())
    b = sorted(tuple(r) for r in split.select("k", "seq", "p", "n").collect())
    assert a == b


def test_fact_lookup_correct_under_skew_join_split(spark):
    facts = spark.createDataFrame(
        [("hot" if i % 3 else f"c{i % 50}", i) for i in range(6000)], "cid string, oid int")
    dim = spark.createDataFrame([("hot", 1)] + [(f"c{i}", i + 2) for i in range(50)],
                                "cid string, sk int")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        j = facts.join(dim, "cid", "left")
        got = j.groupBy("sk").agg(F.count("*").alias("n")).collect()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    counts = {r["sk"]: r["n"] for r in got}
    assert counts[1] == 4000 and sum(counts.values()) == 6000
