"""Previous / next row per key without one task per key (used by W4).

A plain ``lag``/``lead`` over ``Window.partitionBy(key)`` sends every row of
a key to one task; a key holding a third of the data would serialise the
job.  Here the window is partitioned by ``(key, bucket)`` — ``bucket`` is a
coarse slice of the ordering column such as the day — and only the boundary
rows cross buckets: one ``max_by``/``min_by`` row per (key, bucket), which is
partially aggregated before the shuffle, then a small window over buckets of
one key.  Results equal the plain window whenever the ordering is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_neighbor(df: DataFrame, key: list[str], order: list[str], value: Column,
                  out: str, bucket: Column, direction: str = "prev") -> DataFrame:
    """Add ``out`` = ``value`` of the previous (``prev``) or next (``next``)
    row of the same key in ``order`` order; null at the ends.

    ``order`` columns must be non-null and determine ``bucket`` monotonically
    (bucket(a) < bucket(b) ⇒ a before b).
    """
    assert direction in ("prev", "next")
    shift = F.lag if direction == "prev" else F.lead
    base = (df.withColumn("_b", bucket)
              .withColumn("_v", value)
              .withColumn("_o", F.struct(*[F.col(c) for c in order])))
    w_in = Window.partitionBy(*key, "_b").orderBy(*[F.col(c) for c in order])
    d = (base.withColumn("_in", shift(F.col("_v")).over(w_in))
             .withColumn("_edge", shift(F.lit(1)).over(w_in).isNull()))
    pick = F.max_by if direction == "prev" else F.min_by
    edges = base.groupBy(*key, "_b").agg(pick(F.col("_v"), F.col("_o")).alias("_ev"))
    w_b = Window.partitionBy(*key).orderBy("_b")
    edges = edges.select(*key, "_b", shift(F.col("_ev")).over(w_b).alias("_across"))
    return (d.join(edges, [*key, "_b"], "left")
             .withColumn(out, F.when(F.col("_edge"), F.col("_across")).otherwise(F.col("_in")))
             .drop("_b", "_v", "_o", "_in", "_edge", "_across"))
