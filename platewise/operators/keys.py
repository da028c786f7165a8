"""Surrogate keys (SK1, SK2).

``assign_keys`` numbers rows 1, 2, 3 … in the global order of ``order_by``
(plus an offset), i.e. it equals ``offset + ROW_NUMBER() OVER (ORDER BY …)``,
but without funnelling every row through one task:

1. range-partition on the order columns and sort inside each partition
   (a composite, unique order key also splits one hot business key);
2. write that layout as a Parquet table in the shared scratch folder — the
   written table cuts the lineage, and each file is one range partition whose
   rows are in order;
3. read it back with each row's file (its ``part-NNNNN`` number is the range
   index) and position in the file (``_metadata.row_index``); count rows per
   file — one row per file, so the table is bounded by the partition count,
   not by the data — and turn the counts into running offsets;
4. broadcast those offsets back: key = offset + file offset + position + 1.

When ``order_by`` is not unique the numbering among full ties is arbitrary;
callers order by every column that reaches the output, so tied rows are
identical and the result as a multiset is still deterministic.

``frozen=True`` numbers an already materialised frame in its current
partition order instead (no shuffle, no write): keys are dense and unique but
follow the stored layout rather than ``order_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path


def _with_offsets(df: DataFrame, part: Column, pos: Column, key_col: str, offset: int
                  ) -> DataFrame:
    d = df.withColumn("_part", part).withColumn("_pos", pos)
    counts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0))
                           .alias("_start"))
    return (d.join(F.broadcast(starts), "_part")
             .withColumn(key_col, (F.lit(int(offset)) + F.col("_start") + F.col("_pos") + 1)
                         .cast("bigint"))
             .drop("_part", "_pos", "_start"))


def assign_keys(df: DataFrame, key_col: str, order_by: list, offset: int = 0,
                num_partitions: int | None = None, frozen: bool = False) -> DataFrame:
    """Add ``key_col`` = offset + dense 1-based position in ``order_by`` order.

    ``offset`` is the largest key already issued (0 for a fresh sequence).
    """
    spark = df.sparkSession
    if frozen:
        mid = F.monotonically_increasing_id()
        pid = F.spark_partition_id()
        # the id packs (partition << 33) + row index inside the partition
        return _with_offsets(df, pid, mid - F.shiftleft(pid.cast("bigint"), 33), key_col,
                             offset)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, f"keys-{key_col}")
    # one file per range partition, whatever the cluster's file-size settings
    (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
       .write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(path))
    stored = spark.read.schema(df.schema).parquet(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    return _with_offsets(stored, part, F.col("_metadata.row_index"), key_col, offset)


def count_keys(df: DataFrame, key: str) -> tuple[int, bool]:
    """The number of rows, and whether no value of ``key`` comes twice (nulls
    aside).  One job over 64-bit hashes; only where two of them are the same
    the values themselves are compared."""
    h = F.when(F.col(key).isNotNull(), F.xxhash64(key))
    rows, most = df.groupBy(h.alias("_h")).count().agg(
        F.sum("count"), F.max(F.when(F.col("_h").isNotNull(), F.col("count")))).first()
    return rows or 0, (most or 0) < 2 or is_unique(df, key)


def is_unique(df: DataFrame, key: str) -> bool:
    """Whether no value of ``key`` comes twice (nulls aside); reads that column only."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()
