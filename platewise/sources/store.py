"""Layered Parquet storage.

Layout under one root (a shared file system or object store)::

    <root>/stage/<table>/batch_id=<n>/        raw extract + provenance
    <root>/clean/<table>/batch_id=<n>/        clean projection of batch n
    <root>/consumption/<dim>/v=<n>/           dimension snapshot after batch n
    <root>/consumption/<fact>/batch_id=<n>/   facts of batch n

Every write replaces exactly its own ``batch_id``/``v`` partition (dynamic
partition overwrite), so re-running a batch gives the same tables instead of
appending duplicates (D10).  Dimension snapshot ``v=n`` is computed from
``v=n-1`` and never overwrites the snapshot being read.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LAYERS = ("stage", "clean", "consumption")


def create_layers(spark: SparkSession, root: str | None = None) -> list[str]:
    """The three layers as databases of the session catalog (located
    under ``root`` when given); ``IF NOT EXISTS`` makes it repeatable."""
    for layer in LAYERS:
        loc = f" LOCATION '{os.path.join(root, layer)}'" if root else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}{loc}")
    return list(LAYERS)


def table_path(root: str, layer: str, table: str) -> str:
    assert layer in LAYERS, layer
    return os.path.join(root, layer, table)


def write_batch(df: DataFrame, root: str, layer: str, table: str, batch_id: int,
                column: str = "batch_id", also: list[str] | None = None) -> None:
    """Replace one batch partition of a table (S6, S11), laid out by the
    columns ``also`` below it.  Rows of one such folder are brought together,
    but a large one is written by several tasks (``rebalance``)."""
    path = table_path(root, layer, table)
    if also:  # as a whole: no folder of an earlier run stays
        (df.hint("rebalance", *[F.col(c) for c in also]).write.mode("overwrite").partitionBy(*also)
           .parquet(os.path.join(path, f"{column}={int(batch_id)}")))
        return
    (df.withColumn(column, F.lit(int(batch_id)).cast("bigint"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(column).parquet(path))


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def replace_table(df: DataFrame, root: str, layer: str, table: str,
                  partition_by: list[str] | None = None) -> None:
    """``CREATE OR REPLACE TABLE`` (S10).  ``partition_by`` (e.g. a fact's
    date key) lays the table out in directories, so date predicates — and
    dynamic partition pruning from a filtered calendar join — skip files."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(table_path(root, layer, table))


def read_table(spark: SparkSession, root: str, layer: str, table: str,
               schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.parquet(table_path(root, layer, table))


def exists(spark: SparkSession, root: str, layer: str, table: str) -> bool:
    """False if nothing is stored there; any other storage error is raised."""
    try:
        spark.read.parquet(table_path(root, layer, table)).schema  # noqa: B018
        return True
    except AnalysisException as e:
        # an empty folder has no schema to infer
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def snapshot_path(root: str, table: str, version: int) -> str:
    return os.path.join(table_path(root, "consumption", table), f"v={int(version)}")


def write_snapshot(df: DataFrame, root: str, table: str, version: int) -> None:
    """Store dimension snapshot ``v=version`` in its own directory, so the
    write never targets the snapshot it was computed from."""
    df.write.mode("overwrite").parquet(snapshot_path(root, table, version))


def read_snapshot(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    return spark.read.parquet(snapshot_path(root, table, version))


def latest_version(spark: SparkSession, root: str, table: str) -> int | None:
    """Highest stored snapshot version (partition values only)."""
    if not exists(spark, root, "consumption", table):
        return None
    return read_table(spark, root, "consumption", table).agg(F.max("v")).first()[0]
