"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

# Settings the library expects; the cluster may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
    # Dimension lookups are projected to (business key, surrogate key) before
    # the join; below this estimated size (planner statistics, re-checked by
    # AQE at runtime) they are broadcast instead of reshuffling the fact.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def build_session(master: str | None = None, app: str = "platewise",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables: the session's
    ``spark.checkpoint.dir``.

    Where it is unset a folder of our own is used on one machine (tests,
    laptops).  On a cluster that is an error: a local folder is seen by one
    machine only and does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        d = tempfile.mkdtemp(prefix="platewise-ckpt-")
    sc.setCheckpointDir(d)
    # setCheckpointDir adds a per-application sub-folder; report that one.
    return sc.getCheckpointDir() or d


_scopes = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder (safe when
    several driver threads build plans at once)."""
    base = scratch_dir(spark)
    path = os.path.join(base, "work", f"{name}-{uuid.uuid4().hex}")
    for paths in getattr(_scopes, "open", [])[-1:]:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes, at its end, the scratch tables that its thread made inside;
    whatever is to last must be written elsewhere by then."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    paths: list[str] = []
    _scopes.open.append(paths)
    try:
        yield
    finally:
        _scopes.open.remove(paths)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def materialize(df, name: str = "table"):
    """Write ``df`` as a Parquet table in the shared scratch folder and read
    it back: the lineage is cut and every later query reads the stored
    columns (a reliable copy, never a local checkpoint)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
