"""Versioned tables in hash buckets of their business key (dimensions).

The current rows of a table lie in ``n`` buckets (a power of two) by the hash
of the key, the closed ones in segments that are only ever added to::

    <root>/consumption/<table>/v=<token>/current/bucket=<b>/
    <root>/consumption/<table>/v=<token>/closed/

A version's manifest (``parts`` in the control table) names the token that
last wrote each bucket and the tokens with closed rows.  A merge reads and
writes the buckets that its keys fall into and shares the others with the
version before it.  A token is written once, so a replayed run never touches
files that a committed version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import store

#: Rows of a bucket; buckets are split once they hold four times as many on average.
BUCKET_ROWS = 200_000


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def power_of_two(rows: int, per_bucket: int) -> int:
    return 1 << max(0, -(-rows // per_bucket) - 1).bit_length()


def new_token(version: int) -> str:
    return f"{version}-{uuid.uuid4().hex[:12]}"


def written_buckets(spark: SparkSession, path: str) -> list[int]:
    """The buckets that have files under ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


@dataclass(frozen=True)
class Manifest:
    n: int
    schema: str
    current: list[str | None]                        # token of each bucket; None: it has no rows
    closed: list[str] = field(default_factory=list)
    rows: int = 0                                    # current rows
    links: int | None = None                         # version of the dimension that the rows' links are of


class Bucketed:
    """Reads and writes the files of one table."""

    def __init__(self, spark: SparkSession, root: str, table: str, key: str):
        self.spark, self.key = spark, key
        self.base = store.table_path(root, "consumption", table)

    def _read(self, m: Manifest, paths: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        """Current rows, of these buckets only if given."""
        return self._read(m, [f"{self.base}/v={t}/current/bucket={b}" for b, t in enumerate(m.current)
                              if t is not None and (buckets is None or b in set(buckets))])

    def closed(self, m: Manifest, after: int = -1) -> DataFrame:
        """Closed rows, of versions after ``after`` only."""
        return self._read(m, [f"{self.base}/v={t}/closed" for t in m.closed if int(t.split("-")[0]) > after])

    def rows(self, m: Manifest) -> DataFrame:
        return self.current(m).unionByName(self.closed(m))

    def touched(self, keys: DataFrame, n: int) -> list[int]:
        """The buckets of these keys: at most ``n`` numbers."""
        found = keys.select(bucket_of(self.key, n).alias("b")).distinct().collect()
        return sorted(r.b for r in found)

    def put(self, m: Manifest | None, version: int, n: int, current: DataFrame, buckets: list[int] | None,
            closed: DataFrame | None, rows: int, links: int | None) -> Manifest:
        """Replace ``buckets`` (all if None) by the rows of ``current`` and add
        the rows of ``closed``; returns the new manifest."""
        token = new_token(version)
        path = f"{self.base}/v={token}"
        # one file a bucket
        (current.withColumn("bucket", bucket_of(self.key, n)).repartition("bucket")
         .sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{path}/current"))
        has = set(written_buckets(self.spark, f"{path}/current"))
        tokens = list(m.current) if m is not None and buckets is not None else [None] * n
        for b in range(n) if buckets is None else buckets:
            tokens[b] = token if b in has else None
        segments = list(m.closed) if m is not None else []
        if closed is not None:
            closed.write.parquet(f"{path}/closed")
            segments.append(token)
        return Manifest(n, current.schema.json(), tokens, segments, rows, links)
