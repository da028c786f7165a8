"""Index of a fact's keys: business key → surrogate key, added to by every run.

Each run's rows are one segment, dealt into hash buckets of some 100,000 keys;
beside a bucket lie its smallest and largest key and a Bloom filter::

    <root>/consumption/keys_<fact>/v=<token>/rows/bucket=<b>/
    <root>/consumption/keys_<fact>/v=<token>/filter/bucket=<b>/

A look-up reads the filters of the buckets that its keys fall into, then the
rows of those buckets that may hold one of them.  New keys therefore cost
filters only (ten bits a stored key of their buckets), and known ones the
buckets they are in; the facts themselves are not read.  Segments of fewer
than ``FILTER_FROM`` keys have no filters, and a look-up of a quarter as many
keys as a segment holds doesn't ask them: their rows are read at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.keys import is_unique
from ..session import materialize
from . import store
from .buckets import bucket_of, new_token, power_of_two, written_buckets
from .control import Version

BUCKET_KEYS, FILTER_FROM = 100_000, 20_000
#: Bits a key and hash functions of a filter: about one in a hundred absent keys passes.
BITS, HASHES = 10, 7
ROWS = "key string, sk bigint"


def _places(h: np.ndarray, n_bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row a hash function."""
    h = h.view(np.uint64)
    step = (h * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)[:, None]
    # the low bits chose the bucket, so they are mixed before they choose a place
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed + k * step) >> np.uint64(64 - n_bits.bit_length() + 1)


def filter_bits(h: np.ndarray) -> bytes:
    n_bits = 1 << max(6, int(len(h) * BITS - 1).bit_length())
    bits = np.zeros(n_bits, bool)
    bits[_places(h, n_bits).reshape(-1)] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, h: np.ndarray) -> np.ndarray:
    flags = np.frombuffer(bits, np.uint8)
    at = _places(h, len(flags) * 8)
    return ((flags[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


@dataclass(frozen=True)
class Segment:
    version: int
    token: str
    n: int
    rows: int
    filtered: bool
    unique: bool = False  # no key comes twice


def segments(versions: list[Version]) -> list[Segment]:
    return [Segment(v.version, **v.parts) for v in versions if v.parts.get("rows")]


class KeyIndex:
    def __init__(self, spark: SparkSession, root: str, fact: str):
        self.spark = spark
        self.base = store.table_path(root, "consumption", f"keys_{fact}")

    def put(self, version: int, rows: DataFrame, count: int) -> dict:
        """Write (key, sk) rows as one segment; returns its ``parts``, with
        whether no key comes twice.  Null keys can't be looked up and aren't kept."""
        n = power_of_two(count, BUCKET_KEYS)
        token = new_token(version)
        path = f"{self.base}/v={token}"
        if count:
            (rows.where("key IS NOT NULL").withColumn("bucket", bucket_of("key", n)).repartition("bucket")
             .sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/rows"))

        if count >= FILTER_FROM:
            def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
                ends, h = pc.min_max(table.column("key")).as_py(), table.column("h").to_numpy()
                # only keys of the same hash can be the same
                twice = len(np.unique(h)) < len(h) and pc.count_distinct(table.column("key")).as_py() < len(h)
                return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "lo": pa.array([ends["min"]]),
                                 "hi": pa.array([ends["max"]]), "bits": pa.array([filter_bits(h)], pa.binary()),
                                 "twice": pa.array([twice])})

            stored = self.spark.read.schema(f"{ROWS}, bucket int").parquet(f"{path}/rows")
            (stored.select("bucket", "key", F.xxhash64("key").alias("h")).groupBy("bucket")
             .applyInArrow(build, "bucket int, lo string, hi string, bits binary, twice boolean")
             .write.partitionBy("bucket").parquet(f"{path}/filter"))
            # a key lies in one bucket, whose task has seen all its rows
            unique = (self.spark.read.schema("twice boolean").parquet(f"{path}/filter").where("twice").isEmpty()
                      if written_buckets(self.spark, f"{path}/filter") else True)
        else:
            unique = is_unique(rows, "key")
        return {"token": token, "n": n, "rows": count, "filtered": count >= FILTER_FROM, "unique": unique}

    def whole(self, most: int, among: list[Segment]) -> DataFrame | None:
        """(key, sk, version) of every key of ``among``, not written, if a
        look-up of up to ``most`` keys may as well read all of them; else None.
        Of the segments that hold a key the newest counts."""
        if any(s.filtered and 4 * most < s.rows for s in among):
            return None
        rows = self._read({s.version: None for s in among}, {s.version: s.token for s in among}, "rows", ROWS)
        if rows is None:
            return None
        rows = rows.select("key", "sk", "version")
        if len(among) == 1:
            return rows
        if not all(s.unique for s in among):
            return _newest(rows)
        return rows.groupBy("key").agg(F.max_by("sk", "version").alias("sk"), F.max("version").alias("version"))

    def find(self, keys: DataFrame, among: list[Segment]) -> DataFrame:
        """(key, sk, version) of the single column ``keys``, nulls left out; of
        the segments that hold a key the newest counts.  Written."""
        empty = self.spark.createDataFrame([], f"{ROWS}, version int")
        if not among:
            return empty
        asked = materialize(keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
                            .withColumn("h", F.xxhash64("key")), "asked-keys")
        n_asked = asked.count()
        tokens = {s.version: s.token for s in among}
        ask = [s for s in among if s.filtered and 4 * n_asked < s.rows]
        at_once = [s for s in among if s not in ask]
        found = self._read({s.version: None for s in at_once}, tokens, "rows", ROWS)
        if found is not None:
            found = found.join(asked.select("key"), "key", "left_semi").select("key", "sk", "version")
        if ask:
            hits = self._hits(asked, ask, tokens)
            rows = self._read(_by_version(hits), tokens, "rows", ROWS)
            if rows is not None:
                rows = (rows.join(hits.select("key", "version"), ["key", "version"], "left_semi")
                        .select("key", "sk", "version"))
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            return empty
        if len(among) > 1:
            found = _newest(found)
        return materialize(found, "found-keys")

    def _hits(self, asked: DataFrame, among: list[Segment], tokens: dict[int, str]) -> DataFrame:
        """(key, version, bucket) that the filters let through."""
        places = F.array(*[F.struct(F.lit(s.version).alias("version"),
                                    F.pmod(F.col("h"), F.lit(s.n)).cast("int").alias("bucket")) for s in among])
        asked = asked.select("key", "h", F.explode(places).alias("p")).select("key", "h", "p.version", "p.bucket")
        filters = self._read(_by_version(asked), tokens, "filter", "lo string, hi string, bits binary")
        schema = "key string, version int, bucket int"
        if filters is None:
            return self.spark.createDataFrame([], schema)

        def test(keys: pa.Table, found: pa.Table) -> pa.Table:
            keys = keys.select(["key", "version", "bucket", "h"])
            if not keys.num_rows or not found.num_rows:
                return keys.slice(0, 0).drop_columns(["h"])
            lo, hi, bits = (found.column(c)[0].as_py() for c in ("lo", "hi", "bits"))
            inside = np.array([lo <= k <= hi for k in keys.column("key").to_pylist()])
            return keys.filter(pa.array(inside & may_hold(bits, keys.column("h").to_numpy()))).drop_columns(["h"])

        return materialize(asked.groupBy("version", "bucket").cogroup(filters.groupBy("version", "bucket"))
                           .applyInArrow(test, schema), "index-hits")

    def _read(self, by_version: dict[int, list[int] | None], tokens: dict[int, str], what: str, schema: str
              ) -> DataFrame | None:
        """These buckets (None: all) of these versions, as stored."""
        out = None
        for version, wanted in sorted(by_version.items()):
            path = f"{self.base}/v={tokens[version]}/{what}"
            have = written_buckets(self.spark, path)
            paths = [f"{path}/bucket={b}" for b in have if wanted is None or b in set(wanted)]
            if paths:
                part = (self.spark.read.schema(f"{schema}, bucket int").option("basePath", path).parquet(*paths)
                        .withColumn("version", F.lit(version)))
                out = part if out is None else out.unionByName(part)
        return out


def _newest(found: DataFrame) -> DataFrame:
    newest = found.groupBy(F.col("key").alias("_k")).agg(F.max("version").alias("_v"))
    return found.join(newest, (F.col("key") == F.col("_k")) & (F.col("version") == F.col("_v"))).drop("_k", "_v")


def _by_version(pairs: DataFrame) -> dict[int, list[int]]:
    """version: its buckets among the rows, at most as many as are stored."""
    out: dict[int, list[int]] = {}
    for r in pairs.select("version", "bucket").distinct().collect():
        out.setdefault(r.version, []).append(r.bucket)
    return out
