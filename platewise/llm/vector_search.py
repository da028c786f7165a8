"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are normalised and rotated by a random orthogonal matrix, so that any
few of their dimensions are a fair sample of all.  They are dealt to the lists
of an inverted index; a query probes the nearest lists.  Within a list the
dimensions are read in blocks: after each block a hypothesis test compares
the scaled partial distance with the k-th best distance known so far and
abandons candidates that are too far with high confidence.  A query starts
with its k-th best distance among the sample that the lists were fitted on, so
most of its lists abandon all their candidates.  Survivors are scored on the
original vectors in double precision.

Equal vectors are indexed once with their smallest ids, and searched once, so
a vector that a third of all rows share is one row here.  Large lists are cut
into chunks and their queries into blocks, and each pair of these is searched
by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_dir

#: Bounds of the sample that the lists are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 64 << 20
MAX_LISTS = 1024
#: Vectors of a list, and queries, that one task compares at most (on average, as both are dealt by hash).
CHUNK, QUERY_CHUNK = 8192, 8192
#: Dimensions read between tests, and how many deviations a test allows.
BLOCK, DEVIATIONS = 16, 2.1
#: Rows and queries of a list that are compared at a time, and sample rows that give a query its first bound.
ROWS, QUERIES, BOUND_ROWS = 1024, 512, 4096
SEED = 11


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)  # against overflow of squares
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row by the same operations."""
    return (many * one).sum(axis=1) / (np.sqrt((many * many).sum(axis=1)) * np.sqrt((one * one).sum()))


def fit_lists(sample: np.ndarray, n_lists: int, rounds: int = 12) -> np.ndarray:
    """Centres by k-means on unit vectors."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _kth(q: np.ndarray, far: np.ndarray, k: int, known: np.ndarray) -> np.ndarray:
    """``known`` lowered to the k-th smallest of each query's distances."""
    order = np.lexsort((far, q))
    q, far = q[order], far[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    kth = first + k - 1
    has = (kth < len(q)) & (q[np.minimum(kth, len(q) - 1)] == q[first]) if len(q) else np.empty(0, bool)
    out = known.copy()
    out[q[first[has]]] = np.minimum(out[q[first[has]]], far[kth[has]])
    return out


def adaptive_scan(base: np.ndarray, queries: np.ndarray, k: int, far: np.ndarray | None = None
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the query's k nearest rows of
    ``base`` (all unit and rotated): the survivors of the tests.  ``far``: a
    squared distance beyond which a query wants nothing.

    While many pairs live a block is read for all of them at once, as a
    matrix product; later for the surviving pairs only.
    """
    n, dim = base.shape
    known = np.full(len(queries), np.inf) if far is None else far.copy()
    found: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    for lo in range(0, n, ROWS):
        x = base[lo:lo + ROWS]
        part, pairs = np.zeros((len(queries), len(x))), None
        for d in range(0, dim, BLOCK):
            seen = min(d + BLOCK, dim)
            slack = (1 + DEVIATIONS / np.sqrt(seen)) ** 2 if seen < dim else 1 + 1e-9
            limit = known * (seen / dim * slack) + 1e-12
            xb, qb = x[:, d:seen], queries[:, d:seen]
            if pairs is None:
                part += (xb * xb).sum(axis=1)[None] + (qb * qb).sum(axis=1)[:, None] - 2 * (qb @ xb.T)
                alive = part <= limit[:, None]
                if 4 * np.count_nonzero(alive) < alive.size or seen == dim:
                    pairs = np.nonzero(alive)
                    part = part[pairs]
            else:
                diff = xb[pairs[1]] - qb[pairs[0]]
                part = part + (diff * diff).sum(axis=1)
                alive = part <= limit[pairs[0]]
                pairs, part = (pairs[0][alive], pairs[1][alive]), part[alive]
        found = [np.concatenate(c) for c in zip(found, (pairs[0], pairs[1] + lo, part))]
        known = _kth(found[0], found[2], k, known)
        near = found[2] <= known[found[0]] * (1 + 1e-9) + 1e-12
        found = [c[near] for c in found]
    return found[0], found[1]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1) if data else np.empty((0, 1))


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v: double array) without null ids and without vectors that are
    null, empty, zero or hold null or non-finite components."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad)
                      & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id",
           vector_col: str = "embedding", probe_share: float = 0.6, min_probes: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others of every row whose
    id is divisible by ``every``, by cosine, ties to the smaller id.

    Invalid vectors (see ``valid_vectors``) take no part.  Vectors of different
    lengths have no cosine: each length is searched on its own.  Rows that
    repeat an id count once for each distinct vector, and never find their own
    id; an id with vectors of several lengths has neighbours in each.
    A query probes ``probe_share`` of the lists, at least ``min_probes``; the
    default suits vectors without clusters, whose neighbours lie in many lists.
    """
    spark = vectors.sparkSession
    scratch_dir(spark)
    rows = valid_vectors(vectors, id_col, vector_col)
    sizes = {r["dim"]: r["count"] for r in rows.groupBy(F.size("v").alias("dim")).count().collect()}  # a row a length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, n in sorted(sizes.items()):
        out = out.unionByName(_search_length(rows.where(F.size("v") == dim), dim, n, k, every, probe_share, min_probes))
    return out


def _search_length(rows: DataFrame, dim: int, n: int, k: int, every: int, probe_share: float, min_probes: int
                   ) -> DataFrame:
    """``search`` among ``n`` valid vectors of one length."""
    more = k + 1  # a query's own id may be among them

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch as one row with their smallest ids (map-side combine)."""
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
            mat = np.ascontiguousarray(flat.astype("<f8")).reshape(-1, dim)
            groups: dict[bytes, set] = {}
            for i, row in zip(b.column(0).to_pylist(), mat):
                groups.setdefault(row.tobytes(), set()).add(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(groups), pa.binary()),
                 pa.array([sorted(g)[:more] for g in groups.values()], pa.list_(pa.int64())),
                 pa.array([min((i for i in g if i % every == 0), default=None) for g in groups.values()], pa.int64())],
                names=["v", "ids", "asks"])

    distinct = (rows.mapInArrow(packed, "v binary, ids array<long>, asks long").groupBy("v").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, more).alias("ids"),
        F.min("asks").alias("asks")).checkpoint())

    limit = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(limit).collect()
    turn = rotation(dim)
    points = unit(np.frombuffer(b"".join(r["v"] for r in sample), "<f8").reshape(-1, dim))
    centres = fit_lists(points, int(max(1, min(MAX_LISTS, 2 * n ** 0.5, len(points) // 8))))
    probes = min(len(centres), max(min_probes, int(len(centres) * probe_share)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argmax(unit(_matrix(b.column(0))) @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns],
                                             names=["list", "v", "ids", "asks"])

    # rows of the table: a query finds no worse neighbours than the best of those in its lists
    bounds = points[:BOUND_ROWS]
    bound_list = np.argmax(bounds @ centres.T, axis=1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERIES):
                b = whole.slice(lo, QUERIES)
                q = unit(_matrix(b.column(0)))
                near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
                probed = np.zeros((len(q), len(centres)), bool)
                np.put_along_axis(probed, near, True, axis=1)
                far = np.full(len(q), np.inf)
                if len(bounds) >= more:
                    close = np.where(probed[:, bound_list], q @ bounds.T, -np.inf)
                    far = 2 - 2 * np.sort(close, axis=1)[:, -more] + 1e-9
                at = np.repeat(np.arange(b.num_rows), probes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32).ravel()), b.column(0).take(pa.array(at)),
                     b.column(1).take(pa.array(at)), pa.array(far[at])], names=["list", "q", "asks", "far"])

    indexed = distinct.mapInArrow(assign, "list int, v binary, ids array<long>, asks long").drop("asks")
    # one row for each list
    chunks = {r["list"]: -(-r["count"] // CHUNK) for r in indexed.groupBy("list").count().collect()}
    parts = F.array(*[F.lit(chunks.get(c, 1)) for c in range(len(centres))])[F.col("list")]
    blocks = max(1, -(-distinct.where("asks is not null").count() // QUERY_CHUNK))
    indexed = (indexed.withColumn("chunk", F.pmod(F.xxhash64("v"), parts).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (distinct.where("asks is not null").select("v", "asks")
             .mapInArrow(probe, "list int, q binary, asks long, far double")
             .withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1))))

    def scan(base: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if base.num_rows and queries.num_rows:
            mat, qs = _matrix(base.column("v")), _matrix(queries.column("q"))
            ids = base.column("ids").to_pylist()
            turned, turned_q = unit(mat) @ turn, unit(qs) @ turn
            asks, far = queries.column("asks").to_pylist(), queries.column("far").to_numpy()
            for lo in range(0, len(qs), QUERIES):
                q_at, row = adaptive_scan(turned, turned_q[lo:lo + QUERIES], more, far[lo:lo + QUERIES])
                order = np.argsort(q_at, kind="stable")
                q_at, row = q_at[order] + lo, row[order]
                for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(q_at)) + 1):
                    if not len(part):
                        continue
                    q = int(q_at[part[0]])
                    got = sorted((-s, i) for s, r in zip(cosine(mat[row[part]], qs[q]).tolist(), row[part].tolist())
                                 for i in ids[r])
                    out += [(asks[q], i, -s) for s, i in got[:more]]
        cols = list(zip(*out)) or [()] * 3
        return pa.table({"asks": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    found = (indexed.groupBy("list", "chunk", "block").cogroup(asked.groupBy("list", "chunk", "block"))
             .applyInArrow(scan, "asks long, vec_id long, score double"))
    # at most (k + 1) * probes * chunks rows for each distinct query vector
    near = found.groupBy("asks").agg(F.slice(F.array_distinct(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("far"), "vec_id")))), 1, more).alias("near"))
    queries = (rows.where(F.col("vec_id") % every == 0).distinct()
               .mapInArrow(_bytes_of(dim), "query_id long, q binary"))
    asks_of = distinct.where("asks is not null").select(F.col("v").alias("q"), "asks")
    named = queries.join(asks_of, "q").join(near, "asks").select("query_id", "asks", "near")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (named.select("query_id", F.posexplode(others).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    (-F.col("x.far")).alias("score")))


def _bytes_of(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mat = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0, "<f8")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in mat.reshape(-1, dim)], pa.binary())],
                names=["query_id", "q"])
    return run
