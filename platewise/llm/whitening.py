"""Embedding whitening: the leading principal components of integer vectors,
found by FEAST, and every vector's coordinates along them in unit variance.

Spark does what grows with the table: distinct vectors, their sums, the
covariance of the centred vectors (added up inside each task, then row by row
of the matrix over tasks), the coordinates and their own covariance.  What is
left is one matrix of d x d numbers for each vector length d.  Its leading
eigenvalues are separated by inertia counts (Sylvester: the signs of a
factorisation of V - s count the eigenvalues above s; V is brought to
tridiagonal form once so that a count costs d steps).  Each separated interval
is a contour: Spark tasks solve the complex shifted systems (z - V) X = Y, one
quadrature node each; their weighted sum projects Y onto the interval's
eigenvectors, Rayleigh-Ritz extracts them, and the process is repeated from
them until the residuals are as small as double precision allows.  The number
found is held against the inertia counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize

#: Quadrature nodes on the upper half of a contour (the lower half mirrors it).
NODES = 8
#: Vectors searched beside those that an interval holds; rounds of refinement.
SPARE, ROUNDS = 8, 40
LONG = np.iinfo(np.int64)


class Incomplete(ArithmeticError):
    """The components found aren't as many as the inertia counts say."""


# ------------------------------------------------------------- the fit list --
def integer_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, d, x): x = floor(256 c) of vectors without null or non-finite
    entries; entries beyond 64 bits count as the largest or smallest integer."""
    c = F.col(vector_col)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))

    def entry(v: Column) -> Column:
        y = F.floor(v.cast("double") * 256)  # a long by Spark's own clamping, checked below
        big = F.abs(v.cast("double")) >= float(2 ** 55)
        return F.when(big, F.when(v > 0, F.lit(LONG.max)).otherwise(F.lit(LONG.min))).otherwise(y)

    return (table.where(c.isNotNull() & finite).select(F.col(id_col).alias("id"), F.size(vector_col).alias("d"),
                                                       F.transform(c, entry).alias("x")))


def _matrix(batch: pa.RecordBatch | pa.Table, d: int) -> np.ndarray:
    column = batch.column("x")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    d = batch.column("d").to_numpy()
    for length in np.unique(d).tolist():
        yield length, batch if (d == length).all() else batch.filter(pa.array(d == length))


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """length: (n, exact sum of each dimension)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for d, part in _by_length(batch):
                x = _matrix(part, d)
                one = sums.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                one[0] += len(x)  # high and low halves: no sum overflows
                one[1] += (x >> 32).sum(axis=0)
                one[2] += (x & 0xFFFFFFFF).sum(axis=0)
        rows = [(d, -1, n, 0) for d, (n, _, _) in sums.items()]
        rows += [(d, i, int(h), int(low)) for d, (_, hi, lo) in sums.items() for i, (h, low) in enumerate(zip(hi, lo))]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                              names=["d", "i", "hi", "lo"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo")]
    out: dict[int, tuple[int, list[int]]] = {}
    found = fit.mapInArrow(add, "d long, i long, hi long, lo long").groupBy("d", "i").agg(*wide).collect()
    for r in sorted(found, key=lambda r: (r.d, r.i)):  # one row a dimension
        if r.i < 0:
            out[r.d] = (int(r.hi), [])
        else:
            out[r.d][1].append((int(r.hi) << 32) + int(r.lo))
    return out


def covariances(vectors: DataFrame, centred: Callable[[int, np.ndarray], np.ndarray],
                counts: dict[int, int]) -> dict[int, np.ndarray]:
    """length: covariance (divisor n) of ``centred(length, x)``.  Products are
    added up in each task; a matrix row of all tasks meets in one group."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in _by_length(batch):
                x = _matrix(part, d)
                for lo in range(0, len(x), 4096):
                    y = centred(d, x[lo:lo + 4096])
                    sums[d] = sums.get(d, 0) + y.T @ y
        for d, total in sums.items():
            yield pa.record_batch([pa.array([d] * len(total), pa.int64()), pa.array(range(len(total)), pa.int64()),
                                   pa.array([r.tobytes() for r in total], pa.binary())], names=["d", "i", "row"])

    def join(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(r, np.float64) for r in rows.column("row").to_pylist()], axis=0)
        return rows.slice(0, 1).set_column(2, "row", pa.array([total.tobytes()], pa.binary()))

    schema = "d long, i long, row binary"
    found: dict[int, list] = {}
    for r in vectors.mapInArrow(add, schema).groupBy("d", "i").applyInArrow(join, schema).collect():
        found.setdefault(r.d, []).append((r.i, np.frombuffer(r.row, np.float64)))
    out = {}
    for d, rows in found.items():  # d rows of d numbers
        m = np.stack([row for _, row in sorted(rows, key=lambda r: r[0])]) / counts[d]
        out[d] = (m + m.T) / 2
    return out


# ------------------------------------------------------------------- FEAST --
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with v's eigenvalues
    (Householder reflections from both sides)."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        u = a[k + 1:, k].copy()
        size = np.linalg.norm(u)
        if size == 0:
            continue
        u[0] += size if u[0] >= 0 else -size
        u /= np.linalg.norm(u)
        a[k + 1:, k:] -= 2 * np.outer(u, u @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """Counts of eigenvalues above a shift."""

    def __init__(self, v: np.ndarray):
        self.diagonal, off = tridiagonal(v)
        self.squares = np.concatenate([[0.0], off ** 2]).tolist()
        self.scale = float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
        self.tiny = max(np.finfo(float).eps ** 2 * self.scale, 1e-290)

    def above(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for a, b in zip((self.diagonal - shift).tolist(), self.squares):
            pivot = a - b / pivot
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count

    def eigenvalue(self, number: int, width: float) -> float:
        """The number-th largest (from 1), within ``width``."""
        low, high = -self.scale, self.scale
        while high - low > width:
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (middle, high) if self.above(middle) >= number else (low, middle)
        return (low + high) / 2


def intervals(inertia: Inertia, wanted: int, size: int) -> list[tuple[float, float, int]]:
    """(centre, radius, how many) of contours that hold the ``wanted`` largest
    of ``size`` eigenvalues, each with no other eigenvalue near.  Eigenvalues
    too close to be told apart share a contour, with all that are close."""
    noise = 64 * np.finfo(float).eps * inertia.scale
    values = [inertia.eigenvalue(k, noise) for k in range(1, min(wanted + 1, size) + 1)]
    apart = max(1e-9 * inertia.scale, 8 * noise)
    while len(values) < size and values[-2] - values[-1] <= apart:
        values.append(inertia.eigenvalue(len(values) + 1, noise))  # the last wanted one has a twin
    groups: list[list[float]] = []
    for k, value in enumerate(values):
        if groups and groups[-1][-1] - value <= apart:
            groups[-1].append(value)
        elif k < wanted:
            groups.append([value])
        else:
            break
    out = []
    for i, g in enumerate(groups):
        nearest = [groups[i - 1][-1] - g[0]] if i else []
        below = values[sum(map(len, groups[:i + 1])):][:1]
        nearest += [g[-1] - below[0]] if below else []
        room = min(nearest, default=max(inertia.scale, 1e-300))
        out.append(((g[0] + g[-1]) / 2, (g[0] - g[-1]) / 2 + room / 2, len(g)))
    return out


def projected(spark: SparkSession, v: np.ndarray, blocks: list[tuple[float, float, np.ndarray]]) -> list[np.ndarray]:
    """Each block (centre, radius, Y) projected onto the eigenvectors inside
    its contour: Gauss-Legendre quadrature of (z - V)^-1 Y on the circle, one
    Spark task a node."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (points + 1)
    held = spark.sparkContext.broadcast((v, blocks))  # d x d, and d x few a contour

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, blocks = held.value
        for batch in batches:
            out = []
            for job in batch.column("id").to_pylist():
                (centre, radius, y), node = blocks[job // NODES], job % NODES
                turn = np.exp(1j * angles[node])
                x = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, y.astype(complex))
                out.append((weights[node] / 2 * radius * (turn * x).real).tobytes())
            yield pa.record_batch([pa.array(batch.column("id")), pa.array(out, pa.binary())], names=["id", "part"])

    n = len(blocks) * NODES
    parts = spark.range(0, n, 1, n).mapInArrow(solve, "id long, part binary").collect()
    held.unpersist()
    sums = [np.zeros_like(y) for *_, y in blocks]
    for r in sorted(parts, key=lambda r: r.id):
        sums[r.id // NODES] += np.frombuffer(r.part).reshape(sums[r.id // NODES].shape)
    return sums


def rayleigh_ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of v within the block's span, by falling value."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    q = u[:, s > s[0] * 1e-14] if len(s) and s[0] > 0 else u[:, :0]
    values, turn = np.linalg.eigh(q.T @ v @ q)
    return values[::-1], (q @ turn)[:, ::-1]


def leading(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of v, falling, and their unit
    eigenvectors as columns; fewer if v has fewer that aren't zero."""
    d = len(v)
    inertia = Inertia(v)
    wanted = min(wanted, inertia.above(d * np.finfo(float).eps * inertia.scale))
    if not wanted:
        return np.empty(0), np.empty((d, 0))
    found = intervals(inertia, wanted, d)
    rng = np.random.default_rng(0)
    blocks = [rng.standard_normal((d, min(d, n + SPARE))) for *_, n in found]
    best: list[tuple[float, np.ndarray, np.ndarray] | None] = [None] * len(found)
    for _ in range(ROUNDS):
        todo = [i for i, b in enumerate(best) if b is None or b[0] > 4 * np.finfo(float).eps * inertia.scale]
        images = projected(spark, v, [(*found[i][:2], blocks[i]) for i in todo])
        moved = False
        for i, image in zip(todo, images):
            centre, radius, n = found[i]
            values, vectors = rayleigh_ritz(v, image)
            blocks[i] = vectors
            inside = np.abs(values - centre) <= radius
            if inside.sum() != n:
                moved = True  # spurious or missing so far
                continue
            values, vectors = values[inside], vectors[:, inside]
            residual = float(np.linalg.norm(v @ vectors - vectors * values, axis=0).max())
            if best[i] is None or residual < best[i][0] / 2:
                moved = True
            if best[i] is None or residual < best[i][0]:
                best[i] = (residual, values, vectors)
        if not moved:
            break  # rounding is all that is left
    counted = sum(n for *_, n in found)
    if any(b is None for b in best) or inertia.above(found[-1][0] - found[-1][1]) != counted:
        raise Incomplete(f"{counted} components counted, {sum(len(b[1]) for b in best if b)} found")
    values, vectors = rayleigh_ritz(v, np.hstack([b[2] for b in best]))  # orthogonal across contours
    return values[:wanted], vectors[:, :wanted]


# --------------------------------------------------------------- whitening --
def _exact(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)²; null beyond 64 bits."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if x.shape[1] * (n * most + max(map(abs, sums), default=0)) ** 2 <= LONG.max:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    whole = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(x), object)
    return [int(s) if s <= LONG.max else None for s in whole]


def whiten(table: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row with a usable vector and component: id, component (from 1),
    n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    The statistics are over each distinct integer vector once, so copies count
    once; every row gets its coordinates.  Vectors of different lengths are
    whitened apart, each length with its own n, sums and components.
    Components without variance can't have unit variance and are left out (as
    are all of a length with one distinct vector, or of length zero).
    ``deviation`` is null where it doesn't fit a long.  Rows that repeat an id,
    or have none, stay rows.  An empty table gives no rows.
    """
    spark = table.sparkSession
    vectors = integer_vectors(table, id_col, vector_col).where("d > 0")
    # equal vectors fall together in each task before they are shuffled
    fit = materialize(vectors.select("d", "x").distinct(), "whitening-fit")
    sums = totals(fit)
    counts = {d: n for d, (n, _) in sums.items()}
    means = {d: np.array([s / n for s in total]) for d, (n, total) in sums.items()}
    variance = covariances(fit, lambda d, x: x - means[d], counts)
    basis, explained = {}, {}
    for d, v in variance.items():
        values, columns = leading(spark, v, components)
        if len(values):
            basis[d] = columns / np.sqrt(values)
            explained[d] = (values / np.trace(v)).tolist()
    unit = covariances(fit, lambda d, x: (x - means[d]) @ basis[d] if d in basis else np.empty((len(x), 0)), counts)
    error = {d: float(np.abs(unit[d] - np.eye(len(unit[d]))).max()) for d in basis}
    columns = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_length(batch):
                if d not in basis:
                    continue
                x, m, (n, total) = _matrix(part, d), basis[d].shape[1], sums[d]
                row = pa.array(np.repeat(np.arange(len(x)), m))
                yield pa.record_batch([
                    part.column("id").take(row), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(row), n)), pa.array(_exact(x, n, total), pa.int64()).take(row),
                    pa.array(((x - means[d]) @ basis[d]).reshape(-1)), pa.array(np.tile(explained[d], len(x))),
                    pa.array(np.full(len(row), error[d]))], names=columns)

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(coordinates, f"id {kind}, component int, n long, deviation long, whitened double, "
                                           "explained double, identity_error double")
