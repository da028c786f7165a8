"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints within ``max_distance`` differing bits are linked; every document
gets the smallest document id that it can reach over links.

Method.  Documents are first reduced to distinct fingerprints, so that a group
of copies is one row whatever its size.  The 64 bits are cut into
``max_distance + 2`` blocks; two fingerprints within the distance agree on at
least two whole blocks.  For each choice of two blocks the fingerprints are
dealt into cells by these blocks' bits, sorted by Gray rank (the chosen blocks
first), which puts fingerprints that share bits side by side, and indexed:
each node holds the bits that its rows share beyond those its parent holds
(mask and pattern).  A search adds up the differing bits on its way down and
drops a node, with all rows below it, as soon as the sum exceeds the distance
or a bit of the chosen blocks differs (another choice finds such a pair), or
when the rows below are already in the query's group.  Rows that agree on
their chosen blocks with more than ``CHUNK`` others are cut into chunks by
hash, and each pair of chunks is a cell of its own, so that a hot pattern
spreads over many tasks; a cell emits a spanning forest of its links, not its
pairs.  The forest edges are joined to components by alternating
large-star/small-star steps, each checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_dir
from .text import utf8

BITS = 64
#: Rows of a cell on average, and rows with the same chosen blocks that are indexed together at most
#: (on average, as both are dealt by hash).
CELL, CHUNK = 2048, 4096
#: Rows under a leaf node, and nodes under an upper node.
FAN_OUT = 16
#: Queries that descend the index together; bounds the search's memory.
QUERY_BLOCK = 256


# ------------------------------------------------------------ fingerprints --

def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """SimHash of a text: words lower-cased in A-Z, word shingles with their
    repeats hashed by XXH64; a bit is set if it is set in over half of the
    hashes.  Fewer words than a shingle: the whole sequence is the one
    shingle.  Null or no words: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - lengths)[:n].tolist(), ends[-n:].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text is unpacked in parts
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, *more: str) -> DataFrame:
    """(doc_id long, fp long) and the columns ``more``, of type long, for every
    row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in utf8(b.column(1))),
                             np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]],
                                             names=["doc_id", "fp", *more])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
            .mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more))))


# ---------------------------------------------------- hierarchical index ----

def gray_rank(v: np.ndarray) -> np.ndarray:
    """Position of each value in the binary reflected Gray sequence."""
    rank = v.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _join_groups(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of rows a[i] and b[i]; a group is labelled by its
    first row, and ``labels`` points straight at it."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


class GrayIndex:
    """Hierarchical index of the sorted fingerprints ``v``.

    ``levels[0]`` are the top nodes.  A level is (first row of each node, own
    mask, pattern): the mask has the bits that all rows of the node share and
    its parent's rows do not.  The last level has the rows themselves.
    """

    def __init__(self, v: np.ndarray):
        self.n, self.visited = len(v), 0
        stacked, shared_above = [], None
        width = FAN_OUT
        while width < self.n:
            stacked.append(np.arange(0, self.n, width))
            width *= FAN_OUT
        stacked.append(np.zeros(1, np.int64))
        self.levels = []
        for first in [*reversed(stacked), np.arange(self.n)]:
            every, some = np.bitwise_and.reduceat(v, first), np.bitwise_or.reduceat(v, first)
            shared = ~(every ^ some)
            own = shared if shared_above is None else shared & ~np.repeat(
                shared_above, np.diff(np.append(np.arange(0, len(first), FAN_OUT), len(first))))
            self.levels.append((first, own, every & own))
            shared_above = shared

    def link(self, v: np.ndarray, side: np.ndarray | None, distance: int, must: int = 0) -> np.ndarray:
        """Group label of each row: rows within ``distance`` that agree on the
        bits ``must`` are linked; with ``side``, only rows of different sides
        need to be compared.  ``visited`` counts the nodes looked at."""
        agree = np.uint64(must)
        labels = np.arange(self.n)
        for at in range(0, self.n, QUERY_BLOCK):
            q = np.arange(at, min(at + QUERY_BLOCK, self.n))
            node, acc = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for depth, (first, mask, pattern) in enumerate(self.levels):
                if depth:  # to the children
                    lo, hi = node * FAN_OUT, np.minimum((node + 1) * FAN_OUT, len(first))
                    width = hi - lo
                    q, acc = np.repeat(q, width), np.repeat(acc, width)
                    node = np.arange(len(q)) - np.repeat(np.cumsum(width) - width - lo, width)
                self.visited += len(q)
                differ = (v[q] ^ pattern[node]) & mask[node]
                acc = acc + np.bitwise_count(differ)
                last = np.append(first[1:], self.n) - 1
                low, high = (np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first))
                # later rows only, near enough, and not all in the query's group
                keep = (acc <= distance) & (differ & agree == 0) & (last[node] > q) & ~(
                    (low == high)[node] & (low[node] == labels[q]))
                q, node, acc = q[keep], node[keep], acc[keep]
                if not len(q):
                    break
            if side is not None and len(q):
                other = side[q] != side[node]
                q, node = q[other], node[other]
            if len(q):
                _join_groups(labels, q, node)
        return labels


def choices(distance: int) -> list[int]:
    """The bits of every two of ``distance + 2`` blocks."""
    blocks = distance + 2
    at = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for k in pair for b in range(at[k], at[k + 1])) for pair in combinations(range(blocks), 2)]


def gray_order(fp: np.ndarray, must: int) -> np.ndarray:
    """Rows by Gray rank, the bits ``must`` before the others."""
    return np.lexsort((gray_rank(fp & ~np.uint64(must)), gray_rank(fp & np.uint64(must))))


def cell_links(cell: np.ndarray, must: np.ndarray, fp: np.ndarray, rep: np.ndarray, side: np.ndarray,
               cross: np.ndarray, distance: int) -> tuple[list, list]:
    """Links of whole cells, found by descending each one's index; rows of one
    cell are adjacent."""
    out_u, out_v = [], []
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else cell
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
        bits = int(must[at])
        order = gray_order(fp[at:end], bits) + at
        v = fp[order]
        labels = GrayIndex(v).link(v, side[order] if cross[at] else None, distance, bits)
        moved = np.flatnonzero(labels != np.arange(len(v)))
        out_u.append(rep[order[moved]])
        out_v.append(rep[order[labels[moved]]])
    return out_u, out_v


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) between the ``rep`` ids of ``nodes`` (fp, rep), enough to
    connect whatever is linked within ``distance``."""
    if not 1 <= distance <= BITS - 2:
        raise ValueError("the distance must be between 1 and 62 bits")
    masks = choices(distance)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = nodes.select("fp", "rep", F.explode(F.array(*[
        F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
        for c, m in enumerate(signed)])).alias("k")).select("fp", "rep", "k.choice", "k.bits")
    n_cells = max(1, -(-nodes.count() // CELL))
    # patterns that many rows have: at most one for CHUNK rows of a choice
    hot = (keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
           .select(F.col("choice").alias("c"), F.col("bits").alias("b"),
                   F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    cut = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = (keyed.join(hot, (F.col("choice") == F.col("c")) & (F.col("bits") == F.col("b")), "left")
             .withColumn("cell", F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("bits"), F.lit(n_cells)))
                         .otherwise(F.col("bits")))
             .withColumn("hot", F.col("chunks").isNotNull().cast("int"))
             .withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("side", cut)
             .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
             .withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
             .select("choice", "hot", "cell", "lo", "hi", "side", "fp", "rep"))
    key = ["choice", "hot", "cell", "lo", "hi"]
    bits_of = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(cols):
            change = np.zeros(len(cols[0]), bool)
            for c in cols[:5]:
                change[1:] |= c[1:] != c[:-1]
            u, v = cell_links(np.cumsum(change), bits_of[cols[0]], cols[6].view(np.uint64), cols[7], cols[5],
                              cols[3] != cols[4], distance)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*x, np.empty(0, np.int64)])) for x in (u, v)],
                names=["u", "v"])

        held = None  # rows of a cell that the next batch may go on with
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.ones(len(cols[0]), bool)
            for c in cols[:5]:
                last &= c == c[-1]
            done = int(np.argmax(last))
            held = [c[done:] for c in cols]
            if done:
                yield made([c[:done] for c in cols])
        if held:
            yield made(held)

    return (cells.repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(run, "u long, v long"))


# -------------------------------------------------------------- components --

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (u, v): root is
    the smallest node of its component.  Large-star and small-star steps
    until the edges no longer change; the edges never leave the cluster."""
    def canonical(e):
        return (e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct())

    def state(e):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    scratch_dir(edges.sparkSession)
    e = canonical(edges).checkpoint()
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = canonical(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        e = canonical(small).checkpoint()
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_ids(nodes: DataFrame, max_distance: int) -> DataFrame:
    """(fp, component_id) of ``nodes`` (fp, rep): the smallest ``rep`` that
    each fingerprint reaches over links."""
    roots = components(links(nodes, max_distance))
    return (nodes.join(roots, nodes.rep == roots.node, "left")
            .select("fp", F.coalesce("root", "rep").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Null or empty texts have fingerprint zero and are linked like any other.
    Rows that repeat a doc_id are one document for linking.  A null doc_id
    links nothing; its row gets the component of its fingerprint, or null if
    no document with an id has that fingerprint.  Other columns of ``docs``
    play no part, whatever their names.
    """
    scratch_dir(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = component_ids(nodes.checkpoint(), max_distance)
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")
