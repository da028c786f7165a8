"""Repeated passages: every word that lies in a window of ``window`` words
which an earlier document (smaller id) also has is removed.

Documents are dealt into blocks by hash.  A block computes the Rabin-Karp hash
of every window, keeps the smallest document id of each hash (the map-side
combine: a window that a third of all documents share is one entry for each
block) and sends the sorted entries, packed, to the hash's bucket.  A bucket
finds each hash's smallest document over all blocks and answers a block only
where that is smaller than the block's own.  The block then marks the windows
whose smallest document is smaller than their own, merges them into maximal
intervals and cuts these out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .text import utf8

# Fixed value: the base of the polynomial hash (odd, 64 bits).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text of a block, and of the windows of a bucket, on average.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
NO_DOC = np.iinfo(np.int64).max


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2 ** 64, over 64-bit word hashes) of each window."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * BASE + w[k:k + n]
    return h


def _squeeze(*columns: np.ndarray) -> bytes:
    """64-bit columns, byte by byte, compressed: high bytes that hardly vary
    take no room."""
    planes = b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _stretch(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.stack([np.ascontiguousarray(c.T).reshape(-1).view(np.uint64)
                     for c in planes.reshape(columns, 8, -1)])


def _pack(h: np.ndarray, doc: np.ndarray) -> bytes:
    """Sorted hashes as differences, and their document ids."""
    return _squeeze(np.diff(h, prepend=np.uint64(0)), doc.view(np.uint64))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    d, doc = _stretch(data, 2)
    return np.cumsum(d, dtype=np.uint64), doc.view(np.int64)


def _smallest(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with the smallest document of each."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return h[first], np.minimum.reduceat(doc, first) if len(h) else doc


class Block:
    """The windows of a block's documents.  A null id is no smaller than any
    other and no other is smaller than it."""

    def __init__(self, docs: pa.Table, window: int):
        self.ids = docs.column("doc_id").combine_chunks()
        self.words = [(t or b"").split() for chunk in docs.column("text").chunks for t in utf8(chunk)]
        self.hashes = [window_hashes(w, window) for w in self.words]
        known = [d.as_py() for d in self.ids]
        own = [np.full(len(h), NO_DOC if d is None else d, np.int64) for h, d in zip(self.hashes, known)]
        self.h, self.smallest = _smallest(np.concatenate([np.empty(0, np.uint64), *self.hashes]),
                                          np.concatenate([np.empty(0, np.int64), *own]))
        self.known = known


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, doc_id, text), and the number of hash buckets for their windows."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("decimal(38,0)"))).first()[0] or 0
    n_blocks = max(1, -(-int(size) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))), F.lit(n_blocks))
    dealt = docs.select(block.alias("block"), F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).alias("text"))
    return dealt, max(1, -(-int(size) // BUCKET_BYTES))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined
    by single spaces) and spans (removed intervals of word positions, end
    excluded).

    Windows are judged on the input.  Null and empty texts have no words and
    keep an empty text.  Rows that repeat a doc_id don't remove each other.
    A row without an id removes nothing and nothing is removed from it.
    Windows are told apart by 64-bit hashes.
    """
    dealt, n_buckets = blocks_of(docs, id_col, text_col)
    width = min((1 << 64) // n_buckets + 1, (1 << 64) - 1)

    def windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Block(table, window)
        known = b.smallest != NO_DOC
        h, doc = b.h[known], b.smallest[known]
        # the buckets that the block has windows for; h is sorted
        which, first = np.unique(h // np.uint64(width), return_index=True)
        rows = list(zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(h)]))
        return pa.table({"bucket": pa.array([k for k, *_ in rows], pa.int64()),
                         "sender": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "data": pa.array([_pack(h[lo:hi], doc[lo:hi]) for _, lo, hi in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        senders = table.column("sender").to_pylist()
        parts = [_unpack(x) for x in table.column("data").to_pylist()]
        h = np.concatenate([p[0] for p in parts])
        doc = np.concatenate([p[1] for p in parts])
        sender = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(h, kind="stable")
        h, doc, sender = h[order], doc[order], sender[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(h))))
        late = least < doc
        h, least, sender = h[late], least[late], sender[late]
        order = np.argsort(sender, kind="stable")  # hashes stay sorted for each sender
        h, least, sender = h[order], least[order], sender[order]
        bounds = np.searchsorted(sender, np.arange(len(parts) + 1)).tolist()
        rows = [(s, lo, hi) for s, lo, hi in zip(senders, bounds, bounds[1:]) if lo < hi]
        return pa.table({"block": pa.array([s for s, *_ in rows], pa.int64()),
                         "data": pa.array([_pack(h[lo:hi], least[lo:hi]) for _, lo, hi in rows], pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table, window)
        for data in answers.column("data").to_pylist():
            h, doc = _unpack(data)
            b.smallest[np.searchsorted(b.h, h)] = doc
        kept, removed, spans = [], [], []
        for d, words, hashes in zip(b.known, b.words, b.hashes):
            own = np.iinfo(np.int64).min if d is None else d
            hit = np.flatnonzero(b.smallest[np.searchsorted(b.h, hashes)] < own)
            if not len(hit):
                kept.append(b" ".join(words))
                removed.append(0)
                spans.append([])
                continue
            # windows that overlap or touch merge into one interval
            new = np.append(True, hit[1:] > hit[:-1] + window)
            lo = hit[new]
            hi = np.append(hit[:-1][new[1:]], hit[-1]) + window
            parts, at = [], 0
            for s, e in zip(lo.tolist(), hi.tolist()):
                parts += words[at:s]
                at = e
            kept.append(b" ".join(parts + words[at:]))
            removed.append(int((hi - lo).sum()))
            spans.append([{"start": s, "end": e} for s, e in zip(lo.tolist(), hi.tolist())])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": b.ids, "n_words": pa.array(list(map(len, b.words)), pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                         "spans": pa.array(spans, span)})

    sent = dealt.groupBy("block").applyInArrow(windows, "bucket long, sender long, data binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "block long, data binary")
    return (dealt.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, "
                               "spans array<struct<start:long,end:long>>"))
