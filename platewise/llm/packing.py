"""Harmonic packing of token sequences.

A document is cut into full sequences; its rest, of r ids, is of class k, the
reciprocal with capacity / (k + 1) < r <= capacity / k (the last class takes
all shorter ones).  A bin of class k takes exactly k rests, whole.  The room
that they leave is filled by a long document that comes later, which is cut
for it: so few documents are in pieces, pieces are long, and no sequence needs
padding.  Each task fills its own bins as rows stream by and needs no word
from others; what it holds is bounded by the classes and by ``WAITING`` bins
that lack their filling.  At its end the rests of unfinished bins are laid out
one after the other, and the last sequence is closed at powers of two.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: The last class, bins that wait for their filling, and the shortest piece that filling cuts if it can.
CLASSES, WAITING, SHORT = 32, 64, 64

#: Texts of these characters only are cut into pre-tokens alike by both
#: libraries: white space of ASCII, printable ASCII and Latin letters.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ſ]").search


class Encoder:
    """Token ids of ``tokenizers`` for a byte-level BPE file.

    Plain texts are encoded from the same vocabulary by ``tiktoken``, which
    gives the same ids several times faster; all other texts, and those that
    spell a special token, by ``tokenizers`` itself.
    """

    def __init__(self, tokenizer_json: bytes):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(tokenizer_json.decode())
        spec = json.loads(tokenizer_json)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        # byte-level vocabularies write each byte as a printable character
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()
                 if piece not in self.special}
        # Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if _PLAIN(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")


class Packer:
    """The bins of one task; closed sequences' pieces go to ``out`` as
    (document, start, length, ids, document's ids in all, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.out: list[tuple] = []
        self.open: dict[int, list[tuple]] = {}  # class: rests of its unfinished bin
        self.waiting: deque[tuple[list[tuple], int]] = deque()  # finished bins and their room

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.out.append((*p, self.sequence, offset))
            offset += p[2]
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0

        def piece(size: int) -> tuple:
            nonlocal at
            at += size
            return doc, at - size, size, ids[at - size:at].tobytes(), n

        # long documents fill the bins that wait; any does once too many wait
        if 2 * n > self.capacity or len(self.waiting) > WAITING:
            for _ in range(len(self.waiting)):
                pieces, room = self.waiting.popleft()
                if at == n or 0 < n - at - room < SHORT and len(self.waiting) < WAITING:
                    self.waiting.append((pieces, room))  # for another document
                    continue
                size = min(room, n - at)
                pieces.append(piece(size))
                if size < room:
                    self.waiting.appendleft((pieces, room - size))
                    break
                self._close(pieces)
        while n - at >= self.capacity:
            self._close([piece(self.capacity)])
        if at < n:
            self._add_rest(piece(n - at))

    def _add_rest(self, rest: tuple) -> None:
        k = min(self.capacity // rest[2], CLASSES)
        bin_ = self.open.setdefault(k, [])
        bin_.append(rest)
        if len(bin_) == k:
            room = self.capacity - sum(p[2] for p in self.open.pop(k))
            if room:
                self.waiting.append((bin_, room))
            else:
                self._close(bin_)

    def finish(self) -> None:
        """Lay out what is left, cut where a sequence ends."""
        rest = [p for pieces, _ in self.waiting for p in pieces]
        rest += [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(p[2] for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        left = deque(rest)
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, length, ids, n = left.popleft()
                part = min(length, room)
                pieces.append((doc, start, part, ids[:4 * part], n))
                if part < length:
                    left.appendleft((doc, start + part, length - part, ids[4 * part:], n))
                room -= part
            self._close(pieces)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start and length of the piece among the
    document's ids, ids (little-endian unsigned 32-bit, as binary),
    doc_tokens, sequence_id and offset in it.

    A null text counts as empty: its only id is ``end_id``.  Rows that repeat
    are packed each.  Sequence ids are unique, not gapless: each task counts
    its own.  The tokenizer file is read where the plan is built and travels
    with the tasks.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")
    with open(tokenizer_path, "rb") as f:
        tokenizer_json = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_json)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*packer.out)) or [()] * len(kinds)
            packer.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[
                "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            held = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                packer.add(doc, ids)
                held += len(ids)
                if held > 1 << 20:  # bounds the memory of a batch of long texts
                    yield batch()
                    held = 0
            yield batch()
        packer.finish()
        yield batch()

    schema = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
              "offset long")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, schema))
