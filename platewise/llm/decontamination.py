"""Benchmark decontamination: passages of test questions and answers are found
in the documents by one Aho-Corasick automaton.

Its letters are normalised words: A-Z lower-cased, cut at every ASCII
character other than letters and digits.  Its patterns are all windows of
``window`` consecutive item words; an item of fewer words is one pattern.
Each task builds the automaton from the broadcast items and scans each text
once; nothing is shuffled, so a passage that many documents share costs what
any other text costs.

An automaton holds at most ``MAX_WINDOWS`` windows, which bounds its memory
and what is broadcast.  A larger benchmark is dealt into several automata and
the documents are scanned once with each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .text import utf8

# Fixed value: upper case becomes lower case, ASCII beside letters and digits is a gap.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
#: Windows of one automaton (about 600 bytes each), and of one piece of an item.
MAX_WINDOWS, PIECE_WINDOWS = 200_000, 4_096

SPAN = pa.struct([(c, pa.int64()) for c in ("start", "end", "start_char", "end_char")])


class _Vocabulary(dict):
    """Word numbers; 0 for a word that no item has."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Automaton:
    """The windows of ``pieces``: (item id, normalised words joined by spaces)."""

    def __init__(self, pieces: Iterable[tuple[str | None, bytes]], window: int):
        self.numbers = _Vocabulary()
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in pieces:
            ids = tuple([self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split()])
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(ids[i:i + window], set()).add(item)
        self.owners = list(found.values())
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, ids in enumerate(found):
            self.trie.add_word(ids, k)
        self.trie.make_automaton()

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str | None]]:
        """First and last position (end excluded) of every occurrence, and the items."""
        hits = list(self.trie.iter(tuple(map(self.numbers.__getitem__, words)))) if words and self.owners else []
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64), set()
        end, which = np.array(hits, np.int64).T
        return end + 1 - self.lengths[which], end + 1, set().union(*(self.owners[k] for k in set(which.tolist())))


def _merged(start: np.ndarray, end: np.ndarray, n_words: int) -> list[tuple[int, int]]:
    """Maximal runs of words that any occurrence covers."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    turn = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
    return list(zip(turn[::2], turn[1::2]))


def _in_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word spans with their place in the original text, in code points."""
    if not spans:
        return []
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]  # as long as the text: bytes stay in place
    # code points before each byte: continuation bytes don't count
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": s, "end": e, "start_char": int(before[at[s][0]]), "end_char": int(before[at[e - 1][1]])}
            for s, e in spans]


def pieces_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, windows): items as normalised words; long ones in pieces
    that overlap by a window less one word, so that every window is in one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = (raw or b"").translate(NORMAL).split()
                for i in range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE_WINDOWS):
                    part = words[i:i + PIECE_WINDOWS + window - 1]
                    rows.append((item, b" ".join(part), max(1, len(part) - window + 1)))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()),
                                   pa.array([r[1] for r in rows], pa.binary()),
                                   pa.array([r[2] for r in rows], pa.int64())], names=["item", "words", "windows"])

    read = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return read.mapInArrow(cut, "item string, words binary, windows long").distinct()


def dealt(pieces: DataFrame) -> tuple[DataFrame, int]:
    """Pieces with the number of their automaton (``part``), and how many there
    are; no part has more than MAX_WINDOWS windows."""
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    n = max(1, -(-total // MAX_WINDOWS))
    while True:
        parts = pieces.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
        if n == 1 or parts.groupBy("part").agg(F.sum("windows").alias("w")).agg(F.max("w")).first()[0] <= MAX_WINDOWS:
            return parts, n
        n *= 2


def find_passages(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (maximal runs of hit words
    as word positions, ends excluded, and as characters of the original text)
    and items (ids with an occurring window, as sorted strings, each once).

    A word is hit if it lies in an occurrence of a window.  Null, empty and
    wordless texts have no words, spans or items; null, empty and wordless
    items have no windows.  Items that repeat an id count as one id; an item
    without an id hits words and is not listed.  Rows that repeat an id are
    looked at on their own.
    """
    spark = docs.sparkSession
    pieces, n_parts = dealt(materialize(pieces_of(items, window, item_id_col, item_text_col), "benchmark-pieces"))
    state = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.lit(0).cast("long").alias("n_words"),
                        F.array().cast("array<struct<start:long,end:long,start_char:long,end_char:long>>").alias("spans"),
                        F.array().cast("array<string>").alias("items"))
    out = state.drop("text").schema
    for part in range(n_parts):
        # one part, of at most MAX_WINDOWS windows, at a time
        held = spark.sparkContext.broadcast([(r.item, bytes(r.words))
                                             for r in pieces.where(F.col("part") == part).collect()])
        last = part == n_parts - 1

        def scan(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(held.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                for raw, old, ids in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(),
                                         batch.column("items").to_pylist()):
                    raw = raw or b""
                    words = raw.translate(NORMAL).split()
                    start, end, found = automaton.find(words)
                    counts.append(len(words))
                    if not len(start):
                        spans.append(old)
                        items.append(ids)
                        continue
                    start = np.concatenate([start, np.array([s["start"] for s in old], np.int64)])
                    end = np.concatenate([end, np.array([s["end"] for s in old], np.int64)])
                    spans.append(_in_characters(raw, _merged(start, end, len(words))))
                    items.append(sorted(found.union(ids) - {None}))  # by code point, as UTF-8 sorts
                columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
                           "spans": pa.array(spans, pa.list_(SPAN)), "items": pa.array(items, pa.list_(pa.string()))}
                if not last:
                    columns["text"] = batch.column("text")
                yield pa.RecordBatch.from_pydict(columns)

        if last:
            return state.mapInArrow(scan, out)
        columns = ["doc_id", "n_words", "spans", "items", "text"]
        state = materialize(state.mapInArrow(scan, state.select(*columns).schema), "scanned")
    raise AssertionError("there is a part at least")


def hit_words(spans: str = "spans"):
    """Number of hit words of a row."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
