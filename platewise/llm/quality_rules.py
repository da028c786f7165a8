"""Quality rules as a short-circuit cascade.

Base statistics are counted for every document.  The rules of the cascade are
predicates on the text; a document is kept when none rejects it.  On a hashed
sample the time and the rejection rate of each rule are measured, the rules
are ordered by rejections per second, and every document runs them in that
order until one rejects it.  The order changes the cost, never the verdict.
"""

from __future__ import annotations

import re
import time
from functools import cached_property
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import utf8

# Fixed value: the symbols that count.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2000  # parameter: at most so many rows time the rules


class Text:
    """One text with its words, cut once; what several rules ask is counted once."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self.words = self.raw.split()

    @cached_property
    def symbols(self) -> int:
        return symbols(self.raw)

    @cached_property
    def duplicate_lines(self) -> int:
        return duplicate_lines(self.raw)

    @cached_property
    def letters(self) -> str:
        """The characters of the words."""
        return b"".join(self.words).decode("utf-8", "replace")


# Fixed value: blocks of scripts that are written without spaces between words (Thai and Lao, Myanmar,
# Khmer, kana, Chinese characters).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"


def symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, SYMBOLS))


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # windows are numbered exactly: the window of k words by its first k - 1 and its last
    code = ids[:n].copy()
    for k in range(1, window):
        pairs = code * (len(number) + 1) + ids[k:k + n]
        code = np.unique(pairs, return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(code)[code] > 1)
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, again, 1)
    np.add.at(ends, again + window, -1)
    return int(np.count_nonzero(np.cumsum(ends[:-1])))


# ------------------------------------------------------------------ rules ---
# Each rejects a text.  The bounds are parameters of the rule set: prose passes them with a wide margin.

def _symbol_heavy(t: Text) -> bool:
    return 10 * t.symbols > 3 * len(t.words)


def _word_length(t: Text) -> bool:
    """In code points; characters of unspaced scripts make no word long."""
    if len(t.letters) < 2 * len(t.words):
        return True
    spaced = t.letters if t.letters.isascii() else re.sub(f"[{UNSPACED}]", "", t.letters)
    return len(spaced) > 25 * len(t.words)


def _shouting(t: Text) -> bool:
    upper = sum(w.isupper() for w in t.words)
    return 2 * upper > len(t.words)


def _duplicate_lines(t: Text) -> bool:
    lines = t.raw.count(b"\n") + 1
    return lines > 3 and 10 * t.duplicate_lines > 3 * lines


def _few_letters(t: Text) -> bool:
    lettered = re.compile(rb"[A-Za-z\x80-\xFF]").search
    return 2 * sum(lettered(w) is not None for w in t.words) < len(t.words)


def _ellipses(t: Text) -> bool:
    lines = t.raw.rstrip(b"\n").split(b"\n")
    return 10 * sum(x.endswith((b"...", "…".encode())) for x in lines) > 3 * len(lines)


RULES: dict[str, Callable[[Text], bool]] = {
    "symbol_heavy": _symbol_heavy, "word_length": _word_length, "shouting": _shouting,
    "duplicate_lines": _duplicate_lines, "few_letters": _few_letters, "ellipses": _ellipses}


def plan_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rules: dict[str, Callable[[Text], bool]] | None = None,
               sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejection rate, seconds a row) by rejections per second, best
    first, on a sample of rows, whatever their ids: at most ``sample_rows``.
    Tasks return counts and seconds only."""
    rules = rules or RULES
    n = docs.count()
    sample = docs.select(text_col).sample(fraction=min(1.0, sample_rows / max(1, n)), seed=7).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = utf8(b.column(0))
            for name, rule in rules.items():
                texts = [Text(t) for t in raw]  # anew, so that no rule gains by an earlier one's counts
                t0 = time.perf_counter()
                rejected = sum(map(rule, texts))
                yield pa.RecordBatch.from_pydict({
                    "rule": [name], "n": [len(texts)], "rejected": [int(rejected)],
                    "secs": [time.perf_counter() - t0]})

    rows = (sample.select(text_col).mapInArrow(run, "rule string, n long, rejected long, secs double")
            .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"),
                                 F.sum("secs").alias("secs")).collect())  # a row for each rule
    seen = {r["rule"]: (r["rejected"] / r["n"], r["secs"] / r["n"]) for r in rows if r["n"]}
    found = [(name, *seen.get(name, (0.0, 1.0))) for name in rules]
    return sorted(found, key=lambda x: -x[1] / max(x[2], 1e-9))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: dict[str, Callable[[Text], bool]] | None = None,
          order: list[str] | None = None, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, rejected_by, kept.

    A null text counts as empty: no words, base_failed.  ``rejected_by`` is
    the first rule that rejects in cascade order (it depends on the measured
    order when several would), null where the base failed or nothing rejects;
    ``kept`` does not depend on the order.
    """
    rules = rules or RULES
    order = order if order is not None else [x[0] for x in plan_order(docs, id_col, text_col, rules)]
    cascade = [(name, rules[name]) for name in order]

    def row(text: bytes | None):
        t = Text(text)
        n, repeats = len(t.words), repeated_words(t.words)
        failed = n < min_words or 100 * repeats > max_repeat_percent * n
        by = None if failed else next((name for name, rule in cascade if rule(t)), None)
        return (n, len(t.letters), t.symbols, t.duplicate_lines, repeats,
                failed, by, not failed and by is None)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "rejected_by", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(row, utf8(b.column(1))))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, types))], names=["doc_id", *names])

    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, base_failed boolean, rejected_by string, kept boolean")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, schema))
