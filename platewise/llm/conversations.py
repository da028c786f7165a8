"""Conversation structure repair: the cheapest edits after which a
conversation is an optional system turn and then user and assistant turns in
alternation, found by weighted CYK parsing over spans of turns.

The grammar, in Chomsky normal form, has a nonterminal for each kind of role
sequence: empty, or its first and last role (s, u or a) where all neighbours
inside are su, ua or au.  ``A -> B C`` holds where B's last role may stand
before C's first, or B or C is empty; a turn yields its kinds by keeping,
reroling or deleting it; an inserted turn is an empty span of kind uu or aa.
A span's cell has, for each kind, the least (cost, audit), the audit being the
edits' initials in order.  Cells are closed under insertion at both ends, and
spans are combined bottom-up by their length.

A role sequence can be cut anywhere into two of these kinds, so every split of
a span gives the same cell and one split a span is enough: the chart has n
spans of lengths 1, 2, 4, ... instead of n².  For the same reason a long
conversation is cut over many tasks, whose cells combine in order.  (Least
audits combine to least audits: of two different ones with equal costs over
the same turns none begins the other, as the longer one would have insertions
more.)
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .text import utf8

# Edit costs, and what each truncated turn that stays costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Fixed value: the role initials that may follow each other.
LEGAL = {"su", "ua", "au"}

#: (first role, last role) of a role sequence; accepted: none, ua, and the same behind s.
KINDS = [("", ""), ("s", "s"), ("s", "u"), ("s", "a"), ("u", "u"), ("u", "a"), ("a", "u"), ("a", "a")]
ACCEPTED = [KINDS.index(k) for k in [("", ""), ("u", "a"), ("s", "a")]]
#: A -> B C as places in KINDS: (B, C, A)
RULES = [(i, j, KINDS.index((b[0] or c[0], c[1] or b[1]))) for i, b in enumerate(KINDS) for j, c in enumerate(KINDS)
         if not b[1] or not c[0] or b[1] + c[0] in LEGAL]

Cell = tuple[tuple[int, bytes] | None, ...]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two spans in a row."""
    best: list[tuple[int, bytes] | None] = [None] * len(KINDS)
    for i, j, k in RULES:
        a, b = left[i], right[j]
        if a is None or b is None:
            continue
        cost, old = a[0] + b[0], best[k]
        if old is None or cost < old[0] or cost == old[0] and a[1] + b[1] < old[1]:
            best[k] = (cost, a[1] + b[1])
    return tuple(best)


def _cell(**kinds: tuple[int, bytes]) -> Cell:
    return tuple(kinds.get(first + last if first else "none") for first, last in KINDS)


EMPTY = _cell(none=(0, b""))
#: what insertion makes of an empty span (more than two turns in one place never pay)
INSERTED = _cell(none=(0, b""), uu=(INSERT, b"I"), aa=(INSERT, b"I"), ua=(2 * INSERT, b"II"), au=(2 * INSERT, b"II"))


def closed(cell: Cell) -> Cell:
    """With turns inserted before and behind."""
    return combine(combine(INSERTED, cell), INSERTED)


def deleted(times: int) -> Cell:
    """So many turns that have to go."""
    return closed(_cell(none=(DELETE * times, b"D" * times)))


#: A turn's class: its initial's place in "sua", 3 for any other; 4 more if truncated; 8 for one that has to go.
GONE = 8


@functools.lru_cache(maxsize=None)  # nine classes
def turn_cell(kind: int) -> Cell:
    if kind == GONE:
        return deleted(1)
    extra, initial = TRUNCATED * (kind // 4), "sua?"[kind % 4]
    kinds = {"none": (DELETE, b"D"), "uu": (REROLE + extra, b"R"), "aa": (REROLE + extra, b"R")}
    if initial != "?":
        kinds[initial * 2] = (extra, b"K")
    return closed(_cell(**kinds))


@functools.lru_cache(maxsize=1 << 15)  # short runs of turns recur
def short_cell(kinds: bytes) -> Cell:
    if len(kinds) == 1:
        return turn_cell(kinds[0])
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combine(short_cell(kinds[:half]), short_cell(kinds[half:]))


class Chart:
    """Spans of growing length over turns that arrive in order: neighbours of
    equal length are combined at once, so that few spans wait."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, level: int = 0) -> None:
        while self.spans and self.spans[-1][0] <= level:
            last, before = self.spans.pop()
            cell, level = combine(before, cell), max(level, last) + 1
        self.spans.append((level, cell))

    def turns(self, kinds: bytes) -> None:
        for i in range(0, len(kinds), 8):
            self.add(short_cell(kinds[i:i + 8]))

    def cell(self) -> Cell:
        out = None
        for _, cell in reversed(self.spans):
            out = cell if out is None else combine(cell, out)
        return EMPTY if out is None else out


def cheapest(cell: Cell) -> tuple[int, bytes]:
    return min(cell[k] for k in ACCEPTED if cell[k] is not None)


class Segment:
    """Neighbouring turns of one conversation: their cell and their counts."""

    SUMS = ["n_blank", "n_duplicate", "n_truncated"]

    def __init__(self, conv: object):
        self.conv, self.chart, self.order = conv, Chart(), None
        self.sums = dict.fromkeys(self.SUMS, 0)
        self.illegal, self.first, self.last = 0, None, None
        self.low, self.high, self.distinct, self.turn = None, None, 0, None

    def add(self, kinds: bytes, copies: list[int], initials: list[str], turns: list[int | None]) -> None:
        """Turns in order; null turns come first."""
        if max(copies) == 1:
            self.chart.turns(kinds)
        else:
            for kind, n in zip(kinds, copies):
                self.chart.add(turn_cell(kind))
                if n > 1:
                    self.chart.add(deleted(n - 1))
                    self.illegal += n - 1  # no initial may follow itself
        for initial in initials:
            self._after(initial)
        for turn in turns:
            self._turns(turn, turn, int(turn is not None))

    def _after(self, first: str, last: str | None = None) -> None:
        if self.first is None:
            self.first = first
        elif self.last + first not in LEGAL:
            self.illegal += 1
        self.last = first if last is None else last

    def _turns(self, low: int | None, high: int | None, distinct: int) -> None:
        if low is None:
            return
        self.distinct += distinct - (low == self.high)
        self.low, self.high = low if self.low is None else self.low, high

    def then(self, other: dict) -> None:
        """The segment that follows, as a row of ``SEGMENT``."""
        self.chart.add(tuple(c and (c["cost"], c["audit"]) for c in other["cells"]))
        for c in self.SUMS:
            self.sums[c] += other[c]
        self.illegal += other["illegal"]
        self._after(other["first"], other["last"])
        self._turns(other["low"], other["high"], other["distinct"])

    def row(self, whole: bool) -> dict:
        """Cost and audit if it is known to be the whole conversation, else the cell."""
        cell = self.chart.cell()
        cost, audit = cheapest(cell) if whole else (None, None)
        return {"conv": self.conv, "whole": whole, "order": self.order, **self.sums, "illegal": self.illegal,
                "first": self.first, "last": self.last, "low": self.low, "high": self.high,
                "distinct": self.distinct, "cost": cost, "audit": audit and audit.decode() if whole else None,
                "cells": None if whole else [c and {"cost": c[0], "audit": c[1]} for c in cell]}


#: Beside conv, whose type is the table's own.
SEGMENT = ("whole boolean, order struct<turn:long,role:string,digest:binary>, n_blank long, n_duplicate long, "
           "n_truncated long, illegal long, first string, last string, low long, high long, distinct long, "
           "cost long, audit string, cells array<struct<cost:long,audit:binary>>")


def faulty(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Distinct turns, written: conv, turn, role, text, digest (of the text),
    copies (equal rows, counted before they are shuffled, so that no number of
    repeats fills a task), kind (of the first copy) and how many of the copies
    are blank, duplicate or truncated."""
    turns = (rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                         F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
             .groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
             .withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # texts that come again in their conversation; map-side combine, then few rows
    again = (turns.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
             .agg(F.min(at).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    repeats = F.col("earliest").isNotNull() & (at != F.col("earliest"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    copies, zero = F.col("copies"), F.lit(0).cast("long")
    return materialize(
        turns.join(again, same, "left").withColumn("blank", blank).withColumn("repeats", repeats)
        .withColumn("cut", cut)
        .select("conv", "turn", "role", "text", "digest", "copies", initial.alias("initial"),
                F.when(F.col("blank") | F.col("repeats"), F.lit(GONE)).otherwise(
                    place + F.when(F.col("cut"), 4).otherwise(0)).cast("int").alias("kind"),
                F.when(F.col("blank"), copies).otherwise(zero).alias("n_blank"),
                F.when(F.col("blank"), zero).otherwise(copies - (~F.col("repeats")).cast("long")).alias("n_duplicate"),
                (F.col("cut") & ~F.col("blank") & ~F.col("repeats")).cast("long").alias("n_truncated")),
        "conversation-turns")


def _by_turn() -> list[Column]:
    """Ties in turn: by role, then by the digest of the text."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def parsed(turns: DataFrame) -> DataFrame:
    """Per conversation of ``faulty``'s turns: conv, the counts, cost and audit.

    Turns are sorted by range, so that a long conversation lies in many tasks.
    A conversation inside a task is finished there; only the first and last of
    a task may go on in a neighbouring one, and their cells meet afterwards.
    """
    conv_type = turns.schema["conv"].dataType.simpleString()
    schema = f"conv {conv_type}, {SEGMENT}"
    sorted_turns = (turns.drop("text").repartitionByRange(F.col("conv").asc(), *_by_turn())
                    .sortWithinPartitions(F.col("conv").asc(), *_by_turn()))
    out = sorted_turns.sparkSession.createDataFrame([], schema).schema

    def rows_of(segments: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(segments, schema=arrow)

    arrow = _arrow_schema(out)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Segment | None = None
        first, ready = True, []
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in
                   ["conv", "turn", "role", "digest", "copies", "kind", "initial", *Segment.SUMS]}
            convs, n = col["conv"], batch.num_rows
            starts = [i for i in range(n) if i == 0 or convs[i] != convs[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], n]):
                if here is None or convs[lo] != here.conv:
                    if here is not None:
                        ready.append(here.row(whole=not first))
                        first = False
                    here = Segment(convs[lo])
                    here.order = {c: col[c][lo] for c in ("turn", "role", "digest")}
                here.add(bytes(col["kind"][lo:hi]), col["copies"][lo:hi], col["initial"][lo:hi], col["turn"][lo:hi])
                for c in Segment.SUMS:
                    here.sums[c] += sum(col[c][lo:hi])
            yield rows_of(ready, arrow)
            ready = []
        if here is not None:
            yield rows_of([here.row(whole=False)], arrow)

    found = materialize(sorted_turns.mapInArrow(segments, out), "conversation-segments")

    def join(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: (r["order"]["turn"] is not None, r["order"]["turn"] or 0,
                                                         r["order"]["role"].encode(), r["order"]["digest"]))
        whole = Segment(parts[0]["conv"])
        for part in parts:
            whole.then(part)
        return pa.Table.from_pylist([whole.row(whole=True)], schema=arrow)

    # a row a task that the conversation lies in
    met = found.where("NOT whole").groupBy("conv").applyInArrow(join, out)
    every = found.where("whole").unionByName(met)
    return every.select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"),
                                           F.lit(0).cast("long")).alias("gaps"),
                        F.col("n_blank").alias("blank"), F.col("n_duplicate").alias("duplicate"),
                        F.col("n_truncated").alias("truncated"), "illegal", "cost", "audit")


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Edits:
    """Applies a conversation's audit to its turns, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.position = audit, 0, "", 0

    def _turn(self, edit: str, role: bytes, text: bytes) -> tuple[str, int, bytes, bytes]:
        self.last = role[:1].decode()
        self.position += 1
        return edit, self.position, role, text

    def _next(self) -> bytes:
        return b"assistant" if self.last == "u" else b"user"

    def inserted(self) -> Iterable[tuple[str, int, bytes, bytes]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._turn("I", self._next(), b"")

    def turn(self, role: bytes, text: bytes, copies: int) -> Iterable[tuple[str, int, bytes, bytes]]:
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._turn(edit, role if edit == "K" else self._next(), text)


def _edited(turns: DataFrame, audits: DataFrame, done, schema: str) -> DataFrame:
    """``done(conv, turns)`` for each conversation, where turns iterates over
    (edit, position, role, text) while they are read: of a conversation only
    its audit is held."""
    head = audits.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(b"").alias("digest"),
                         F.lit(0).cast("long").alias("copies"), "audit")
    rows = turns.select("conv", "turn", "role", "text", "digest", "copies", F.lit(None).cast("string").alias("audit"))
    stream = (head.unionByName(rows).repartition("conv")
              .sortWithinPartitions("conv", F.col("audit").isNull(), *_by_turn())
              .select("conv", "role", "text", "copies", "audit"))
    out = turns.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, sink, ready = None, None, []
        for batch in batches:
            for conv, role, text, copies, audit in zip(
                    batch.column("conv").to_pylist(), utf8(batch.column("role")), utf8(batch.column("text")),
                    batch.column("copies").to_pylist(), batch.column("audit").to_pylist()):
                if audit is not None:  # a conversation begins
                    if edits is not None:
                        sink.take(edits.inserted(), ready)
                        sink.end(ready)
                    edits, sink = Edits(audit), done(conv)
                else:
                    sink.take(edits.turn(role, text, copies), ready)
                if len(ready) >= 4096:
                    yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                    ready = []
        if edits is not None:
            sink.take(edits.inserted(), ready)
            sink.end(ready)
        yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    return stream.mapInArrow(run, out)


class _Rows:
    def __init__(self, conv: object):
        self.conv = conv

    def take(self, turns: Iterable[tuple[str, int, bytes, bytes]], ready: list[dict]) -> None:
        for edit, position, role, text in turns:
            ready.append({"conv": self.conv, "position": position, "edit": edit, "role": role.decode(),
                          "text": text.decode()})

    def end(self, ready: list[dict]) -> None:
        pass


class _Digest:
    def __init__(self, conv: object):
        self.conv, self.sha = conv, hashlib.sha256()

    def take(self, turns: Iterable[tuple[str, int, bytes, bytes]], ready: list[dict]) -> None:
        for _, position, role, text in turns:
            self.sha.update(b"".join([b"\n" if position > 1 else b"", role, b":", text]))

    def end(self, ready: list[dict]) -> None:
        ready.append({"conv": self.conv, "sha256": self.sha.hexdigest()})


class Repair:
    """The repair of ``rows``; other columns are left alone.

    Rows are taken by turn, nulls first; ties by role, then by the SHA-256 of
    the text.  Null roles and texts read as one space, so a null text is
    blank, and a role that does not begin with s, u or a is reroled or its
    turn deleted.  Rows without a conversation id are one conversation.
    Repeated rows are duplicates of the first.  Texts of any length count
    whole.  An empty table has no conversations.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text"):
        self.turns = faulty(rows, conv_col, turn_col, role_col, text_col)
        #: conv, gaps, blank, duplicate, truncated, illegal, cost, audit
        self.audits = materialize(parsed(self.turns), "conversation-audits")

    def repaired(self) -> DataFrame:
        """The turns that stay or are new: conv, position (from 1), edit (K, R
        or I), role, text."""
        conv = self.turns.schema["conv"].dataType.simpleString()
        return _edited(self.turns, self.audits, _Rows, f"conv {conv}, position long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """Per conversation: conv, sha256 of its repaired ``role:text`` lines.
        A hash takes its bytes in order, so one task reads a conversation, as
        a stream."""
        conv = self.turns.schema["conv"].dataType.simpleString()
        return _edited(self.turns, self.audits, _Digest, f"conv {conv}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` damaged by crc32(conv_id:turn) % 20: 0 are
    dropped, 1 lose their text, 2 its full stops, exclamation and question
    marks, 3 come twice, 4 become the user's.  Nulls read as one space."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    how = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    times = F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (rows.where(how != 0)
            .select("conv_id", "turn", F.when(how == 4, "user").otherwise(known("role")).alias("role"),
                    text.alias("text"), F.explode(times).alias("copy")).drop("copy"))
