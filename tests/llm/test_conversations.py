import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from platewise.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def fault(turns):
    """(initial, must go, truncated) of ordered (role, text)"""
    seen, out = set(), []
    for role, text in turns:
        blank = not text.strip(" \t\n\x0b\f\r")
        again = (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and text.rstrip(" \t\n\x0b\f\r")[-1] not in ".!?"
        out.append((role[:1], "blank" if blank else "duplicate" if again else "truncated" if cut else ""))
    return out


def exhaustive(turns):
    """Least (cost, audit) over all edits, at most two insertions in a place."""
    best = None
    gaps = [list(itertools.chain(*[itertools.product("ua", repeat=n) for n in range(3)]))] * (len(turns) + 1)
    options = []
    for (role, _), (initial, f) in zip(turns, fault(turns)):
        extra = 3 * (f == "truncated")
        options.append([("D", "", 4)] + ([] if f in ("blank", "duplicate") else
                       [("K", initial or "?", extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]))
    for edits in itertools.product(*options):
        for ins in itertools.product(*gaps):
            roles, audit, cost = "".join(ins[0]), "I" * len(ins[0]), 3 * len(ins[0])
            for (e, r, c), i in zip(edits, ins[1:]):
                roles, audit, cost = roles + r + "".join(i), audit + e + "I" * len(i), cost + c + 3 * len(i)
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def walk(turns):
    """The same from left to right, one state a last role."""
    states = {"": (0, ""), "u": (3, "I"), "a": (6, "II")}
    for initial, f in fault(turns):
        new = {}

        def put(q, cost, audit):
            if q not in new or (cost, audit) < new[q]:
                new[q] = (cost, audit)

        for q, (cost, audit) in states.items():
            moves = [(q, 4, "D")]
            if f not in ("blank", "duplicate"):
                extra = 3 * (f == "truncated")
                moves += [("a" if q == "u" else "u", 3 + extra, "R")]
                if q + initial in ("su", "ua", "au", "s", "u"):
                    moves += [(initial, extra, "K")]
            for to, c, e in moves:
                for n in range(3):
                    put(to, cost + c + 3 * n, audit + e + "I" * n)
                    to = "a" if to == "u" else "u"
        states = new
    return min(states[q] for q in ("", "a") if q in states)


def by_all_splits(cells):
    """The full chart: every span, every split."""
    n, chart = len(cells), {(i, i + 1): c for i, c in enumerate(cells)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            every = [C.combine(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
            chart[i, i + size] = tuple(min((c[x] for c in every if c[x]), default=None) for x in range(len(C.KINDS)))
    return chart[0, n]


def apply(turns, audit):
    out, at, last = [], 0, ""
    for e in audit:
        new = "assistant" if last == "u" else "user"
        if e == "I":
            out.append((e, new, ""))
        else:
            role, text = turns[at]
            at += 1
            if e == "D":
                continue
            out.append((e, role if e == "K" else new, text))
        last = out[-1][1][:1]
    assert at == len(turns) and GOOD.fullmatch("".join(r[:1] for _, r, _ in out))
    return out


def order(row):
    _, turn, role, text = row
    role, text = (" " if x is None else x for x in (role, text))
    return turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest()


def plain(data, best=walk):
    out = {}
    for conv in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == conv), key=order)
        turns = [(r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in mine]
        known = [r[1] for r in mine if r[1] is not None]
        f = fault(turns)
        cost, audit = best(turns)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0,
                     *[sum(x == name for _, x in f) for name in ("blank", "duplicate", "truncated")],
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(f, f[1:])), cost, audit,
                     apply(turns, audit))
    return out


def check(spark, data, best=walk):
    fixed = C.Repair(spark.createDataFrame(data, SCHEMA))
    want = plain(data, best)
    got = {r.conv: tuple(r)[1:] for r in fixed.audits.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    turns = {}
    for r in fixed.repaired().orderBy("position").collect():
        turns.setdefault(r.conv, []).append((r.edit, r.role, r.text))
    assert turns == {k: v[-1] for k, v in want.items() if v[-1]}
    digest = {r.conv: r.sha256 for r in fixed.digests().collect()}
    assert digest == {k: hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in v[-1]).encode()).hexdigest()
                      for k, v in want.items()}


def some_turns(rng, n):
    texts = ["", " ", "Yes.", "no", "why?", "é!", "so", "東京。", " x.\n"]
    return [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(texts)) for _ in range(n)]


def test_cells_are_those_of_every_edit_and_of_every_split():
    rng = random.Random(5)
    for n in [0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3]:
        for _ in range(3):
            turns = some_turns(rng, n)
            assert walk(turns) == exhaustive(turns)
    for n in [*range(1, 20), 40]:
        kinds = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2]) for _ in range(n))
        chart = C.Chart()
        chart.turns(kinds)
        assert chart.cell() == by_all_splits([C.turn_cell(k) for k in kinds])


def test_edge_cases(spark):
    long = "word " * 100_000 + "."
    check(spark, [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."),
        (2, 5, "user", "Hi!"), (2, 5, "user", "Hi!"), (2, 9, "assistant", "ok"),  # a repeat, a gap, truncated
        (3, None, "user", "A?"), (3, None, "user", "A?"), (3, None, "assistant", "B."),  # no turn is known
        (4, 1, None, "C."), (4, 2, "", "D."), (4, 3, "user", None), (4, None, None, None),
        (None, 1, "user", "E."), (None, 1, "assistant", "F."), (None, 1, "assistant", "G."),  # ties
        (5, 1, "assistant", long), (5, 2, "user", long), (6, 1, "user", " \t\n\x0b\f\r"),
        (7, 2**62, "user", "x."), (7, -3, "assistant", "y.")], exhaustive)


def test_a_third_of_all_rows_in_one_conversation(spark):
    rng = random.Random(11)
    data = [(rng.choice([0, None, None, *range(1, 60)]) if rng.random() < 0.6 else 0, rng.choice([None, *range(400)]), *t)
            for t in some_turns(rng, 1500)]
    kept = {k: spark.conf.get(k) for k in ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]}
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, data)
        turns = C.faulty(spark.createDataFrame(data, SCHEMA))
        assert turns.count() < len(data) and turns.agg(F.sum("copies")).first()[0] == len(data)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_rows_repeated_many_times(spark):
    check(spark, [(1, 1, "user", "a.")] * 700 + [(1, 2, "assistant", "b")] + [(2, 0, "system", "")] * 300)


@pytest.mark.parametrize("extra", [["kind", "conv", "copies", "first"], ["digest", "cells", "audit", "last"]])
def test_empty_table_and_clashing_columns(spark, extra):
    empty = C.Repair(spark.createDataFrame([], SCHEMA))
    assert empty.audits.collect() == [] == empty.repaired().collect() == empty.digests().collect()
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b.")], SCHEMA)
    more = rows.select("*", *[F.lit("extra").alias(c) for c in extra])
    assert C.Repair(more).audits.collect() == C.Repair(rows).audits.collect()


def test_damage(spark):
    import zlib

    data = [(c, t, r, "Ab. c! d?") for c in range(40) for t, r in enumerate(["system", "user", "assistant", None])]
    data += [(None, None, "user", None), (None, 3, "assistant", "x."), (3, None, "user", "x.")]
    want = []
    for c, t, r, x in data:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        want += [(c, t, "user" if how == 4 else r, x)] * (0 if how == 0 else 2 if how == 3 else 1)
    got = [tuple(r) for r in C.damaged(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
