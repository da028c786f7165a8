import random
import re

import pytest

from platewise.llm import decontamination as D
from tests_llm_helpers import SF001, check_clashes, rows, table

ITEMS = "item_id long, text string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return list(WORDS.finditer(lower))


def plain(docs, items, window):
    grams = {}
    for i, t in items:
        w = [m[0] for m in normal(t)]
        for k in range(len(w) - window + 1) if len(w) >= window else [0] if w else []:
            grams.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for i, t in docs:
        found = normal(t)
        w = [m[0] for m in found]
        hit, ids = set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                owners = grams.get(tuple(w[k:k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    ids |= owners
        spans = [(k, next(e for e in range(k, len(w) + 1) if e not in hit)) for k in sorted(hit) if k - 1 not in hit]
        spans = [(s, e, found[s].start(), found[e - 1].end()) for s, e in spans]
        out.append((i, len(w), spans, sorted(str(x) for x in ids - {None})))
    return sorted(out, key=repr)


def check(spark, data, items, window=10):
    got = D.find_passages(table(spark, data), spark.createDataFrame(items, ITEMS), window).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.items) for r in got), key=repr)
    assert got == plain([r[:2] for r in data], items, window)


PROSE = rows()[0][1]
AWKWARD = [(1, PROSE[:90]), (2, "Lazy DOG"), (3, None), (4, ""), (5, " .,;\n"), (None, "silver clouds"), (2, "東京 the"),
           (6, PROSE), (6, PROSE), (10, "quick-brown/FOX"), (7, "à é")]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_edge_cases(spark, window):
    check(spark, rows() + [(20, "É: 東京,THE lazy.dog! \x00quick\x7fbrown fox ... silver  clouds", "x", "y", 1)],
          AWKWARD, window)


def test_the_driver_s_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    check(spark, docs, items)


def test_a_large_benchmark_takes_several_automata(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_WINDOWS", 40)
    monkeypatch.setattr(D, "PIECE_WINDOWS", 7)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(15)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60))) + " " + (rng.choice(items)[1]), "en", "a", 1)
            for i in range(40)]
    pieces = D.pieces_of(spark.createDataFrame(items, ITEMS), 4, "item_id", "text")
    parts, n = D.dealt(pieces)
    assert n > 1 and max(r["sum(windows)"] for r in parts.groupBy("part").sum("windows").collect()) <= 40
    check(spark, docs, items, 4)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], ITEMS)
    assert D.find_passages(table(spark, []), spark.createDataFrame(AWKWARD, ITEMS)).collect() == []
    assert all(r.spans == [] and r.items == [] for r in D.find_passages(table(spark), none).collect())
    items = spark.createDataFrame(AWKWARD, ITEMS)
    check_clashes(lambda d: D.find_passages(d.withColumnsRenamed({"words": "item", "bucket": "spans", "row": "items"}),
                                            items, 3), table(spark))
