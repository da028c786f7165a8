import random

import numpy as np
import pytest

from platewise.llm import repeats
from tests_llm_helpers import SF001, check_clashes, rows, table, words


def plain(data, window):
    first = {}
    for i, t in data:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in data:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def check(spark, data, window=13):
    got = repeats.remove_repeats(table(spark, data), window).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == plain([r[:2] for r in data], window)
    for r in got:  # maximal, disjoint intervals
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_edge_cases(spark):
    check(spark, rows())


@pytest.mark.parametrize("window", [1, 3, 13])
def test_sample(spark, window):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()], window)


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 300)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    rng = random.Random(1)
    data = []
    for i in range(300):
        t = [rng.choice("abc") if rng.random() < 0.9 else f"w{rng.randrange(99)}" for _ in range(rng.randrange(40))]
        data.append((rng.randrange(250), " ".join(t), "en", "a", 1))
    check(spark, data, 4)


def test_rolling_hash_and_packing():
    w = [b"x%d" % (i % 7) for i in range(50)]
    h = repeats.window_hashes(w, 5)
    grams = [tuple(w[i:i + 5]) for i in range(46)]
    assert all((a == b) == (x == y) for a, x in zip(h, grams) for b, y in zip(h, grams))
    h, d = np.sort(h), np.arange(46) - 20
    a, b = repeats._unpack(repeats._pack(h, d))
    assert (a == h).all() and (b == d).all()


def test_empty_table_and_clashing_columns(spark):
    assert repeats.remove_repeats(table(spark, [])).collect() == []
    check_clashes(lambda d: repeats.remove_repeats(d).drop("spans"), table(spark))
