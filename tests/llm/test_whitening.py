import math

import numpy as np
import pytest

from platewise.llm import whitening as W
from tests_llm_helpers import SF01

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(e):
    return e is not None and all(c is not None and math.isfinite(c) for c in e)


def plain(rows, components=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} with a dense solver, for one length."""
    xs = {r[0]: [math.floor(256 * float(np.float32(c))) for c in r[1]] for r in rows}
    fit = np.array(sorted(set(map(tuple, xs.values()))), float)
    n, total = len(fit), [sum(map(int, c)) for c in fit.T]
    mean = np.array([s / n for s in total])
    v = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    m = min(components, int((e > len(v) * 1e-15 * max(abs(e))).sum()))
    return v, e, u, {(i, k + 1): (n, sum((n * a - s) ** 2 for a, s in zip(x, total)),
                                  (np.array(x) - mean) @ u[:, k] / math.sqrt(e[k]), e[k] / np.trace(v))
                     for i, x in xs.items() for k in range(m)}


def check(got, rows, tol=1e-7):
    *_, want = plain(rows)
    assert {(r.id, r.component) for r in got} == set(want) and len(got) == len(want)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = want[r.id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
        if abs(whitened) > 1e-3:
            signs.setdefault(r.component, math.copysign(1, whitened * r.whitened))
        assert r.whitened * signs.get(r.component, 1) == pytest.approx(whitened, abs=tol)


def test_the_driver_s_table(spark):
    table = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(W.whiten(table).collect(), rows)


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=6).tolist() for _ in range(40)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    copies = rows + [(100 + i, vectors[0], None) for i in range(60)] + [(100, vectors[9], 0)]
    bad = [(900, None, 1), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (902, [float("nan")] * 6, 1),
           (903, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    got = W.whiten(spark.createDataFrame(copies + bad, SCHEMA)).collect()
    twice = [r for r in got if r.id == 100]
    assert len(twice) == 8
    got = [r for r in got if r.id != 100]
    check([r for r in got], [r for r in copies if r[0] != 100])  # copies count once; one vector has no variance
    assert {r.n for r in got} == {40}
    none = W.whiten(spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (3, [-0.0, 0.001], 1)], SCHEMA))
    assert [r.id for r in none.collect()].count(None) == 4
    # a plane in three dimensions has two components; lengths are whitened apart
    plane = [(i, [float(a), float(b), float(a + b)], 1) for i, (a, b) in enumerate(rng.integers(-9, 9, (30, 2)))]
    line = [(100 + i, [float(i)], 1) for i in range(5)]
    got = W.whiten(spark.createDataFrame(plane + line, SCHEMA)).collect()
    check([r for r in got if r.id < 100], plane)
    check([r for r in got if r.id >= 100], line)
    assert {r.component for r in got if r.id < 100} == {1, 2}


def test_large_entries(spark):
    rows = [(i, [1e15 * i, 3.0, -1e14 * i * i], 1) for i in range(4)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and all(r.deviation is None for r in got)
    got = W.whiten(spark.createDataFrame([(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1)], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and all(abs(abs(r.whitened) - 1) < 1e-6 for r in got)


def test_empty_table_and_clashing_columns(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    table = spark.read.parquet(f"{SF01}/embeddings.parquet").limit(50)
    more = table.selectExpr("*", "1 AS id", "2 AS x", "3 AS d", "4 AS component", "5 AS n")
    key = lambda r: (r.id, r.component)
    assert sorted(map(key, W.whiten(more).collect())) == sorted(map(key, W.whiten(table).collect()))


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1.0, 41.0), np.ones(12), [5, 5, 5, 5, 5, 1, 1, 1], [9, 5, 5, 5, 5, 5, 1], [1e6, 1e6 - 1e-4, 3, 2, 1, 0, 0],
    [4, 4 - 1e-7, 4 - 2e-7, 4 - 3e-7, 4 - 4e-7, 1], [7, 3, 0, 0, 0, 0], [1], [1e-9, 1e-10, 1e-11, 1e-12, 0],
    np.concatenate([[1704, 1665], np.linspace(1092, 938, 62)])])
def test_components_match_a_dense_solver(spark, values):
    values = np.sort(np.array(values, float))[::-1]
    v = spectrum(values)
    got, u = W.leading(spark, (v + v.T) / 2, 4)
    top = values[:4][values[:4] > 1e-13 * values[0]]
    assert got == pytest.approx(top, rel=1e-10, abs=1e-13 * values[0])
    assert np.abs(u.T @ u - np.eye(len(top))).max() < 1e-12
    assert np.abs(v @ u - u * got).max() <= 1e-11 * values[0]


def test_inertia_counts():
    v = spectrum(np.array([3.0, 2, 2, 1, 0, -1]))
    count = W.Inertia(v)
    assert [count.above(s) for s in (-2, -0.5, 0.5, 1.5, 2.5, 3.5)] == [6, 5, 4, 3, 1, 0]
    assert W.Inertia(np.zeros((3, 3))).above(1e-9) == 0


def test_missing_components_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(W, "projected", lambda spark, v, blocks: [np.zeros_like(y) for *_, y in blocks])
    with pytest.raises(W.Incomplete):
        W.leading(spark, spectrum(np.arange(1.0, 9.0)), 2)
