import numpy as np
import pytest

from platewise.llm import registry, vector_search as V
from tests_llm_helpers import SF01

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(data, k=5, every=50):
    """Exact neighbours: {query: [(vec_id, score)]}."""
    data = [(i, np.array(v, float)) for i, v, _ in data]
    out = {}
    for q, v in data:
        if q % every == 0:
            near = {}
            for i, u in data:
                if i != q:
                    near.setdefault(i, float(V.cosine(u[None], v)[0]))
            out[q] = sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall(spark):
    data = [tuple(r) for r in registry.table(spark, SF01, "embeddings").collect()]
    got, want = found(registry.op7_adaptive_vector_search(spark, SF01)), plain(data)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_of_probed_lists(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.standard_normal(32).tolist(), 0) for i in range(3000)]
    got, want = found(V.search(spark.createDataFrame(data, SCHEMA), min_probes=16)), plain(data)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("chunk", [8192, 10])
def test_ties_copies_and_invalid_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(V, "CHUNK", chunk)
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 2.0, 3.0] if i % 3 else [2.0, 4.0, 6.0 + (i % 2)], 0) for i in range(120)]
    good += [(300 + i, [float(i), 1.0, -2.0], 0) for i in range(30)] + [(50, good[50][1], 1)]
    bad = [(1000, None, 0), (1050, [], 0), (1100, [0.0, 0.0, 0.0], 0), (1150, [1.0, nan, 2.0], 0),
           (1200, [1.0, inf, 2.0], 0), (1250, [1.0, None, 2.0], 0), (None, [1.0, 2.0, 3.0], 0), (1300, [1.0, 2.0], 0)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    got, want = found(V.search(df)), plain(good)
    assert got == want
    extra = df.selectExpr("*", "1 AS v", "2 AS ids", "3 AS list", "4 AS chunk", "5 AS asks", "6 AS q")
    assert found(V.search(extra)) == got


def test_each_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_CHUNK", 1)  # queries in blocks
    rng = np.random.default_rng(4)
    long = [(i, rng.normal(size=8).tolist(), 0) for i in range(130)]
    short = [(i, rng.normal(size=4).tolist(), 0) for i in [*range(200, 260), 50]]
    want = plain(long)
    for q, near in plain(short).items():
        want[q] = want.get(q, []) + near
    got = {}
    for r in V.search(spark.createDataFrame(long + short, SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys() == {0, 50, 100, 200, 250}
    for q, near in want.items():
        assert got[q] == {(k % 5 + 1, *n) for k, n in enumerate(near)}


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (7, [-1e300, 1e300], 0)], SCHEMA)
    got = found(V.search(df))
    assert [i for i, _ in got[0]] == [1, 7] and len(got) == 1
    assert found(V.search(df.where("vec_id = 0"))) == {}
    assert found(V.search(df.limit(0))) == {}
    assert V.search(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_scan_abandons_early_but_keeps_the_nearest():
    rng = np.random.default_rng(3)
    base = V.unit(rng.standard_normal((4000, 64))) @ V.rotation(64)
    q = V.unit(base[:20] + 0.05 * rng.standard_normal((20, 64)))
    far = ((base[None, :2000] - q[:, None]) ** 2).sum(axis=2)
    for bound in (None, np.sort(far, axis=1)[:, 5]):
        at, row = V.adaptive_scan(base, q, 6, bound)
        for k in range(20):
            got = set(row[at == k].tolist())
            want = np.argsort(((base - q[k]) ** 2).sum(axis=1))[:6].tolist()
            assert len(got & set(want)) >= 5 and len(got) <= 8
