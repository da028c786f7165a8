import duckdb
import pytest

from platewise.llm import mixing
from platewise.llm.sql import ORACLES
from tests_llm_helpers import check_clashes, result, table, words


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Round by round: what is above its cap is dealt to the others."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = budget - sum(most * sizes[s] for s in capped)
        goal = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **goal}
        capped |= over


def check(spark, data):
    got = mixing.mix(table(spark, data)).collect()
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    goal = plain_targets(sizes) if data else {}
    assert sorted((r.doc_id or -1, r.source or "", r["size"]) for r in got) == sorted(
        (r[0] or -1, r[3] or "", len(words(r[1]))) for r in data)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.times * r["size"] and 0 <= r.times <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        same = sum(x["size"] for x in got if x.doc_id == r.doc_id and x.source == r.source)
        largest[r.source] = max(largest.get(r.source, 0), same)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    return got


def test_edge_cases(spark):
    from tests_llm_helpers import rows
    check(spark, rows())


def test_many_small_documents(spark):
    data = [(i, "w " * (i % 13), "en", f"s{i % 7}" if i % 3 else "hot", 1) for i in range(3000)]
    first = check(spark, data)
    again = mixing.mix(table(spark, data[::-1])).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_zero_words_and_empty_table(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    assert [(r.target, r.taken) for r in check(spark, [(1, "", "en", "a", 0), (2, None, "en", "b", 0)])] == [(0, 0)] * 2


def test_clashing_columns(spark):
    check_clashes(mixing.mix, table(spark))


def test_copies_of_rows(spark):
    docs = table(spark)
    cut = mixing.thresholds(mixing.sizes(docs))
    copies = mixing.mixed_rows(docs, cut)
    assert copies.columns == docs.columns
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r["size"]] = want.get((r.doc_id, r["size"]), 0) + r.times
    got = {}
    for r in copies.collect():
        k = (r.doc_id, len(words(r.text)))
        got[k] = got.get(k, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_sql_agrees_on_edge_cases(spark):
    from tests_llm_helpers import rows
    documents = table(spark).toPandas()  # noqa: F841  read by DuckDB by its name
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    got = mixing.mix(table(spark)).select("doc_id", "size", "source_size", "target", "taken")
    want = sorted(duckdb.sql(ORACLES["op2_mix_sources"]).fetchall(), key=repr)
    assert result(got) == want and len(want) == len(rows())
