"""The pipeline against a brute-force version of each stage on its own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as C
from platewise.llm import mixing, pii, quality_model, registry
from platewise.session import materialize
from test_packing import check as check_packing
from test_simhash import plain_components, plain_fingerprint
from tests_llm_helpers import PROSE, SF001, clashing, rows, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = registry.table(spark, SF001, "documents")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(materialize(stage(spark, out[-1], SF001), name))
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in C.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii", "mix_sources", "packing"]
    assert all(d.columns == COLUMNS for d in stages[:-1])


def test_classifier_decides(spark, stages):
    model = quality_model.fit(stages[0], registry.table(spark, SF001, "labels"))
    want = {tuple(r) for r in stages[0].collect() if model.score((r.text or "").encode()) >= 0.3}
    assert {tuple(r) for r in stages[1].collect()} == want and 0 < len(want) < stages[0].count()


def test_one_of_each_group_stays(stages):
    data = stages[1].collect()
    roots = plain_components([r.doc_id for r in data], [plain_fingerprint(r.text, 4) for r in data], 4)
    want = sorted(tuple(r) for r, c in zip(data, roots) if r.doc_id == c)
    assert sorted(map(tuple, stages[2].collect())) == want and len(want) < len(data)


def test_personal_data_goes(stages):
    def done(r):
        t = pii.pseudonymise(r.text, registry.PII_KEY)[0]
        return (r.doc_id, t, r.lang, r.source, len(t))

    assert sorted(map(tuple, stages[3].collect())) == sorted(map(done, stages[2].collect()))


def test_mix(spark, stages):
    times = {r.doc_id: r.times for r in mixing.mix(stages[3]).collect()}
    want = sorted(tuple(r) for r in stages[3].collect() for _ in range(times[r.doc_id]))
    assert sorted(map(tuple, stages[4].collect())) == want


def test_packed(stages):
    check_packing(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), stages[5].collect(),
                  [(r.doc_id, r.text) for r in stages[4].collect()])


def test_registered(spark, stages):
    assert C.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()
    assert E.queries()["pipeline"](spark, SF001).count() == stages[5].count()


@pytest.mark.parametrize("k", range(5))
def test_edge_cases(spark, k):
    """Nulls, empty and long texts, repeated rows, an empty table, extra columns."""
    stage = C.STAGES[k][1]
    docs = table(spark)
    got = stage(spark, docs, SF001)
    if k < 4:
        assert got.schema.simpleString() == docs.schema.simpleString()
        wide = stage(spark, clashing(docs), SF001)
        assert sorted(map(repr, wide.select(*COLUMNS).collect())) == sorted(map(repr, got.collect()))
    if k == 1:  # of equal texts with and without ids, rows that repeat, and empty texts, one each
        kept = sorted((r.doc_id, r.text) for r in got.collect())
        by_id = {r[0]: r[1] for r in rows() if r[0] is not None}
        assert all(by_id[i] == t for i, t in kept) and [i for i, _ in kept][:1] == [1]
        assert len(kept) == len({i for i, _ in kept}) and {4, 5, 6} & {i for i, _ in kept} == {4}
    assert stage(spark, docs.limit(0), SF001).collect() == []


def test_unlike_texts_under_one_id_stay(spark):
    other, third = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i * i}" for i in range(40))
    data = [(1, PROSE, "en", "a", 1), (7, other, "en", "a", 1), (7, PROSE, "en", "a", 1), (7, third, "en", "b", 1),
            (7, third, "en", "b", 1), (7, None, "en", "b", 1), (9, other, "en", "a", 1), (None, third, "en", "a", 1),
            (None, f"{other} {third}", "en", "a", 1), (None, f"{other} {third}", "en", "a", 1), (8, "abc", None, "a", 1),
            (8, None, "abc", "a", 1)]
    got = C.one_of_each(spark, table(spark, data), SF001)
    assert got.columns == COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(1, PROSE), (7, other), (7, third), (7, None), (None, f"{other} {third}"), (8, "abc")], key=repr)
