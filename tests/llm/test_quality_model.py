import zlib

import numpy as np
import pytest

from platewise.llm import quality_model as Q
from platewise.llm import registry
from tests_llm_helpers import LONG, SF01, check_clashes, result, rows, table


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in registry.table(spark, SF01, "labels").collect()}
    got = [r for r in registry.op5_quality_classifier(spark, SF01).collect()]
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(test) > 50 and np.mean([p == y for p, y in test]) > 0.95
    assert all(p == 1 for p, y in test if y == 1)  # good documents stay


def test_scores_come_from_the_text_alone(spark):
    docs = registry.table(spark, SF01, "documents")
    labels = registry.table(spark, SF01, "labels")
    model = Q.fit(docs, labels)
    moved = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'none' AS source")
    a = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    b = {r.doc_id - 1000000: r.score for r in Q.score(moved, model).collect()}
    assert a == b
    # held-out labels make no difference
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 "
                                "THEN 1 - quality ELSE quality END AS quality")
    again = Q.fit(docs, flipped)
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (7, 5), (8, 0), (99, 1)],
                                   "doc_id long, quality int")
    model = Q.fit(table(spark), labels)
    got = Q.score(table(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    empty = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    assert Q.score(table(spark, []), model).collect() == []
    check_clashes(lambda d: Q.score(d, model), table(spark))
    kept = Q.keep_good(table(spark), model, threshold=0.0)
    assert result(kept) == result(table(spark))


def test_no_labels_and_one_class(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(table(spark), Q.fit(table(spark), none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in Q.score(table(spark), Q.fit(table(spark), one)).collect())


def test_sample_is_bounded(spark):
    docs, labels = registry.table(spark, SF01, "documents"), registry.table(spark, SF01, "labels")
    assert Q.fit(docs, labels, train_rows=30).bias == Q.fit(docs, labels, train_rows=30).bias


def test_features_cover_the_whole_text():
    a, b = [np.concatenate(list(Q.features(t.encode()))) for t in (LONG, LONG + " tail")]
    assert len(b) > len(a) > 4 * 60_000
    assert list(Q.features(None)) == list(Q.features(b" \n")) == []
    one = [len(f) for f in Q.features(b"ab")]  # words, repeats, then 2, 3 and 4 bytes of " ab "
    assert one == [1, 0, 3, 2, 1]


def test_repeated_ids_and_long_texts_in_training(spark):
    """An id counts once, with one of its texts; a long text counts whole."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, ("good fine " if i % 2 else "bad poor ") * 40, "en", "a", 1) for i in ids]
    docs += [(ids[0], f"copy {k}", "en", "a", 1) for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    kept, Q.train = Q.train, lambda rows, **kw: seen.append(rows) or kept(rows[:4])
    try:
        Q.fit(table(spark, docs), labels, train_rows=100)
    finally:
        Q.train = kept
    assert len(seen[0]) <= 100
    long = Q.counted(" ".join(f"w{i}" for i in range(30_000)).encode())
    assert (long & 0xFFFFFFFF).sum() == sum(map(len, Q.features(
        " ".join(f"w{i}" for i in range(30_000)).encode())))


def test_scores_are_a_plain_mean_of_embeddings():
    """Features counted one by one, averaged and put through the softmax."""
    rows = [(Q.counted(t), y) for t, y in [(b"a good text", 1), (b"bad bad words", 0)] * 20]
    model = Q.train(rows, min_steps=200)
    for text in (b"a good word", b"", b"bad bad bad", "\u00e9 x".encode()):
        total = [float(model.weights[f]) for part in Q.features(text) for f in part.tolist()]
        logit = model.bias + (sum(total) / len(total) if total else 0.0)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-6)
