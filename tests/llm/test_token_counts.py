import math

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from platewise.llm import token_counts as T
from tests_llm_helpers import SF001, check_clashes, rows, table, words

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return T.Vocabulary.load(PATH)


def plain(word, v):
    """Every segmentation's best score, by a plain forward pass over positions."""
    s = T.MARK + word
    best = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        found = [(best[j][0] + v.scores[s[j:i]], -j, best[j][1] + 1) for j in range(i) if s[j:i] in v.scores]
        if s[i - 1] not in v.scores:
            found.append((best[i - 1][0] + v.missing, -i, best[i - 1][1] + len(s[i - 1].encode())))
        top = max(x[0] for x in found)
        _, _, n = max((x for x in found if x[0] == top), key=lambda x: x[1])
        best.append((top, n))
    return best[-1][1]


def check(spark, docs, texts, v):
    seen = {}
    got = sorted((tuple(r) for r in T.count_tokens(docs, v).collect()), key=repr)
    want = []
    for i, t in texts:
        w = words(t)
        for x in set(w) - seen.keys():
            seen[x] = plain(x, v)
        want.append((i, len(w), sum(seen[x] for x in w)))
    assert got == sorted(want, key=repr)


def test_edge_cases(spark, vocabulary):
    data = rows() + [(40, "🙂🙂 \u2581x 東京都 naïve", "en", "a", 1), (41, "a" * 3000, "en", "a", 1)]
    check(spark, table(spark, data), [r[:2] for r in data], vocabulary)


def test_sample_and_small_trie(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(T, "MAX_NODES", 500)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    check(spark, docs, [(r.doc_id, r.text) for r in docs.collect()], vocabulary)


def test_prefixes_are_scored_once(vocabulary):
    trie = T.Trie(vocabulary)
    trie.count("▁international")
    before = len(trie)
    trie.count("▁internationally")
    assert len(trie) == before + 2


def test_agrees_with_the_unigram_decoder(spark, vocabulary):
    """The same pieces and scores in a unigram model of the library."""
    m = proto.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    m.normalizer_spec.remove_extra_whitespaces = True
    for piece in m.pieces:
        if piece.piece in vocabulary.scores:
            piece.score = vocabulary.scores[piece.piece]
    p = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(60).collect()]
    seen = sorted({w for t in texts for w in words(t)})
    trie = T.Trie(vocabulary)
    ours, theirs = [trie.count(T.MARK + w) for w in seen], [len(p.encode(w)) for w in seen]
    assert sum(a == b for a, b in zip(ours, theirs)) >= 0.99 * len(seen)


def test_scores_are_probabilities_near_the_merged_pieces(spark, vocabulary):
    """They add up to one; counts are near those of the vocabulary's own encoder."""
    assert sum(math.exp(x) for x in vocabulary.scores.values()) == pytest.approx(1)
    p = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [(r.text or "") for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string"), vocabulary).collect()}
    own = {i: len(p.encode(" ".join(words(t)))) for i, t in enumerate(texts)}
    assert sum(abs(got[i] - own[i]) for i in own) < 0.03 * sum(own.values())


def test_empty_table_and_clashing_columns(spark, vocabulary):
    assert T.count_tokens(table(spark, []), vocabulary).collect() == []
    check_clashes(lambda d: T.count_tokens(d, vocabulary), table(spark))
