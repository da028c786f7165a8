import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from platewise.llm import packing
from tests_llm_helpers import LONG, SF001, check_clashes, rows, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(tokenizer, pieces, data, capacity=2048):
    ids = {}
    for i, t in data:
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    sequences, cover = {}, {}
    for p in pieces:
        got = [int.from_bytes(p.ids[k:k + 4], "little") for k in range(0, len(p.ids), 4)]
        assert any(got == d[p.start:p.start + p.length] and len(d) == p.doc_tokens for d in ids[p.doc_id])
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        cover.setdefault(p.doc_id, []).append((p.start, p.length))
    for i, texts in ids.items():  # each id lies in exactly one piece (of each row that repeats)
        want = sorted(k for d in texts for k in range(len(d)))
        assert sorted(k for s, n in cover[i] for k in range(s, s + n)) == want
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    assert padding == 0


def test_edge_cases(spark, tokenizer):
    data = rows() + [(30, "<|endoftext|> and <|endoftext|>", "en", "a", 1), (31, "naïve — “quotes” 東京 🙂 \u00a0\u2003x ½", "en", "a", 1),
                     (32, "\r\n\t  \n x  y\x0b\x1c\x85z ", "en", "a", 1), (33, "it's I'll we'd 'S 'sx", "en", "a", 1)]
    check(tokenizer, packing.pack(table(spark, data), PATH).collect(), [r[:2] for r in data])


@pytest.mark.parametrize("capacity", [1, 64, 2048])
def test_sample(spark, tokenizer, capacity):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").repartition(5)
    check(tokenizer, packing.pack(docs, PATH, capacity=capacity).collect(),
          [(r.doc_id, r.text) for r in docs.collect()], capacity)


def test_bins_hold_whole_documents_of_a_class(spark):
    """Most documents are whole; few pieces are short; a class's bin has its number of rests."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    pieces, by = packing.pack(docs, PATH).collect(), {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    cut = [p for p in pieces if p.length < min(64, p.doc_tokens)]
    assert len(cut) < 0.05 * len(pieces)
    short = {p.doc_id for p in pieces if p.doc_tokens <= 2048}
    assert sum(p.length == p.doc_tokens for p in pieces if p.doc_id in short) > 0.7 * len(short)
    # the first rests of a bin are of one class, as many as its number, then comes the filling
    ok = 0
    for bin_ in by.values():
        k = min(2048 // bin_[0].length, packing.CLASSES)
        ok += all(min(2048 // p.length, packing.CLASSES) == k for p in bin_[:k])
    assert ok > 0.9 * len(by)


def test_packer_holds_little():
    packer = packing.Packer(64, 0)
    rng = np.random.default_rng(0)
    for i in range(3000):
        packer.add(i, np.arange(rng.integers(1, 33), dtype="<u4"))  # no long document comes
        assert len(packer.waiting) <= packing.WAITING + packing.CLASSES
    packer.finish()
    ends = {}
    for p in packer.out:
        ends[p[5]] = max(ends.get(p[5], 0), p[6] + p[2])
    assert all(e & (e - 1) == 0 for e in ends.values()) and sum(e != 64 for e in ends.values()) <= 6


def test_encoder_is_the_tokenizer(tokenizer, spark):
    encoder = packing.Encoder(open(PATH, "rb").read())
    texts = [LONG, " " * 5000 + "x", "a" * 5000, " \n" * 3000 + "y", "ÀÖØöøÿ ſ ×÷ ŉ", "x<|endoftext|>y",
             *(chr(c) + " " + chr(c) + "a1" + chr(c) for c in [*range(1, 0x600), 0x2028, 0x3000, 0xFEFF, 0x1F600])]
    for t in texts:
        assert encoder.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:20])


def test_digest_query(spark, tokenizer):
    from platewise.llm import registry
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for p in registry.op8_harmonic_packing(spark, SF001).collect():
        ids = (tokenizer.encode(text[p.doc_id], add_special_tokens=False).ids + [1])[p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_empty_table_and_clashing_columns(spark):
    assert packing.pack(table(spark, []), PATH).collect() == []
    check_clashes(lambda d: packing.pack(d, PATH), table(spark).coalesce(1))


def test_capacity_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(table(spark), PATH, capacity=1000)
