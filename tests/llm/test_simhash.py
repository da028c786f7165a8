import random

import numpy as np
import pytest
import xxhash

from platewise.llm import simhash
from tests_llm_helpers import SF001, check_clashes, result, table, words


def plain_fingerprint(text, n):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance):
    """By all pairs."""
    root = {i: i for i in ids if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [(i, f) for i, f in zip(ids, fps) if i is not None]
    for a, f in known:
        for b, g in known:
            if (f ^ g).bit_count() <= distance:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    by_fp = {}
    for i, f in known:
        by_fp[f] = min(by_fp.get(f, find(i)), find(i))
    return [by_fp.get(f) if i is None else find(i) for i, f in zip(ids, fps)]


def check(spark, data, shingle=4, distance=4):
    got = simhash.near_duplicates(table(spark, data), shingle=shingle, max_distance=distance)
    fps = [plain_fingerprint(r[1], shingle) for r in data]
    want = [(r[0], f - (1 << 64) if f >> 63 else f, c)
            for r, f, c in zip(data, fps, plain_components([r[0] for r in data], fps, distance))]
    assert result(got) == sorted(want, key=repr)


def test_edge_cases(spark):
    from tests_llm_helpers import rows
    check(spark, rows())


@pytest.mark.parametrize("shingle,distance", [(4, 4), (2, 1), (1, 6)])
def test_sample_against_all_pairs(spark, shingle, distance):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    check(spark, [tuple(r) for r in docs.collect()], shingle, distance)


def test_empty_table_and_clashing_columns(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []
    check_clashes(simhash.near_duplicates, table(spark))


def ball(n, spread, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("chunk", [64, 4096])
def test_hot_buckets_are_cut_into_chunks(spark, monkeypatch, chunk):
    """Near copies that share buckets, with and without several chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    values = ball(900, 7, 3)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)],
                                  "fp long, rep long")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4)).collect()}
    want = plain_components(range(len(values)), values, 4)
    assert [got.get(i, i) for i in range(len(values))] == want


def test_index_prunes_and_links_like_all_pairs():
    v = np.array(ball(700, 6, 5), np.uint64)
    order = np.argsort(simhash.gray_rank(v), kind="stable")
    v = v[order]
    labels = simhash.GrayIndex(v).link(v, None, 4)
    want = plain_components(range(len(v)), [int(x) for x in v], 4)
    assert labels.tolist() == want


def test_links_of_the_driver_s_documents_come_from_the_index():
    """Every link of 10,000 documents is found by descending the indexes of
    all choices of blocks, which look at few of the pairs."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    fp = np.array(sorted({simhash.fingerprint((t or "").encode(), 4) for t in texts}), np.uint64)
    rows, seen = np.arange(len(fp)), 0
    labels = np.arange(len(fp))
    for must in simhash.choices(4):
        order = simhash.gray_order(fp, must)
        index = simhash.GrayIndex(fp[order])
        found = index.link(fp[order], None, 4, must)
        seen += index.visited
        simhash._join_groups(labels, order, order[found])
    want, pairs = np.arange(len(fp)), 0
    for at in range(0, len(fp), 500):
        a, b = np.nonzero(np.bitwise_count(fp[at:at + 500, None] ^ fp[None]) <= 4)
        keep = rows[at + a] < b
        pairs += keep.sum()
        simhash._join_groups(want, at + a[keep], b[keep])
    assert (labels == want).all() and pairs > 0
    assert seen < len(fp) ** 2 / 2 / 2


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
