"""Quality classifier on supervised subword embeddings.

A text is the bag of its words and of the byte n-grams of its words joined by
single spaces, each hashed to a row of an embedding table.  The rows are
averaged over the text and a softmax layer gives the probability of label 1;
table and layer are learned together by stochastic gradient descent in numpy.
As the layer is linear in the average, a trained model scores a text as the
mean of one number for each feature, so scoring is one table look-up for each
word and n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .text import utf8

BUCKET_BITS = 18
NGRAMS = (2, 3, 4)
DIM = 16
#: Bound of the training sample: labelled documents.  A text counts whole: it is at most one count for
#: each of the 2 ** BUCKET_BITS features.
TRAIN_ROWS = 6000
#: Passes over the sample, more of them where it is small.
EPOCHS, MIN_STEPS, RATE, SEED = 5, 8000, 10.0, 7

# Odd multipliers of the feature hashes.
_MULTIPLY, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _MULTIPLY, np.uint64), dtype=np.uint64)


def features(text: bytes | None) -> Iterator[np.ndarray]:
    """Hashed features of a text: its words, the places where a word follows
    itself, then its n-grams of each length."""
    words = (text or b"").split()
    if not words:
        return
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    shift = np.uint64(64 - BUCKET_BITS)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths
    in_word = np.arange(len(joined)) - np.repeat(np.append(0, starts), np.append(1, lengths + 1))
    weighted = (joined + np.uint64(1)) * _POWERS[in_word % len(_POWERS)]
    word = np.add.reduceat(weighted, starts) * _SPREAD
    yield (word >> shift).astype(np.int32)
    # a word that repeats the one before it, whichever word that is, is one feature
    yield np.zeros(np.count_nonzero(word[1:] == word[:-1]), np.int32)
    h = joined.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(joined) < n:
            return
        h = h[:-1] * _MULTIPLY + joined[n - 1:]
        if n in NGRAMS:
            yield (((h + np.uint64(n)) * _SPREAD) >> shift).astype(np.int32)


def held_out(doc_id) -> F.Column:
    """Rows never trained on: CRC-32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """``weights[f]`` is feature f's share of the logit; ``bias`` the rest."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes | None) -> float:
        total, n = 0.0, 0
        for f in features(text):
            total += float(self.weights[f].sum(dtype=np.float64))
            n += len(f)
        return float(1 / (1 + np.exp(-(self.bias + (total / n if n else 0.0)))))


def counted(text: bytes | None) -> np.ndarray:
    """A text's features, each once, with their numbers: feature << 32 | times."""
    ids, times = np.unique(np.concatenate([np.empty(0, np.int32), *features(text)]), return_counts=True)
    return ids.astype(np.int64) << 32 | times


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, min_steps: int = MIN_STEPS,
          rate: float = RATE, dim: int = DIM, seed: int = SEED) -> Model:
    """Fit on (counted features, label 0 or 1).  No rows: every score is 0.5."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    table = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-min_steps // max(1, len(rows))))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f, y = rows[k]
            ids, times = f >> 32, f & 0xFFFFFFFF
            share = (times / max(1, times.sum())).astype(np.float32)
            mean = share @ table[ids]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # gradient of the softmax's log loss
            lr = np.float32(rate * (1 - step / steps))
            back = p @ layer
            layer -= lr * np.outer(p, mean)
            bias -= lr * np.float32(0.1) * p
            table[ids] -= (lr * share)[:, None] * back
            step += 1
    return Model((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled documents (the first by the
    hash of their id) that are not held out.  Labels other than 0 and 1 and
    rows without an id are left out; an id with both labels counts as 0, one
    with several texts as one of them."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("y").alias("y")))
    # at most train_rows ids, so the broadcast is bounded
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    # of rows that repeat an id one is taken before anything leaves the tasks
    joined = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
              .join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"),
                                     F.first("y").alias("y")).select("doc_id", "text", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [zstandard.compress(counted(t).tobytes(), 1) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())],
                                             names=["doc_id", "y", "f"])

    rows = joined.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, y int, f binary")
    # sorted, so that the order of tasks makes no difference
    found = sorted((r["doc_id"], r["y"], bytes(r["f"])) for r in rows.toLocalIterator())
    texts = [(np.frombuffer(zstandard.decompress(f), np.int64), y) for _, y, f in found]
    return train([(f, y) for f, y in texts if len(f)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from the text alone.
    Null and empty texts get the model's bias as their score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
              .mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(b.schema.get_field_index(text_col)))
            yield b.filter(pa.array([model.score(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
