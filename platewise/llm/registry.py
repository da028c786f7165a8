"""The operators applied to the driver's tables, with production parameters.

Every query takes ``(spark, sf_dir)``, reads a whole table and returns the
operator's full result; the digest columns are derived from its output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (conversations, decontamination, mixing, packing, pii, quality_model, quality_rules, repeats, simhash,
               token_counts, url_filter, vector_search, whitening)
from .sql import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark, sf_dir):
    """4-word shingles, links at 4 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


@query
def op2_mix_sources(spark, sf_dir):
    """Weights 3, 1, 2, 150 % of all words, at most two copies."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.drop("rejected_by")


@query
def op10_url_filters(spark, sf_dir):
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: A production key comes from the caller's key store; the driver's tables are synthetic.
PII_KEY = b"synthetic tables"


@query
def op4_pii_pseudonyms(spark, sf_dir):
    found = pii.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"))


@query
def op8_harmonic_packing(spark, sf_dir):
    """Sequences of 2048 byte-level BPE ids, each document closed by id 1."""
    packed = packing.pack(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query
def op9_substring_dedup(spark, sf_dir):
    """Windows of 13 words."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_token_counts(spark, sf_dir):
    """Unigram segmentation with the pieces of a 32k vocabulary."""
    vocabulary = token_counts.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


@query
def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, threshold=0.3)


@query
def op7_adaptive_vector_search(spark, sf_dir):
    """5 nearest of every vector whose id is divisible by 50."""
    return vector_search.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query
def op11_embedding_whitening(spark, sf_dir):
    """Up to 4 components."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return found.withColumnRenamed("id", "vec_id")


@query
def op12_benchmark_decontamination(spark, sf_dir):
    """Windows of 10 words of the benchmark's items."""
    found = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                          window=10)
    hit = decontamination.hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


@query
def op13_conversation_repair(spark, sf_dir):
    """Damaged conversations: their faults, cheapest edits and what these make of them."""
    rows = table(spark, sf_dir, "conversations")
    fixed = conversations.Repair(conversations.damaged(rows))
    found = fixed.audits.join(fixed.digests().withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    ids = rows.select("conv_id").distinct()
    every = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline  # it builds on this module

    return corpus_pipeline.run(spark, sf_dir)
