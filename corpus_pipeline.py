"""A training corpus from ``documents``: reject low quality, keep one of each
group of near-duplicates, replace personal data, mix the sources to their
target weights and pack the tokens into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from platewise.llm import mixing, packing, pii, quality_model, registry, simhash
from platewise.session import materialize, scratch_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more (null and empty texts
    score as the model's bias says)."""
    model = quality_model.fit(docs, registry.table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model, threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicate texts.

    Texts alone make the groups: rows that repeat an id stay apart unless
    their texts are near-duplicates.  A row without an id stays only where no
    row with one is near it.
    """
    scratch_dir(spark)
    nulls = [F.col(c).isNull() for c in docs.columns]  # a hash leaves nulls out
    keyed = docs.select("doc_id", "text", F.xxhash64(*docs.columns, *nulls).alias("h"),
                        F.struct(*docs.columns).alias("row"))
    fps = simhash.fingerprints(keyed, "doc_id", "text", 4, "h")
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")).checkpoint()
    groups = simhash.component_ids(first.select("fp", F.col("fp").alias("rep")), max_distance=4)
    keep = first.join(groups, "fp").groupBy("component_id").agg(F.min("first").alias("first"))
    keep = keep.select(F.col("first.doc_id").alias("keep_id"), F.col("first.h").alias("keep_h"))
    one = (keyed.join(keep, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")), "left_semi")
           .groupBy("doc_id", "h").agg(F.first("row").alias("row")))  # equal rows
    return one.select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts; n_chars counts the new text."""
    done = pii.pseudonymise_rows(docs, registry.PII_KEY)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    cut = mixing.thresholds(mixing.sizes(docs), weights=(3, 1, 2), share=1.5, most=2)
    return mixing.mixed_rows(docs, cut)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mix_sources", mixed),
    ("packing", packed),
]

#: SQL can't express the learned classifier, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
