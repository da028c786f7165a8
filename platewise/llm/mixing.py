"""Mixing sources to target weights by hash-threshold histograms.

DataFrame functions only.  A source's target is met by whole passes over its
documents and one partial pass, which takes the documents whose hash lies
below a threshold.  The threshold comes from histograms: words are summed by
source and hash bucket, the bucket in which the sum crosses the budget is cut
into finer buckets, and so on; only that bucket's documents are looked at
again.  Nothing is sorted but the histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .text import word_count

#: The hash has LEVELS digits of LEVEL_BITS bits.
LEVEL_BITS, LEVELS = 10, 3
BUCKETS = 1 << LEVEL_BITS


def document_hash(doc_id: Column) -> Column:
    """30 bits from the MD5 of the id as text; equal ids (and null ids among
    themselves) have equal hashes, so they are taken together."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.shiftrightunsigned(F.conv(hexed, 16, 10).cast("long"), 32 - LEVEL_BITS * LEVELS)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with column ``target``.

    Sources in code-point order, null last, weigh ``weights``, repeating.
    They share ``share`` times all words by weight; a target stops at
    ``most`` times its source's words and the excess is dealt to the others,
    so in the end the uncapped ones get one rate times their weight.  Capped
    are the sources with the smallest capacity per weight: the rate that is
    left after the first k of them rises until it fits the next one.
    """
    # one row for each source
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, rest = (by_ratio.rowsBetween(W.unboundedPreceding, -1),
                    by_ratio.rowsBetween(0, W.unboundedFollowing))
    budget = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    s = s.withColumn("rate", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(rest))
    s = s.withColumn("fits", F.col("rate") * F.col("w") <= F.col("cap"))
    rate = F.max(F.when(F.col("fits"), F.col("rate"))).over(W.partitionBy())
    # the first rate that fits is the final one, and the largest of those that do
    return s.select("source", "source_size",
                    F.when(rate.isNull(), F.col("cap")).otherwise(
                        F.least("cap", rate * F.col("w"))).alias("target"))


def _step(found: DataFrame, level: int) -> DataFrame:
    """From (source, bucket, words) with the budget and the words below: per
    source the bucket in which the budget is reached, and the words below it."""
    upto = W.partitionBy("source").orderBy("bucket")
    run = found.withColumn("upto", F.col("below") + F.sum("words").over(upto))
    at = run.where("upto >= budget").groupBy("source").agg(F.min_by(
        F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "words"), "bucket").alias("x"))
    return at.select("source", F.col("x.bucket").alias(f"b{level}"), F.col("x.below").alias("below"),
                     F.col("x.words").alias("words"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, hash) for every row, as a written table: texts
    are read once."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"))
    return materialize(sized.withColumn("hash", document_hash(F.col("doc_id"))), "mix-sizes")


def thresholds(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
               most: int = 2) -> DataFrame:
    """(source, source_size, target, passes, threshold), one row for each
    source of ``sizes``: its documents are taken ``passes`` times, and those
    whose hash is below ``threshold`` once more."""
    top = sized.groupBy("source", F.shiftright("hash", LEVEL_BITS * (LEVELS - 1)).alias("bucket")).agg(
        F.sum("size").alias("words"))
    top = materialize(top, "mix-histogram")
    goal = targets(top.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("passes", F.least(passes, F.lit(most)).cast("int"))
    goal = goal.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    # a table of one row for each source: Spark broadcasts it while it is small
    plan = materialize(goal.withColumn("below", F.lit(0).cast("long")), "mix-targets")
    found = top.join(plan, _same(top, plan)).select(top["source"], "bucket", "words", "budget", "below")
    edge = materialize(_step(found.where("budget > 0"), 0), "mix-edge")
    for level in range(1, LEVELS):
        prefix = F.shiftright(sized["hash"], LEVEL_BITS * (LEVELS - level))
        inside = sized.join(edge, _same(sized, edge) & (prefix == edge[f"b{level - 1}"])).select(
            sized["source"], F.shiftright("hash", LEVEL_BITS * (LEVELS - level - 1)).alias("bucket"),
            "size", "below")
        finer = inside.groupBy("source", "bucket", "below").agg(F.sum("size").alias("words"))
        finer = finer.join(plan.select(F.col("source").alias("s"), "budget"),
                           F.col("source").eqNullSafe(F.col("s")))
        edge = materialize(_step(finer.select("source", "bucket", "words", "budget", "below"), level),
                           "mix-edge")
    last = f"b{LEVELS - 1}"
    cut = plan.join(edge.withColumnsRenamed({"source": "s", "below": "under"}),
                    plan["source"].eqNullSafe(F.col("s")), "left")
    # with or without the bucket at the edge, whichever comes nearer
    with_edge = F.col("under") + F.col("words") - F.col("budget") <= F.col("budget") - F.col("under")
    return materialize(cut.select(
        "source", "source_size", "target", "passes",
        F.coalesce(F.col(last) + F.when(with_edge, 1).otherwise(0), F.lit(0)).alias("threshold")),
        "mix-thresholds")


def with_times(docs: DataFrame, cut: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row: the columns of ``docs``, times, source_size, target) for every row
    whose source is in ``cut``.  Only ``cut`` is joined, so texts don't move
    while it is small enough for Spark to broadcast."""
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"),
                       document_hash(F.col(id_col)).alias("hash"))
    times = F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return rows.join(cut, _same(rows, cut)).select("row", times.alias("times"), "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) for every row.

    ``taken`` is ``times`` (0 to ``most``) whole copies of the document's
    ``size`` words.  Each source's taken words differ from its target by at
    most half of the words whose 30-bit hash is that of the threshold: about
    half a document.  Null and empty texts have size 0.  A null source is a
    source of its own, and a null id hashes like an empty one.  Sources
    without words get target 0.  Rows that repeat an id are taken together.
    """
    sized = sizes(docs, id_col, text_col, source_col)
    cut = thresholds(sized, weights, share, most)
    return with_times(sized.drop("hash"), cut).select(
        "row.*", "source_size", "target", "times", (F.col("row.size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, cut: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = with_times(docs, cut, id_col, source_col).where("times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
