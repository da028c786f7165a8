"""Small tables with every awkward case, and access to the driver's tables."""

import re

from pyspark.sql import functions as F

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards boil magic potions near "
         "an old stone bridge and nobody knows why the river sings at night under silver clouds")
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))


def rows():
    """(doc_id, text, lang, source, n_chars): nulls in every column, empty and
    blank texts, exact and repeated rows, unusual white space, a long text."""
    return [
        (1, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10),
        (3, PROSE.replace("magic", "strange"), "en", None, None), (4, None, None, None, None),
        (5, "", "en", "b", 0), (6, " \t\n\x0b\f\r ", "en", "b", 7), (None, PROSE, "en", "b", 3),
        (None, None, None, None, None), (7, "one two", "de", "Z", 7), (8, LONG, "en", "a", len(LONG)),
        (9, "a b c\x1cd é ÀÉ 東京 " + PROSE, "fr", "é", 1), (10, "Ü", "de", "b", 1),
        (11, PROSE + " " + PROSE, "en", "c", 5)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    names = ["fp", "rep", "block", "size", "hash", "times", "taken", "key", "row", "f", "y", "h", "score",
             "component_id", "sequence_id", "n_words", "target", "words", "bucket", "ids", "kept", "v", "list",
             "asks", "host", "rule", "verdict", "found", "s", "below", "threshold", "node", "root"]
    return df.select("*", *[F.lit(f"extra {n}").alias(n) for n in names if n not in df.columns])


def words(text):
    return WORD.findall(text or "")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check_clashes(operator, df):
    """Extra columns change nothing."""
    assert result(operator(clashing(df))) == result(operator(df))
