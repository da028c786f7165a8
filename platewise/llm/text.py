"""Helpers on texts that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Fixed value: a word is a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column.

    ``bytes.split()`` cuts these at exactly the characters that ``WORD``
    excludes, and ``bytes.lower()`` changes A-Z only.
    """
    return column.cast(pa.binary()).to_pylist()


def word_count(text: Column) -> Column:
    """Number of words (0 for null) as a JVM expression."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
