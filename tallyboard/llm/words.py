"""Words and word hashes as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_array(text: Column) -> Column:
    """The words of a text in lower case, cut at white space; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def hash_array(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(hashes: Column, offsets: list[int], tag: int = 0) -> Column:
    """Hashes of the elements at ``i + offset`` for every i at which all of them exist.

    ``hashes`` should be a plain column: it is read again for every element.
    """
    last = F.size(hashes) - max(offsets) - 1
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(tag), *(F.get(hashes, i + o) for o in offsets)))
