"""Small helpers of the text operators: tables, shared tables, Arrow batches, word hashes."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.session import materialize

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reach(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies; elsewhere ship it to them
    (``--py-files``)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, survives the loss of executors, and lets Spark drop the shuffle
    files of the job that made it.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def text_of(df: DataFrame, text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text array with about ``limit`` bytes each; at least one row each."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    first, n = 0, len(texts)
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield first, last
        first = last


def splitmix(x: np.ndarray) -> np.ndarray:
    """The published SplitMix64 finalizer: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation.
PUNCTUATION = _WHITE | np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))
with np.errstate(over="ignore"):
    _BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the base of the hashes, from the 0th on."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(texts: pa.Array, between: np.ndarray = _WHITE, head: int = 0):
    """64-bit hashes of the words of all texts, and where each text's words begin.

    A-Z count as a-z; words are the runs of bytes other than those marked in ``between``
    (space and 0x09-0x0D by default). Text i owns ``hashes[bounds[i]:bounds[i + 1]]``. A
    null text has no words. With ``head``, hashes of the first ``head`` bytes of each word
    come third.
    """
    found = _hash_words(texts, between, head)
    return found if head else found[:2]


def _hash_words(texts: pa.Array, between: np.ndarray, head: int):
    joined = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    none = np.zeros(0, np.uint64), np.zeros(len(joined) + 1, np.int64), np.zeros(0, np.uint64)
    if high == low:
        return none
    raw = np.frombuffer(data, np.uint8)[low:high]
    offsets = offsets - low
    white = between[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[offsets] = True
    begins = ~white
    begins[1:] &= white[:-1] | fresh[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    inside = np.flatnonzero(~white)
    # Where each word begins among the bytes that are in words.
    at = np.cumsum(~white)[starts] - 1
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        parts = _BYTE[_LOWER[raw[inside]]] * powers(int(lengths.max()) + 1)[place]
        hashes = splitmix(np.add.reduceat(parts, at) + lengths.astype(np.uint64))
        heads = splitmix(np.add.reduceat(np.where(place < head, parts, 0), at)) if head else none[2]
    return hashes, np.searchsorted(starts, offsets).astype(np.int64), heads


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            total = total * _BASE + words[j : len(words) - k + 1 + j]
        return splitmix(total + np.uint64(k))
