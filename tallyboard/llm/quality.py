"""Quality by importance resampling.

Two generative models over hashed words and word pairs are counted, one on target texts and
one on all texts. A document's importance is the log ratio of the two; adding Gumbel noise
and keeping the largest keys draws documents without replacement in proportion to it.

Null and empty texts have no features and importance 0. Noise depends on doc_id, text and
seed alone, so equal rows get equal keys. Rows tied at the last place are all kept. Columns
other than doc_id and text are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.shared import passes, splitmix, stage_table, table, word_hashes

BUCKETS = 10_000
BASE = np.uint64(0xD1342543DE82EF95)
BINS = 4096


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and neighbouring pairs, and the text each belongs to."""
    words, bounds = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    with np.errstate(over="ignore"):
        pairs = splitmix(words[:-1] * BASE + words[1:]) if len(words) else words
    same = owner[:-1] == owner[1:]
    buckets = np.concatenate([words, pairs[same]]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def count_features(df: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of ``df``; at most BUCKETS rows are collected."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in passes(texts):
                counts += np.bincount(features(texts.slice(a, b - a))[0], minlength=BUCKETS)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(there), "n": pa.array(counts[there])})

    out = np.zeros(BUCKETS, np.int64)
    found = df.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in found.collect():
        out[row["bucket"]] = row["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket, the log of the smoothed target share over the smoothed raw share."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weigh(df: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """``doc_id, n_features, log_weight, sample_key`` of each row."""
    shared = df.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches):
        own = shared.value
        for batch in batches:
            texts, docs = batch.column(1), batch.column(0)
            for a, b in passes(texts):
                part = texts.slice(a, b - a)
                buckets, owner = features(part)
                weight = np.bincount(owner, own[buckets], minlength=b - a)
                ids = docs.slice(a, b - a)
                lengths = np.array([len(t) if t else 0 for t in part.to_pylist()], np.uint64)
                with np.errstate(over="ignore"):
                    mixed = splitmix(ids.fill_null(-1).to_numpy().astype(np.int64).view(np.uint64) * BASE + lengths)
                    mixed = splitmix(mixed + np.uint64(seed))
                uniform = (mixed >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids,
                    "n_features": pa.array(np.bincount(owner, minlength=b - a)),
                    "log_weight": pa.array(weight.astype(np.float64)),
                    "sample_key": pa.array(weight - np.log(-np.log(uniform))),
                })

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_features long, log_weight double, sample_key double")


def kth_largest(df: DataFrame, value: str, k: int) -> float:
    """The k-th largest number of a column, exactly.

    Each round counts the values in BINS equal bins and goes on in the bin with the k-th;
    when few values or one are left they are ordered. No row limit changes the answer.
    """
    if k <= 0:
        return math.inf
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return -math.inf
    inside = df.select(value)
    while low < high:
        width = (high - low) / BINS
        index = F.least(F.lit(BINS - 1), F.floor((F.col(value) - low) / width)).cast("int")
        rows = inside.groupBy(index.alias("bin")).agg(
            F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        ).collect()
        for row in sorted(rows, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        if (row["low"], row["high"]) == (low, high):
            break
        low, high = row["low"], row["high"]
        inside = inside.where(F.col(value).between(low, high))
        if row["n"] <= 10_000:
            return sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]
    return high


def resample(df: DataFrame, target: DataFrame, share: float = 0.8, seed: int = 0) -> DataFrame:
    """``weigh`` with ``selected``: the ``share`` of rows that the draw keeps."""
    weighed = stage_table(weigh(df, log_ratio(count_features(target), count_features(df)), seed), "weights")
    least = kth_largest(weighed, "sample_key", math.ceil(share * weighed.count()))
    return weighed.withColumn("selected", F.col("sample_key") >= F.lit(least))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed; the target texts are those labelled as good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    target = docs.join(good.hint("shuffle_hash"), "doc_id", "left_semi")
    return resample(docs, target)
