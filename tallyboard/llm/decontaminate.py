"""Benchmark decontamination by spaced seeds.

A mask says which words of a window count. Both masks of ``MASKS`` are slid over test items
and training texts; equal hashes of the words that count are hits. With at most TOLERATED
of WINDOW neighbouring words substituted, one of the masks still fits. Around each hit the
item is laid on the text and compared word by word: an item is found where WINDOW of its
neighbouring words, TOLERATED substitutions allowed, stand in the text. Items of 5 to
WINDOW - 1 words must stand in it whole and unchanged; shorter ones are left out, since
chance alone repeats them.

Words are in lower case and cut at white space. Null and empty texts are clean. Repeated
rows each get the same answer, and items of equal text are each reported. Null doc_ids and
item_ids are allowed: such rows are reported under null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.shared import stage_table, table
from tallyboard.llm.words import hash_array, windows, word_array

MASKS = ["11101011", "110100111"]
SHORT_MASK = "11111"
WINDOW = 13
TOLERATED = 2
#: Rows of seeds that may be broadcast (about 40 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(masks: list[str]):
    """(mask number, place, hash) of all windows of the hash column ``h``."""
    parts = [
        F.transform(windows(F.col("h"), offsets(m), tag), lambda v, i: F.struct(i.alias("at"), v.alias("seed")))
        for tag, m in enumerate(masks)
    ]
    return F.explode(F.concat(*parts) if len(parts) > 1 else parts[0])


def hashed(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).cast("long").alias(name), hash_array(word_array(F.col("text"))).alias("h"))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_equal, at``: items found in texts, each pair once.

    ``n_equal`` is the largest number of equal words in a window of the item, ``at`` the
    word of the text at which the item begins there (the smallest such place).
    """
    tests = stage_table(hashed(items, "item_id").where(F.size("h") >= len(SHORT_MASK)), "items")
    # Only short items need the third mask.
    masks = MASKS + ([SHORT_MASK] if not tests.where(F.size("h") < WINDOW).isEmpty() else [])
    seeds = stage_table(
        tests.select("item_id", _seeds(masks).alias("s")).select("s.seed", "item_id", F.col("s.at").alias("item_at")), "seeds"
    )
    small = seeds.count() <= BROADCAST_ROWS
    texts = hashed(docs, "doc_id")
    places = texts.select("doc_id", _seeds(masks).alias("s")).select("s.seed", "doc_id", "s.at")
    hits = places.join(F.broadcast(seeds) if small else seeds, "seed").select(
        "doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")
    ).distinct()
    hits = stage_table(hits, "hits")
    # Texts are read again for the documents with hits only.
    laid = hits.join(tests.select(F.col("item_id").alias("_i"), F.col("h").alias("ih")), F.expr("item_id <=> _i")).drop("_i")
    wanted = laid.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "ih")).alias("laid"))
    own = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(
        wanted.hint("shuffle_hash"), F.expr("doc_id <=> _d")
    ).select("doc_id", hash_array(word_array(F.col("text"))).alias("h"), "laid").select(
        "doc_id", "h", F.explode("laid").alias("l")
    ).select("doc_id", "h", "l.item_id", "l.shift", "l.ih")
    equal = F.transform("ih", lambda w, j: F.coalesce((F.get(F.col("h"), F.col("shift") + j) == w).cast("int"), F.lit(0)))
    marked = own.select("doc_id", "item_id", "shift", equal.alias("e"))
    width = F.least(F.lit(WINDOW), F.size("e"))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("e") - width + 1),
        lambda s: F.aggregate(F.slice("e", s, width), F.lit(0), lambda total, v: total + v),
    ))
    need = F.when(F.size("e") >= WINDOW, F.lit(WINDOW - TOLERATED)).otherwise(F.size("e"))
    found = marked.select("doc_id", "item_id", "shift", best.alias("n_equal"), need.alias("need")).where("n_equal >= need")
    top = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("shift")).alias("back"))).alias("t"))
    return top.select("doc_id", "item_id", F.col("t.n_equal").cast("long").alias("n_equal"), (-F.col("t.back")).cast("long").alias("at"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
