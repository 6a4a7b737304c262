"""Document fingerprints as threshold-scaled sketches.

A sketch keeps every hash of a run of five words that lies below a fixed fraction of the
hash space. Sketches of parts can be united, and their intersections estimate how much of
one document another contains, however unequal the two are. A text of fewer than five words
has one run, all its words; null and empty texts have an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.shared import stage_table, table
from tallyboard.llm.words import hash_array, windows, word_array

WORDS = 5
#: One hash in 2**SCALE_BITS is kept.
SCALE_BITS = 2


def sketch(hashes: Column) -> Column:
    """The sorted kept hashes (32 bits of each) over a plain column of word hashes."""
    whole = F.when(
        F.size(hashes) >= WORDS, windows(hashes, list(range(WORDS)))
    ).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    kept = F.filter(whole, lambda v: F.shiftrightunsigned(v, 64 - SCALE_BITS) == 0)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda v: F.shiftrightunsigned(v, 32 - SCALE_BITS))))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sketch of the column ``text`` under ``name``."""
    return df.withColumn("_h", hash_array(word_array(F.col(text)))).withColumn(name, sketch(F.col("_h"))).drop("_h")


def united(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated share of common runs; null where both sketches are empty."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total > 0, common / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the runs of ``a`` that ``b`` has; null where ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(own: Column) -> Column:
    """Eight lowercase hexadecimal digits for each kept hash, ascending."""
    return F.array_join(F.transform(own, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def next_ids(df: DataFrame) -> DataFrame:
    """``doc_id, next_id``: each distinct doc_id and the one after it; the first after the last.

    Ids are dealt into ranges; the end of a range continues with the first id of the next,
    a table with one row for each range. Null ids are left out.
    """
    ids = df.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    dealt = stage_table(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(every)).alias("after"))
    inner = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.withColumn("in_part", inner).join(F.broadcast(after), "part").select(  # one row per range
        "doc_id", F.coalesce("in_part", "after").alias("next_id")
    )


def compare_edited(df: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; see :func:`op9`.

    Of several rows with one doc_id the smallest text stands as the next document. A row
    with a null doc_id has no next one: its last quarter is replaced by nothing and
    ``near_next`` is 0. Where two sketches are empty, likeness is 1 for equal texts, else 0.
    """
    # A cast that changes nothing would give the two reads of the texts different plans.
    doc_id = F.col("doc_id") if dict(df.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = df.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    # Both joins read the same rows dealt by doc_id, so the texts are shuffled once.
    known = docs.where("doc_id is not null")
    sizes = known.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    before = next_ids(docs).join(sizes, "doc_id").select(
        F.col("doc_id").alias("prev"), F.col("next_id").alias("doc_id"), F.floor(F.col("n") / 4).cast("int").alias("need")
    )
    heads = with_sketch(known.join(before.hint("shuffle_hash"), "doc_id"), "text", "s").select(
        F.col("prev").alias("doc_id"), F.struct(
            F.xxhash64("text").alias("own"), F.expr("left(text, need)").alias("head"), "s"
        ).alias("next")
    )
    nexts = heads.groupBy("doc_id").agg(F.min(F.struct("next.head", "next.own", "next.s")).alias("next"))
    nameless = docs.where("doc_id is null").withColumn("next", F.lit(None).cast(nexts.schema["next"].dataType))
    joined = known.join(nexts.hint("shuffle_hash"), "doc_id", "left").unionByName(nameless).withColumn("n_chars", F.length("text"))
    edited = joined.withColumn("edited", F.concat(
        F.expr("left(text, n_chars - n_chars div 4)"), F.coalesce(F.expr("left(next.head, cast(n_chars div 4 as int))"), F.lit(""))
    ))
    both = with_sketch(with_sketch(edited, "text", "own"), "edited", "other")
    same = (F.col("text") == F.col("edited")).cast("double")
    same_next = F.coalesce((F.xxhash64("text") == F.col("next.own")).cast("double"), F.lit(0.0))
    return both.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        F.coalesce(jaccard(F.col("own"), F.col("other")), same).alias("near_edited"),
        F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(
            F.coalesce(jaccard(F.col("own"), F.col("next.s")), same_next)).alias("near_next"),
        F.coalesce(containment(F.col("own"), F.col("other")), same).alias("in_edited"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
