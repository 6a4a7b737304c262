"""Stages of the corpus pipeline: ``(spark, docs, sf_dir)`` to the documents kept.

All but the last return the columns of their input. Null and empty texts are kept by every
stage; rows are never dropped for their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tallyboard.llm.shared import reach, stage_table, table


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM drop the plans, generated classes and shuffles of the jobs that
    the stages before have ended; a pipeline runs hundreds of them in one session."""
    spark._jvm.System.gc()


def free_name(base: str, taken) -> str:
    return next(n for n in (base + "_" * i for i in range(99)) if n not in taken)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on those at hand."""
    reach(spark)
    settle(spark)
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = [free_name(base, docs.columns) for base in ("score", "toxic")]
    return toxicity.score(docs, net, tuple(names)).where(f"`{names[1]}` = 0").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that loses all its lines goes."""
    settle(spark)
    # Columns that have the names of the operator's own numbers go along under other names.
    aside = {c: free_name(c + "_", docs.columns) for c in line_dedup.ADDED if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(aside))
    kept = out.where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop(*line_dedup.ADDED).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of doc_id, null or not, and text, and the name of its column."""
    name = free_name("row_key", docs.columns)
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")), name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-copies one row stays, that with the smallest doc_id.

    Null doc_ids come last. Rows of one doc_id with different texts are told apart, equal
    ones stay once; rows without words all stay.
    """
    reach(spark)
    settle(spark)
    rows, key = keyed(docs)
    found = jaccard_join.near_components(rows.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0")
    sizes = found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", key)
    ids = rows.select(key, F.col("doc_id").cast("long").alias("id")).distinct()
    named = stage_table(sizes.join(ids, key), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", key)).alias("t")).select(F.col(f"t.{key}").alias(key))
    gone = named.join(first, key, "left_anti").select(key)
    twice = stage_table(named.where("n > 1").join(first, key, "left_semi").select(key), "twice")
    kept = rows.join(gone, key, "left_anti")
    once = kept.join(twice, key, "left_semi").dropDuplicates([key])
    return kept.join(twice, key, "left_anti").unionByName(once).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    settle(spark)
    rows, key = keyed(docs)
    found = decontaminate.find_leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document with its ids and the digests of ids and bytes."""
    import public_tokenizers

    reach(spark)
    settle(spark)
    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.round_trip(docs, vocabulary)
    return coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": byte_bpe.ids_digest()})
