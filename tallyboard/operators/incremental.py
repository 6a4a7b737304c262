"""Batch increments to stored tables, and proof that they equal a full rebuild."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.session import materialize


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def new_rows(target: DataFrame, batch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Batch rows whose key is not stored. A null key is not stored, and does not hide others."""
    keys = _keys(key)
    return batch.join(target.select(*keys), keys, "left_anti")


def append_new(target_path: str, batch: DataFrame, key: str | Sequence[str]) -> None:
    """Append the new rows to the stored table; a second run appends nothing.

    The rows are computed from the files present now and added as further files.
    """
    target = batch.sparkSession.read.parquet(target_path)
    new_rows(target, batch, key).write.mode("append").parquet(target_path)


def write_by_key(df: DataFrame, table: str, path: str, by: str, buckets: int, mode: str = "error") -> DataFrame:
    """Store ``df`` in ``buckets`` files by the hash of ``by``, as an external table.

    Tables stored by the same column and number of buckets are joined on keys that include
    that column without moving either; rows are dealt to their bucket once, when written.
    An appended part adds a file to each bucket it has rows of.
    """
    writer = df.repartition(buckets, by).write.mode(mode).bucketBy(buckets, by)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def append_delta(
    table: str, path: str, batch: DataFrame, key: str | Sequence[str], build: Callable[[DataFrame], DataFrame], by: str, buckets: int
) -> int:
    """Append what ``build`` makes of the batch rows whose key is not stored; their number.

    The new rows are written first: where there are none, nothing else is read, and where
    they are few, what ``build`` joins them with is read with them at hand.
    """
    spark = batch.sparkSession
    fresh = materialize(new_rows(spark.table(table), batch, key), "fresh")
    count = fresh.count()
    if count:
        write_by_key(build(fresh), table, path, by, buckets, "append")
    return count


def upsert(target: DataFrame, batch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Stored rows without the batch's keys, and the batch. To be written to a new path."""
    keys = _keys(key)
    return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def append_after(batch: DataFrame, ordinal: str, loaded_through: int) -> DataFrame:
    """Only rows beyond the cutoff that the caller keeps; the filter reaches the scan."""
    return batch.where(F.col(ordinal) > loaded_through)


def write_days(df: DataFrame, path: str, day: str) -> None:
    """Rows are dealt by day first, so a day has few files; a large day is split again."""
    df.hint("rebalance", day).write.mode("errorifexists").partitionBy(day).parquet(path)


def replace_days(batch: DataFrame, path: str, day: str) -> None:
    """Replace exactly the days the batch holds; other days keep their files."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        day
    ).parquet(path)


def content_checksum(df: DataFrame) -> DataFrame:
    """Row count and order-free digest sums of a table's content.

    Two 60-bit parts of each row's SHA-256 are summed exactly, so equal tables agree
    however they are partitioned and a changed, lost or repeated row shows. A row is
    written as its column names and values, each with its length before it; a null is a
    bare mark that no length can be.
    """

    def part(name: str):
        value = F.col(name).cast("string")
        held = F.concat(F.length(value).cast("string"), F.lit(":"), value)
        return F.concat(F.lit(f"{len(name)}:{name}="), F.coalesce(held, F.lit("-")))

    row = F.concat(*[part(c) for c in sorted(df.columns)])
    digest = F.sha2(row, 256)

    def total(start: int):
        part = F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0)).cast("string")

    return df.agg(
        F.count("*").alias("rows"), total(1).alias("digest_a"), total(16).alias("digest_b")
    )


def verify_equivalence(incremental: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row: both row counts and whether count and digests agree."""
    a = content_checksum(incremental).select(F.struct("*").alias("s")).withColumn("k", F.lit("i"))
    b = content_checksum(rebuilt).select(F.struct("*").alias("s")).withColumn("k", F.lit("r"))
    return (
        a.unionByName(b)
        .agg(
            F.max(F.when(F.col("k") == "i", F.col("s.rows"))).alias("incremental_rows"),
            F.max(F.when(F.col("k") == "r", F.col("s.rows"))).alias("rebuilt_rows"),
            (F.min("s") == F.max("s")).alias("equal"),
        )
    )

