"""Duplicates, conflicts and unpivots. Groups of copies are summed, never gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.scalars import score_from_result
from tallyboard.operators.joins import join_back


def dedupe_or_conflict(
    df: DataFrame, keys: Sequence[str], fingerprint: str = "fingerprint", ordinal: str = "ordinal"
) -> DataFrame:
    """``status`` of each row: accepted (first of its id), duplicate, or conflict.

    The first row of every id is found by an aggregation on narrow columns, which
    combines before the shuffle; ``join_back`` spreads the copies of a hot id.
    """
    first = df.groupBy(*keys).agg(
        F.min(ordinal).alias("_first"),
        F.min_by(fingerprint, ordinal).alias("_fp"),
        F.count("*").alias("_n"),
    )
    status = (
        F.when(F.col(ordinal) == F.col("_first"), "accepted")
        .when(F.col(fingerprint) == F.col("_fp"), "duplicate")
        .otherwise("conflict")
    )
    return join_back(df, first, keys, "_n").withColumn("status", status).drop("_first", "_fp")


def withhold_conflicts(
    df: DataFrame, keys: Sequence[str], fingerprint: str = "fingerprint", ordinal: str = "ordinal"
) -> DataFrame:
    """As above, but an id with two fingerprints loses all its copies."""
    group = df.groupBy(*keys).agg(
        F.min(ordinal).alias("_first"),
        (F.min(fingerprint) != F.max(fingerprint)).alias("_conflict"),
        F.count("*").alias("_n"),
    )
    status = (
        F.when(F.col("_conflict"), "conflict")
        .when(F.col(ordinal) == F.col("_first"), "accepted")
        .otherwise("duplicate")
    )
    kept = join_back(df, group, keys, "_n").withColumn("status", status)
    return kept.drop("_first", "_conflict")


def status_totals(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of counts by status that adds up to ``seen``."""
    return df.agg(
        F.count("*").alias("seen"),
        *[F.count_if(F.col("status") == n).alias(n) for n in names],
    )


def unpivot_colors(index: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Two rows per completed, rated pair: color, own and opponent rating, own score."""

    def side(color: str, other: str):
        return F.struct(
            F.lit(color).alias("color"),
            F.col(f"{color}_rating").alias("rating"),
            F.col(f"{other}_rating").alias("opponent_rating"),
            score_from_result("result", F.lit(color)).alias("score"),
        )

    both = index.where(F.col("white_rating").isNotNull() & F.col("black_rating").isNotNull())
    return both.select(*keep, F.inline(F.array(side("white", "black"), side("black", "white"))))


def cross_source_conflicts(
    rows: DataFrame, metadata: Sequence[str], keys: Sequence[str] = ("provider", "game_id")
) -> DataFrame:
    """Ids whose metadata differ between sources, with the number of versions."""
    versions = rows.groupBy(*keys).agg(F.count_distinct(F.struct(*metadata)).alias("versions"))
    return versions.where(F.col("versions") > 1)


def dedupe_by_rank(
    rows: DataFrame, keys: Sequence[str] = ("provider", "game_id"), rank: str = "source_rank"
) -> DataFrame:
    """The row of the lowest source rank per id: narrow keys are summed, then joined back."""
    winners = rows.groupBy(*keys).agg(F.min(rank).alias("_best"), F.count("*").alias("_n"))
    return join_back(rows, winners, keys, "_n").where(F.col(rank) == F.col("_best")).drop("_best")
