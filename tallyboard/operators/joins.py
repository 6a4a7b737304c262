"""Joins of facts, and comparisons of two results. Broadcast choices are left to AQE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.scalars import LOSS_CAP, clamp, surrogate_key
from tallyboard.operators.filters import game_eligibility, staged_games

KEYS = ["provider", "game_id"]
HOT_ROWS = 1_000_000
SALTS = 4096


def _hashable(kind: T.DataType) -> bool:
    """Whether a value of this type has a hash: maps, and what holds one, have none."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def join_back(
    df: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    count: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every row the summary of its key, where a key may hold most of the rows.

    ``summary`` has one row per key of ``df`` and, in ``count``, at least the number of
    its rows. Keys beyond ``hot_rows`` are broadcast: there are at most rows / hot_rows
    of them. Their rows are salted, so that the shuffle that serves the other keys
    spreads them; the other side has no row under those salts. Null keys match nothing.
    """
    keys = list(keys)
    values = [c for c in summary.columns if c not in keys and c != count]
    hot = summary.where(F.col(count) > hot_rows).select(
        *keys, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    cold = summary.select(
        *keys,
        F.when(F.col(count) > hot_rows, -1).otherwise(0).cast("bigint").alias("_salt"),
        F.lit(True).alias("_cold"),
        *[F.col(v).alias(f"_cold_{v}") for v in values],
    )
    # Equal copies differ by the task that reads them; both parts are the same on a retry.
    digest = F.xxhash64(*[F.col(f.name) for f in df.schema if _hashable(f.dataType)])
    spread = F.pmod(digest.bitwiseXOR(F.spark_partition_id().cast("bigint")), F.lit(SALTS)) + 1
    marked = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)).cast("bigint")
    )
    joined = marked.join(cold, [*keys, "_salt"], "left")
    return joined.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull()).select(
        *df.columns,
        *[
            F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v)
            for v in values
        ],
    )


def player_outcomes(players: DataFrame, games: DataFrame) -> DataFrame:
    """Player rows with their game's context and win, draw and loss flags.

    Tables that both hold ``game_key`` are joined by it, as they may be stored by it.
    """
    keys = ["game_key"] if "game_key" in players.columns and "game_key" in games.columns else KEYS
    g = game_eligibility(games).select(
        *keys, "utc_date", "base_seconds", "increment_seconds", "metric_eligible"
    )

    def flag(value: float) -> Column:
        return F.when(F.col("score") == value, 1).otherwise(0).cast("bigint")

    return players.join(g, keys).withColumns(
        {"win": flag(1.0), "draw": flag(0.5), "loss": flag(0.0)}
    )


def move_evals(moves: DataFrame, games: DataFrame, cap: int = LOSS_CAP) -> DataFrame:
    """Every move with its game's date and family, keys and the clamped loss."""
    g = staged_games(games).select(*KEYS, "utc_date", "opening_family")
    before, after = F.col("eval_before_cp_white"), F.col("eval_after_cp_white")
    return moves.join(g, KEYS, "left").select(
        *KEYS,
        "ply",
        surrogate_key("provider", "game_id", "ply").alias("move_key"),
        surrogate_key("provider", "game_id").alias("game_key"),
        "color",
        "utc_date",
        "opening_family",
        "clock_bucket",
        "phase_proxy",
        "centipawn_deterioration",
        (before.isNotNull() & after.isNotNull()).alias("evaluable"),
        "error_proxy",
        clamp("centipawn_deterioration", before, after, cap).alias("clamped_deterioration"),
    )


def move_context(moves: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """Moves with their game and with the row of the player who moved."""
    mover = players.select(*KEYS, "color", "player_key", "rating", "opponent_rating")
    return moves.join(games, KEYS).join(mover, [*KEYS, "color"])


def pivot_colors(players: DataFrame, values: Sequence[str] = ("rating",)) -> DataFrame:
    """White and black values on one row per game that has both, from one aggregation."""
    aggs = [
        F.max(F.when(F.col("color") == color, F.col(v))).alias(f"{color}_{v}")
        for color in ("white", "black")
        for v in values
    ]
    both = (F.count_if(F.col("color") == "white") > 0) & (F.count_if(F.col("color") == "black") > 0)
    return players.groupBy(*KEYS).agg(*aggs, both.alias("_both")).where("_both").drop("_both")


def rating_asymmetries(players: DataFrame) -> DataFrame:
    """Games whose two rows disagree about each other's rating."""
    wide = pivot_colors(players, ("rating", "opponent_rating"))
    return wide.where(
        ~F.col("white_rating").eqNullSafe(F.col("black_opponent_rating"))
        | ~F.col("black_rating").eqNullSafe(F.col("white_opponent_rating"))
    )


def orphans(players: DataFrame, games: DataFrame) -> DataFrame:
    return players.join(games.select(*KEYS), KEYS, "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is in the other set, each once."""
    return df.join(ids.select(column), column, "left_semi")


def attach_rank(df: DataFrame, ranks: DataFrame, column: str, rank: str = "rank") -> DataFrame:
    return df.join(ranks.select(column, rank), column)


def cumulative_union(visits: DataFrame, ranks: DataFrame, column: str, k: int) -> DataFrame:
    """For each n up to ``k``: games with any id of rank at most n, by direct counting.

    A game's distinct ranks are found first; each is then spread over n = rank..k, at
    most ``k`` copies, and the games counted per n. This does not use the first-hit
    argument of ``coverage_curve`` and so checks it.
    """
    hits = attach_rank(visits, ranks, column).select("provider", "game_id", "rank").distinct()
    spread = hits.select(
        "provider", "game_id", F.explode(F.sequence(F.col("rank"), F.lit(k))).alias("n")
    )
    return spread.groupBy("n").agg(
        F.count_distinct(F.struct("provider", "game_id")).alias("games")
    )


def join_bounds(df: DataFrame, keys: Sequence[str], date: str = "utc_date") -> DataFrame:
    """First and last date of each cohort and period, on every row of it."""
    return join_back(df, date_bounds_by(df, keys, date), keys, "_n")


def date_bounds_by(df: DataFrame, keys: Sequence[str], date: str = "utc_date") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(date).alias("period_start"),
        F.max(date).alias("period_end"),
        F.count("*").alias("_n"),
    )


def reconcile_scalar(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with two one-row totals and whether they differ, null equal to null."""
    both = left.toDF("v").withColumn("side", F.lit("l")).unionByName(
        right.toDF("v").withColumn("side", F.lit("r"))
    )
    wide = both.agg(
        F.max(F.when(F.col("side") == "l", F.col("v"))).alias("left_value"),
        F.max(F.when(F.col("side") == "r", F.col("v"))).alias("right_value"),
    )
    return wide.withColumn(
        "differs", ~F.col("left_value").eqNullSafe(F.col("right_value"))
    )


def diff_results(
    baseline: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = ("suite", "case_id"),
    passed: str = "passed",
    failures: str = "failures",
    path: str = "path",
    version: str = "version",
) -> DataFrame:
    """Every difference of two result sets: added, removed, changed, path, version drift."""
    keys = list(keys)
    cols = [passed, failures, path, version]
    b = baseline.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_b"))
    c = current.select(*keys, *[F.col(x).alias(f"_c_{x}") for x in cols], F.lit(1).alias("_c"))
    joined = b.join(c, keys, "full_outer")
    present = F.col("_b").isNotNull() & F.col("_c").isNotNull()

    def changed(name: str) -> Column:
        return ~F.col(f"_b_{name}").eqNullSafe(F.col(f"_c_{name}"))

    improved = F.coalesce(~F.col(f"_b_{passed}") & F.col(f"_c_{passed}"), F.lit(False))
    outcome = F.when(
        present & (changed(passed) | changed(failures)),
        F.when(improved, "IMPROVEMENT").otherwise("REGRESSION"),
    )
    labels = F.array_compact(
        F.array(
            F.when(F.col("_b").isNull(), "ADDED").when(F.col("_c").isNull(), "REMOVED"),
            outcome,
            F.when(present & changed(path), "PATH-CHANGED"),
        )
    )
    rows = joined.select(
        *keys,
        F.explode(labels).alias("label"),
        F.col(f"_b_{passed}").alias("expected_passed"),
        F.col(f"_c_{passed}").alias("got_passed"),
    )
    # One row per suite that exists on both sides under different versions.
    suite = keys[0]
    vb = baseline.groupBy(suite).agg(F.max(version).alias("_vb"))
    vc = current.groupBy(suite).agg(F.max(version).alias("_vc"))
    drift = (
        vb.join(vc, suite)
        .where(~F.col("_vb").eqNullSafe(F.col("_vc")))
        .select(
            suite,
            *[F.lit("version").alias(k) for k in keys[1:]],
            F.lit("REGRESSION").alias("label"),
            F.lit(None).cast("boolean").alias("expected_passed"),
            F.lit(None).cast("boolean").alias("got_passed"),
        )
    )
    return rows.withColumns({k: F.col(k).cast("string") for k in keys}).unionByName(
        drift.withColumns({k: F.col(k).cast("string") for k in keys})
    )


def prediction_join_issues(predictions: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Counts of missing, unexpected and duplicate ids; all zero means the join is sound."""
    p = predictions.groupBy(key).agg(F.count("*").alias("_p"))
    t = truth.groupBy(key).agg(F.count("*").alias("_t"))
    return p.join(t, key, "full_outer").agg(
        F.count_if(F.col("_p").isNull()).alias("missing"),
        F.count_if(F.col("_t").isNull()).alias("unexpected"),
        F.count_if((F.col("_p") > 1) | (F.col("_t") > 1)).alias("duplicated"),
    )


def score_predictions_join(
    predictions: DataFrame, truth: DataFrame, key: str = "id"
) -> DataFrame:
    """Predictions with their truth; any missing, unexpected or duplicate id raises."""
    issues = prediction_join_issues(predictions, truth, key).first()
    if any(issues):
        raise ValueError(f"predictions do not match the cases: {issues.asDict()}")
    return predictions.join(truth, key)
