"""Aggregate grains of the cube, with small cells suppressed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.scalars import blank_to_null, completed, family, month_period, rating_band
from tallyboard.operators.dedupe import unpivot_colors
from tallyboard.operators.filters import eligible, suppress_small
from tallyboard.operators.joins import date_bounds_by
from tallyboard.operators.metrics import KEYS, clock_rows
from tallyboard.session import materialize

MIN_CELL = 10


def _period() -> list[Column]:
    period, start, end = month_period("utc_date")
    return [period.alias("period"), start.alias("period_start"), end.alias("period_end")]


def game_cells(games: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Month, control and family: games and mean plies of standard games."""
    rows = games.where(eligible() & (F.lower("variant") == "standard"))
    cells = rows.groupBy(
        *_period(), "time_control", family("source_opening").alias("opening_family")
    ).agg(F.count("*").alias("games"), F.avg("ply_count").alias("mean_ply"))
    return suppress_small(cells, minimum)


def _outcomes() -> list[Column]:
    return [
        F.count("*").alias("games"),
        F.count_if(F.col("score") == 1).alias("wins"),
        F.count_if(F.col("score") == 0.5).alias("draws"),
        F.count_if(F.col("score") == 0).alias("losses"),
        F.avg(F.col("rating") - F.col("opponent_rating")).alias("rating_diff"),
        F.avg("ply_count").alias("mean_ply"),
    ]


def result_cells(
    players: DataFrame, games: DataFrame, *, lines: bool = False, minimum: int = MIN_CELL
) -> DataFrame:
    """Month, control, color, rating band and family (and line): outcomes and means."""
    g = games.where(eligible()).select(
        *KEYS,
        "utc_date",
        "time_control",
        "ply_count",
        family("source_opening").alias("opening_family"),
        blank_to_null("source_opening").alias("opening_line"),
    )
    rows = players.where(
        F.col("rating").isNotNull() & F.col("opponent_rating").isNotNull()
    ).join(g, KEYS)
    by = ["time_control", "color", rating_band("rating").alias("rating_band"), "opening_family"]
    if lines:
        rows = rows.where(F.col("opening_line").isNotNull())
        by.append("opening_line")
    return suppress_small(rows.groupBy(*_period(), *by).agg(*_outcomes()), minimum)


def clock_cells(
    moves: DataFrame, games: DataFrame, players: DataFrame, minimum: int = MIN_CELL
) -> DataFrame:
    """Bucket, control, phase, band, color and family: moves, errors, distinct games, dates.

    Moves are summed per game first, so distinct games are then a plain count and a hot
    cell travels as one row per game.
    """
    rows = clock_rows(moves, games).where(F.col("clock_bucket").isNotNull())
    rated = players.where(F.col("rating").isNotNull()).select(
        *KEYS, "color", rating_band("rating").alias("rating_band")
    )
    by = ["clock_bucket", "time_control", "phase_proxy", "rating_band", "color", "opening_family"]
    per_game = (
        rows.withColumn("opening_family", family("source_opening"))
        .join(rated, [*KEYS, "color"])
        .groupBy("game_id", *by)
        .agg(
            F.count("*").alias("moves"),
            F.count("centipawn_deterioration").alias("evaluable_moves"),
            F.count_if(F.coalesce("error_proxy", F.lit(False))).alias("proxy_errors"),
            F.min("utc_date").alias("period_start"),
            F.max("utc_date").alias("period_end"),
        )
    )
    cells = per_game.groupBy(*by).agg(
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
        *[F.sum(c).alias(c) for c in ("moves", "evaluable_moves", "proxy_errors")],
        F.count("*").alias("games"),
    )
    return (
        suppress_small(cells, minimum)
        .withColumnRenamed("clock_bucket", "clock_band")
        .withColumnRenamed("phase_proxy", "phase")
        .withColumn(
            "error_proxy_rate",
            F.try_divide(F.col("proxy_errors").cast("double"), F.col("evaluable_moves")),
        )
    )


def _with_bounds(cells: DataFrame, index: DataFrame, minimum: int) -> DataFrame:
    """Kept cells with the first and last date of their cohort and period."""
    bounds = date_bounds_by(index, ["source_cohort", "source_period"]).drop("_n")
    return (
        suppress_small(cells, minimum)
        .join(bounds, ["source_cohort", "source_period"])
        .withColumnRenamed("source_period", "period")
        .withColumnRenamed("source_cohort", "cohort")
    )


def source_game_cells(index: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Period, cohort, control and family of the multi-source index."""
    rows = index.where(eligible())
    cells = rows.groupBy(
        "source_period",
        "source_cohort",
        "time_control",
        family("source_opening").alias("opening_family"),
    ).agg(F.count("*").alias("games"), F.avg("ply_count").alias("mean_ply"))
    return _with_bounds(cells, rows, minimum)


def source_result_cells(index: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """The same with color and rating band, from the white and black columns."""
    rows = index.where(eligible())
    keep = ["source_period", "source_cohort", "time_control", "ply_count", "source_opening"]
    cells = (
        unpivot_colors(rows, keep)
        .groupBy(
            "source_period",
            "source_cohort",
            "time_control",
            "color",
            rating_band("rating").alias("rating_band"),
            family("source_opening").alias("opening_family"),
        )
        .agg(*_outcomes())
    )
    return _with_bounds(cells, rows, minimum)


def clock_game_rows(moves: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """One row per game, mover color and clock band of eligible zero-increment games."""
    from tallyboard.operators.joins import pivot_colors

    g = games.where(completed("result") & ~F.col("marked_bot") & (F.col("increment_seconds") == 0))
    bands = (
        moves.where(F.col("clock_bucket").isNotNull())
        .select(*KEYS, "color", F.col("clock_bucket").alias("clock_band"))
        .distinct()
    )
    ratings = pivot_colors(players)
    own = F.when(F.col("color") == "white", F.col("white_rating")).otherwise(F.col("black_rating"))
    line = blank_to_null("source_opening")
    return (
        bands.join(
            g.select(*KEYS, "utc_date", "time_control", "result", "source_opening", "source_eco"),
            KEYS,
        )
        .join(ratings, KEYS)
        .where(own.isNotNull() & F.col("utc_date").isNotNull())
        .select(
            F.col("game_id").alias("game_key"),
            F.col("utc_date").alias("period_start"),
            F.col("utc_date").alias("period_end"),
            "time_control",
            "color",
            rating_band(own).alias("rating_band"),
            family(line).alias("opening_family"),
            line.alias("opening_line"),
            blank_to_null("source_eco").alias("eco"),
            "clock_band",
            "result",
            "white_rating",
            "black_rating",
        )
    )


def opening_cells(visits: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """All grains of earliest visits from one pass over them, in the cube's columns.

    ``opening_family`` (share of all games), ``opening_position``, ``opening_line`` and
    ``opening_continuation`` (share of the position's games), and, of positions that keep at
    least two lines, ``transposition`` and ``transposition_route``. A position is one of a
    family. Cells below ``minimum`` games are left out before anything is made of them. A
    game's first visit stands at ply 1 and counts for its family.
    """
    null = F.lit(None).cast("string")

    def cell(grain: str, fen=null, line=null, move=null):
        return F.struct(F.lit(grain).alias("grain"), fen.alias("fen"), line.alias("opening_line"), move.alias("continuation"))

    fen, route = F.col("position_key"), F.col("route")
    move = F.nullif(F.col("next_move"), F.lit(""))
    cells = F.array(
        F.when(F.col("ply") == 1, cell("opening_family")),
        cell("opening_position", fen),
        F.when(~F.col("route_has_repeat"), cell("opening_line", fen, route)),
        F.when(move.isNotNull(), cell("opening_continuation", fen, null, move)),
    )
    spread = visits.select("opening_family", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c"))
    kept = suppress_small(
        spread.groupBy("opening_family", "c.grain", "c.fen", "c.opening_line", "c.continuation").agg(F.count("*").alias("games")), minimum
    )
    # What is left is a cube: its cells are read more than once, the visits are not.
    kept = materialize(kept, "opening-cells")
    all_games = visits.where(F.col("ply") == 1).agg(F.count("*")).scalar()
    at = kept.where("grain = 'opening_position'").select("opening_family", "fen", F.col("games").alias("here"))
    lines = kept.where("grain = 'opening_line'").withColumn("ply", F.size(F.split("opening_line", " ")))
    own = lines.join(at, ["opening_family", "fen"]).withColumn("share", F.col("games") / F.col("here"))
    turned = own.groupBy("opening_family", "fen").agg(F.count("*").alias("ply"), F.max("here").alias("games")).where("ply >= 2")
    parts = [
        kept.where("grain = 'opening_family'").withColumn("share", F.col("games") / all_games),
        kept.where("grain = 'opening_position'"),
        own.drop("here"),
        kept.where("grain = 'opening_continuation'").join(at, ["opening_family", "fen"]).withColumn("share", F.col("games") / F.col("here")).drop("here"),
        turned.withColumn("grain", F.lit("transposition")),
        own.join(turned.select("opening_family", "fen"), ["opening_family", "fen"], "left_semi").drop("here").withColumn("grain", F.lit("transposition_route")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def month_cells(training: DataFrame) -> DataFrame:
    """``corpus_month``: the games of each source with its first and last date."""
    return training.groupBy(F.col("source_cohort").alias("cohort"), F.col("source_period").alias("period")).agg(
        F.count("*").alias("games"), F.min("utc_date").alias("period_start"), F.max("utc_date").alias("period_end")
    ).withColumn("grain", F.lit("corpus_month"))


def color_scores(players: DataFrame, games: DataFrame, families: Sequence[str], control: str, minimum: int = MIN_CELL) -> DataFrame:
    """``color_score``: outcomes of families by color and rating band under one control."""
    rows = players.join(games.where(eligible() & (F.col("time_control") == control)).select(*KEYS, "time_control", "source_opening", "utc_date"), KEYS)
    own = rows.select("time_control", "color", rating_band("rating").alias("rating_band"), family("source_opening").alias("opening_family"), "score", "utc_date")
    cells = own.where(F.col("opening_family").isin(*families) & F.col("rating_band").isNotNull()).groupBy(
        "time_control", "color", "rating_band", "opening_family"
    ).agg(
        F.count("*").alias("games"), F.count_if(F.col("score") == 1).alias("wins"), F.count_if(F.col("score") == 0.5).alias("draws"),
        F.count_if(F.col("score") == 0).alias("losses"), F.min("utc_date").alias("period_start"), F.max("utc_date").alias("period_end"),
    )
    share = (F.col("wins") + F.col("draws") * 0.5) / F.col("games")
    return suppress_small(cells, minimum).withColumns({"share": share, "grain": F.lit("color_score")})
