"""Eligibility flags, cohort filters and small-cell suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.scalars import completed, family, route_contains_all, surrogate_key


def eligible(prefix: str = "") -> Column:
    """Completed and not marked as a bot game."""
    return completed(f"{prefix}result") & ~F.col(f"{prefix}marked_bot")


def staged_games(games: DataFrame) -> DataFrame:
    """Games with their key, computed where they do not hold it, and family."""
    if "game_key" not in games.columns:
        games = games.withColumn("game_key", surrogate_key("provider", "game_id"))
    return games.withColumn("opening_family", family("source_opening"))


def game_eligibility(games: DataFrame) -> DataFrame:
    return games.withColumn("metric_eligible", eligible()).withColumn(
        "drawn", F.col("result") == "1/2-1/2"
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def game_flags(games: DataFrame) -> DataFrame:
    """0/1 flags that metrics sum: eligible, drawn, known and unknown family."""
    g = game_eligibility(staged_games(games))
    ok = F.col("rated") & (F.col("variant") == "Standard") & F.col("metric_eligible")
    return g.withColumns(
        {
            "eligible_game": _flag(ok),
            "drawn_game": _flag(ok & F.col("drawn")),
            "known_opening_game": _flag(ok & F.col("opening_family").isNotNull()),
            "unknown_opening_game": _flag(ok & F.col("opening_family").isNull()),
        }
    )


def player_flags(players: DataFrame, games: DataFrame) -> DataFrame:
    """Player rows with game context and eligible score, win, draw and loss.

    Tables that both hold ``game_key`` are joined by it, as they may be stored by it.
    """
    keys = ["game_key"] if "game_key" in players.columns and "game_key" in games.columns else ["provider", "game_id"]
    g = game_eligibility(staged_games(games)).select(
        "provider",
        "game_id",
        "game_key",
        "rated",
        "variant",
        "metric_eligible",
        "utc_date",
        "base_seconds",
        "increment_seconds",
        "opening_family",
    )
    g = g.drop("provider", "game_id") if keys == ["game_key"] else g
    joined = players.join(g, keys).withColumn(
        "player_game_key", surrogate_key("provider", "game_id", "color")
    )
    ok = (
        F.col("rated")
        & (F.col("variant") == "Standard")
        & F.col("metric_eligible")
        & F.col("rating").isNotNull()
        & F.col("opening_family").isNotNull()
    )
    flagged = joined.withColumn("score_eligible", _flag(ok))
    on = F.col("score_eligible") == 1
    return flagged.withColumns(
        {
            "eligible_score": F.when(on, F.col("score")).otherwise(F.lit(0.0)),
            "eligible_win": _flag(on & (F.col("score") == 1)),
            "eligible_draw": _flag(on & (F.col("score") == 0.5)),
            "eligible_loss": _flag(on & (F.col("score") == 0)),
        }
    ).select(
        "player_game_key",
        "game_key",
        "color",
        "player_key",
        "rating",
        "score",
        "utc_date",
        "base_seconds",
        "increment_seconds",
        "opening_family",
        "score_eligible",
        "eligible_score",
        "eligible_win",
        "eligible_draw",
        "eligible_loss",
    )


def cohort_filter(
    df: DataFrame,
    *,
    color: str,
    rating_min: int,
    rating_max_exclusive: int,
    base_seconds: int,
    increment_seconds: int,
    family_column: str | None = None,
    families: Sequence[str] = (),
) -> DataFrame:
    """One exact cohort with a half-open rating range; bad arguments raise."""
    numbers = (rating_min, rating_max_exclusive, base_seconds, increment_seconds)
    if any(type(n) is not int for n in numbers):
        raise ValueError("integer filters required")
    if color not in ("white", "black"):
        raise ValueError("color is white or black")
    if not 0 <= rating_min < rating_max_exclusive <= 4000:
        raise ValueError("invalid half-open rating range")
    if base_seconds < 0 or increment_seconds < 0:
        raise ValueError("invalid time control")
    if any(not isinstance(f, str) or not 1 <= len(f) <= 80 for f in families):
        raise ValueError("invalid family")
    out = df.where(
        (F.col("color") == color)
        & (F.col("rating") >= rating_min)
        & (F.col("rating") < rating_max_exclusive)
        & (F.col("base_seconds") == base_seconds)
        & (F.col("increment_seconds") == increment_seconds)
    )
    return out.where(F.col(family_column).isin(*families)) if family_column else out


def training_policy(
    index: DataFrame,
    *,
    minimum_rating: int = 1000,
    minimum_plies: int = 20,
    excluded_periods: Sequence[str] = ("2013-01",),
    elite_cohort: str = "elite_reference",
    elite_low: int = 2300,
    elite_high: int = 2500,
    elite_barred_event: str = "bullet",
) -> DataFrame:
    """Games fit for training: rating floors, no bots, completed, long enough, elite rule."""
    w, b = F.col("white_rating"), F.col("black_rating")
    elite = (
        (F.least(w, b) >= elite_low)
        & (F.greatest(w, b) >= elite_high)
        & ~F.col("source_event").ilike(f"%{elite_barred_event}%")
    )
    return index.where(
        (w >= minimum_rating)
        & (b >= minimum_rating)
        & ~F.col("marked_bot")
        & (F.col("result") != "*")
        & (F.col("ply_count") >= minimum_plies)
        & ~F.col("source_period").isin(*excluded_periods)
        & ((F.col("source_cohort") != elite_cohort) | elite)
    )


def lens_games(visits: DataFrame, first: str, moves: Sequence[str], ply: int = 20) -> DataFrame:
    """Games that reach ``ply``, the last of the window, with a route there that starts with
    ``first`` and has all moves. Shorter games are left out."""
    ends = visits.where(F.col("ply") == ply)
    hit = ends.where(route_contains_all("route", first, moves))
    return hit.select("provider", "game_id").distinct()


def cascade_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reason"):
    """Each row's first failing rule, or ``included``. ``rules`` are (name, excluded) pairs."""
    out = None
    for reason, excluded in rules:
        bad = F.coalesce(excluded, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return df.withColumn(name, out.otherwise("included"))


def cascade_filter(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows per first failing rule; the counts add up to all rows, absent rules give 0."""
    counts = cascade_reason(df, rules)
    exprs = [
        F.struct(F.lit(r).alias("reason"), F.count_if(F.col("reason") == r).alias("rows"))
        for r in [*[name for name, _ in rules], "included"]
    ]
    return counts.agg(F.array(*exprs).alias("_a")).select(F.inline("_a"))


def suppress_small(cells: DataFrame, minimum: int = 10, by: str = "games") -> DataFrame:
    """Drop cells below the floor; ``by`` is games, or distinct games where moves are counted."""
    return cells.where(F.col(by) >= minimum)


def rebase_shares(
    cells: DataFrame, keys: Sequence[str], by: str = "games", name: str = "share"
) -> DataFrame:
    """Shares over the cells that are kept, per key."""
    if not keys:
        total = cells.agg(F.sum(by)).scalar()
        return cells.withColumn(name, F.try_divide(F.col(by).cast("double"), total))
    totals = cells.groupBy(*keys).agg(F.sum(by).alias("_t"))
    return (
        cells.join(totals, list(keys))
        .withColumn(name, F.try_divide(F.col(by).cast("double"), F.col("_t")))
        .drop("_t")
    )
