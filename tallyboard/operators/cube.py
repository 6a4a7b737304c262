"""Reading the cube: filters by stored dimensions, fallbacks, KPIs and lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.scalars import hash_order
from tallyboard.operators.windows import prior_equal_period, top_n_per_group

DIMENSIONS = ("color", "opening_family", "time_control", "rating_band")
# A band that also matches a published sub-band.
RATING_SUBSET = {"1200_1599": "1400_1599"}


@dataclass(frozen=True)
class Filters:
    start: dt.date
    end: dt.date
    time_control: str | None = None
    color: str | None = None
    rating_band: str | None = None
    opening_family: str | None = None

    def set_dimensions(self) -> dict[str, str]:
        return {d: v for d in DIMENSIONS if (v := getattr(self, d))}


def carried_dimensions(cube: DataFrame, grain: str) -> set[str]:
    """Dimensions the grain stores at all, from one aggregation over it."""
    row = (
        cube.where(F.col("grain") == grain)
        .agg(*[(F.count(d) > 0).alias(d) for d in DIMENSIONS])
        .first()
    )
    return {d for d in DIMENSIONS if row[d]}


def _match(dimension: str, value: str, subset: dict[str, str]) -> Column:
    if dimension == "rating_band" and value in subset:
        return F.col(dimension).isin(value, subset[value])
    return F.col(dimension) == value


def adaptive_filter(
    cube: DataFrame,
    grain: str,
    filters: Filters,
    *,
    dates: bool = True,
    subset: dict[str, str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Rows of the grain under the filters it can apply, and the names of those it cannot."""
    asked = filters.set_dimensions()
    have = carried_dimensions(cube, grain) if asked else set()
    rows = cube.where(F.col("grain") == grain)
    if dates:
        rows = rows.where(
            (F.col("period_start") >= F.lit(filters.start))
            & (F.col("period_end") <= F.lit(filters.end))
        )
    for d, value in asked.items():
        if d in have:
            rows = rows.where(_match(d, value, subset or RATING_SUBSET))
    return rows, [d for d in DIMENSIONS if d in asked and d not in have]


def collect_with_fallback(
    cube: DataFrame, grain: str, filters: Filters, *, force_color: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Finest rows in the date window, else undated rows, else none; with notes.

    The notes name the filters the grain lacks, ``date`` when the window was dropped,
    and ``empty`` when an applied filter matches nothing.
    """
    active = replace(filters, color=force_color) if force_color else filters
    notes = ["white"] if force_color and filters.color is None else []
    undated, missing = adaptive_filter(cube, grain, active, dates=False)
    notes += missing
    inside = (F.col("period_start") >= F.lit(active.start)) & (
        F.col("period_end") <= F.lit(active.end)
    )
    counts = undated.agg(F.count("*").alias("all"), F.count_if(inside).alias("dated")).first()
    if counts["dated"]:
        return undated.where(inside), notes
    if counts["all"]:
        return undated, [*notes, "date"]
    if set(active.set_dimensions()) - set(missing):
        notes.append("empty")
    return undated.where(F.lit(False)), notes


def clock_rows_with_fallback(
    cube: DataFrame, grain: str, filters: Filters
) -> tuple[DataFrame, bool, list[str]]:
    """(rows of a clock grain, True where they lie outside the asked dates, filters left unmet).

    Where the asked dates hold no row of the grain, color and family are set aside and all
    dates are looked through. A time control or rating band that the grain never has leaves
    no rows.
    """
    have = carried_dimensions(cube, grain)
    g = cube.where(F.col("grain") == grain)
    strict = [d for d in ("time_control", "rating_band") if getattr(filters, d) and d in have]
    rows, _ = adaptive_filter(cube, grain, filters)
    wide, _ = adaptive_filter(
        cube, grain, replace(filters, color=None, opening_family=None), dates=False
    )
    facts = g.agg(
        F.min("period_start").alias("first"),
        F.max("period_end").alias("last"),
        *[
            F.count_if(_match(d, getattr(filters, d), RATING_SUBSET)).alias(f"n_{d}")
            for d in strict
        ],
    ).first()
    nothing = g.where(F.lit(False))
    absent = [d for d in strict if not facts[f"n_{d}"]]
    if absent:
        return nothing, False, absent
    if not rows.isEmpty():
        return rows, False, []
    covered = facts["first"] is not None and (
        filters.start <= facts["first"] and filters.end >= facts["last"]
    )
    if covered or wide.isEmpty():
        return nothing, False, strict
    return wide, True, []


def weighted_mean(value: str, weight: str = "games") -> Column:
    """Weighted by games, over rows that have the value."""
    has = F.col(value).isNotNull() & (F.col(weight) > 0)
    top = F.sum(F.when(has, F.col(value) * F.col(weight)))
    return F.try_divide(top, F.sum(F.when(has, F.col(weight))))


def kpis(
    cube: DataFrame,
    filters: Filters,
    *,
    game_grain: str = "game_cell",
    result_grain: str = "result_cell",
    clock_grain: str = "clock_cell",
    position_grain: str = "opening_position",
) -> DataFrame:
    """Cards as rows (name, numerator, denominator, value), from additive cells only."""
    games, _ = collect_with_fallback(cube, game_grain, filters)
    results, _ = collect_with_fallback(
        cube, result_grain, filters, force_color=filters.color or "white"
    )
    clock, _, _ = clock_rows_with_fallback(cube, clock_grain, filters)
    positions, _ = adaptive_filter(cube, position_grain, filters)

    def card(name: str, top: Column, bottom: Column | None, value: Column) -> Column:
        below = F.lit(None) if bottom is None else bottom
        return F.struct(
            F.lit(name).alias("card"),
            top.cast("double").alias("numerator"),
            below.cast("double").alias("denominator"),
            value.cast("double").alias("value"),
        )

    def share(name: str, count: str) -> Column:
        top, bottom = F.sum(count), F.sum("games")
        return card(name, top, bottom, F.try_divide(top.cast("double"), bottom))

    def unfold(df: DataFrame, *cards: Column) -> DataFrame:
        return df.agg(F.array(*cards).alias("_c")).select(F.inline("_c"))

    total = F.coalesce(F.sum("games"), F.lit(0))
    errors, evaluable = F.sum("proxy_errors"), F.sum("evaluable_moves")
    n_positions = F.count_distinct("fen")
    return (
        unfold(
            games,
            card("games", total, None, total),
            card("mean_ply", total, None, weighted_mean("mean_ply")),
        )
        .unionByName(
            unfold(
                results,
                share("win_rate", "wins"),
                share("loss_rate", "losses"),
                share("draw_rate", "draws"),
                card("rating_difference", F.sum("games"), None, weighted_mean("rating_diff")),
            )
        )
        .unionByName(
            unfold(
                clock,
                card(
                    "clock_error",
                    errors,
                    evaluable,
                    F.try_divide(errors.cast("double"), evaluable),
                ),
            )
        )
        .unionByName(unfold(positions, card("positions", n_positions, None, n_positions)))
    )


def period_bars(cube: DataFrame, grain: str, filters: Filters) -> DataFrame:
    rows, _ = adaptive_filter(cube, grain, filters)
    return rows.groupBy("period").agg(F.sum("games").alias("games"))


def games_delta(cube: DataFrame, grain: str, filters: Filters, selected: Sequence[str]) -> DataFrame:
    """Games of the selected months against the equal block before them."""
    rows, _ = adaptive_filter(cube, grain, filters, dates=False)
    known = rows.withColumn("cohort", F.coalesce("cohort", F.lit("warehouse")))
    return prior_equal_period(known, selected, [], ["games"])


def rate_deltas(
    cube: DataFrame,
    grain: str,
    filters: Filters,
    selected: Sequence[str],
    counts: Sequence[str] = ("wins", "losses", "draws"),
    means: Sequence[str] = ("mean_ply", "rating_diff"),
) -> DataFrame:
    """Rates and weighted means of the selected months, and their change from the block before.

    A change is the difference of the two figures as shown: percents and means with one
    decimal. It is null where the blocks cannot be compared.
    """
    rows, _ = adaptive_filter(cube, grain, filters, dates=False)
    known = rows.withColumn("cohort", F.coalesce("cohort", F.lit("warehouse"))).withColumns(
        {f"_{m}": F.col(m) * F.col("games") for m in means}
    )
    got = prior_equal_period(known, selected, [], ["games", *counts, *[f"_{m}" for m in means]])

    def shown(value: Column) -> Column:
        return F.round(value, 1).cast("decimal(12,1)")

    def figure(name: str, column: str, scale: int) -> Column:
        now = F.try_divide(F.col(column) * scale, F.col("games"))
        was = F.try_divide(F.col(f"prior_{column}") * scale, F.col("prior_games"))
        return F.struct(
            F.lit(name).alias("figure"),
            now.cast("double").alias("value"),
            was.cast("double").alias("prior_value"),
            (shown(now) - shown(was)).cast("double").alias("shown_delta"),
        )

    figures = [figure(f"{c}_percent", c, 100) for c in counts]
    figures += [figure(m, f"_{m}", 1) for m in means]
    return got.select(F.inline(F.array(*figures)))


def dimension_values(cube: DataFrame, column: str, listed_grains: Sequence[str] = ("clock_game",)):
    """Distinct values of a dimension over the aggregate grains."""
    return (
        cube.where(F.col(column).isNotNull() & ~F.col("grain").isin(*listed_grains))
        .select(column)
        .distinct()
        .orderBy(column)
    )


def date_bounds(cube: DataFrame) -> DataFrame:
    return cube.agg(
        F.min("period_start").alias("first_date"), F.max("period_end").alias("last_date")
    )


def clock_game_list(
    rows: DataFrame, band: str, limit: int, identifier: str = "game_key"
) -> DataFrame:
    """Published games of one band in hash order, with the side that moved and the total."""
    if limit < 1:
        raise ValueError("limit must be positive")
    hit = rows.where(F.col("clock_band") == band)
    games = hit.groupBy(identifier).agg(
        F.min("period_start").alias("played_on"),
        F.min("time_control").alias("time_control"),
        F.min("opening_line").alias("opening_line"),
        F.max("white_rating").alias("white_rating"),
        F.max("black_rating").alias("black_rating"),
        (F.count_if(F.col("color") == "white") > 0).alias("_w"),
        (F.count_if(F.col("color") == "black") > 0).alias("_b"),
    )
    side = F.when(F.col("_w") & F.col("_b"), "Both").when(F.col("_w"), "White").when(
        F.col("_b"), "Black"
    )
    total = hit.agg(F.count_distinct(identifier)).scalar()
    return (
        games.withColumn("side", F.coalesce(side, F.lit("")))
        .withColumn("total", total)
        .drop("_w", "_b")
        .orderBy(*hash_order(identifier))
        .limit(limit)
    )


def opening_lines(rows: DataFrame, family: str) -> DataFrame:
    """Lines of one family: games and the number of distinct positions, by games."""
    return (
        rows.where(F.col("opening_family") == family)
        .groupBy("opening_line")
        .agg(F.sum("games").alias("games"), F.count_distinct("fen").alias("positions"))
        .orderBy(F.col("games").desc(), "opening_line")
    )


def opening_families(rows: DataFrame) -> DataFrame:
    """Families of the shown rows by games."""
    named = rows.where(F.col("opening_family").isNotNull())
    return named.groupBy(F.col("opening_family").alias("label")).agg(F.sum("games").alias("games")).orderBy(F.col("games").desc(), "label")


def line_positions(rows: DataFrame, family: str) -> DataFrame:
    """Lines of one family with their games and the sorted set of their positions.

    A line has at most as many positions as its plies allow and the cube's floor keeps.
    """
    return (
        rows.where(F.col("opening_family") == family)
        .groupBy(F.col("opening_line").alias("label"))
        .agg(F.sum("games").alias("games"), F.array_sort(F.collect_set("fen")).alias("fens"))
        .orderBy(F.col("games").desc(), "label")
    )


def transpositions(
    routes: DataFrame, positions: DataFrame, *, minimum: int = 10, routes_shown: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Positions with at least two surviving routes, and the top routes of each.

    ``routes`` has (position_id, route, games), ``positions`` has (position_id, games).
    """
    kept = routes.where(F.col("games") >= minimum)
    summary = (
        kept.groupBy("position_id")
        .agg(F.count("*").alias("move_orders"), F.sum("games").alias("kept_games"))
        .where(F.col("move_orders") >= 2)
        .join(positions.where(F.col("games") >= minimum), "position_id")
    )
    shown = top_n_per_group(
        kept.join(summary.select("position_id"), "position_id", "left_semi"),
        ["position_id"],
        [F.col("games").desc(), F.col("route")],
        routes_shown,
    )
    return summary, shown
