"""Positions reached by ordered games: rankings, coverage, routes and departures.

Visits are first summed per position and route, so a position that is in almost every
game travels as one row per route and task, not as one row per game.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyboard.functions.scalars import route_contains
from tallyboard.operators.windows import earliest_visit, running_total, top_n_per_group
from tallyboard.session import materialize

GAME = ["provider", "game_id"]


def _game() -> Column:
    return F.struct(*GAME)


def route_counts(visits: DataFrame) -> DataFrame:
    """Games per position, route and repeat flag of the earliest visits."""
    return visits.groupBy("position_id", "position_key", "route", "route_has_repeat").agg(
        F.count("*").alias("games")
    )


def position_counts(visits: DataFrame) -> DataFrame:
    """Per position: games, distinct routes without a repeat, games that came with one."""
    return (
        route_counts(visits)
        .groupBy("position_id")
        .agg(
            F.min("position_key").alias("position_key"),
            F.sum("games").alias("games"),
            F.count_if(~F.col("route_has_repeat")).alias("acyclic_routes"),
            F.coalesce(
                F.sum(F.when(F.col("route_has_repeat"), F.col("games"))), F.lit(0)
            ).alias("loop_prefix_games"),
        )
    )


def view_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count("*").alias("distinct_positions"),
        F.count_if(F.col("games") >= 2).alias("recurring_positions"),
        F.count_if(F.col("acyclic_routes") >= 2).alias("transposing_positions"),
    )


def rank_positions(counts: DataFrame, kind: str, k: int) -> DataFrame:
    """The first ``k`` recurring or transposing positions, by games and then id."""
    conditions = {
        "recurring": F.col("games") >= 2,
        "transposing": F.col("acyclic_routes") >= 2,
    }
    top = (
        counts.where(conditions[kind]).orderBy(F.col("games").desc(), "position_id").limit(k)
    )
    w = Window.orderBy(F.col("games").desc(), "position_id")  # at most k rows
    return top.withColumn("rank", F.row_number().over(w))


def coverage_curve(
    visits: DataFrame, ranks: DataFrame, k: int, denominator: int | Column | None = None
) -> DataFrame:
    """For n = 1..k: games that reach any of the first n positions, each counted once.

    A game counts at its earliest rank; cumulative sums of that histogram are the unions.
    """
    ranks = ranks.where(F.col("rank") <= k)  # so at most k rows are broadcast
    hits = visits.join(F.broadcast(ranks.select("position_id", "rank")), "position_id")
    first = hits.groupBy(*GAME).agg(F.min("rank").alias("n"))
    histogram = first.groupBy("n").agg(F.count("*").alias("additional_games"))
    spine = ranks.select(F.col("rank").alias("n"))
    filled = spine.join(histogram, "n", "left").withColumn(
        "additional_games", F.coalesce("additional_games", F.lit(0))
    )
    total = (
        visits.agg(F.count_distinct(_game())).scalar() if denominator is None else F.lit(denominator)
    )
    return running_total(filled, "n", "additional_games", "games").withColumn(
        "share", F.try_divide(F.col("games").cast("double"), total)
    )


def detail_visits(visits: DataFrame, ranks: DataFrame) -> DataFrame:
    """Visits of the ranked positions only; ``ranks`` has one row per published rank."""
    return visits.join(F.broadcast(ranks.select("position_id")), "position_id", "left_semi")


def top_routes(visits: DataFrame, n: int = 3) -> DataFrame:
    """The most played routes of each position, without repeats."""
    counted = (
        visits.where(~F.col("route_has_repeat"))
        .groupBy("position_id", "route")
        .agg(F.count("*").alias("games"))
    )
    return top_n_per_group(counted, ["position_id"], [F.col("games").desc(), "route"], n)


def top_continuations(visits: DataFrame, n: int = 5) -> DataFrame:
    counted = (
        visits.where(F.col("next_move") != "")
        .groupBy("position_id", "next_move")
        .agg(F.count("*").alias("games"))
    )
    return top_n_per_group(counted, ["position_id"], [F.col("games").desc(), "next_move"], n)


def top_labels(visits: DataFrame, n: int = 5) -> DataFrame:
    counted = visits.groupBy("position_id", "opening_family", "eco").agg(
        F.count("*").alias("games")
    )
    order = [F.col("games").desc(), F.col("opening_family"), F.col("eco")]
    return top_n_per_group(counted, ["position_id"], order, n)


def position_details(
    visits: DataFrame, denominator: int | Column, token: str, shown_routes: int = 3
) -> DataFrame:
    """One row per position: shares of its routes, breadth of its labels, its remainders."""
    counts = position_counts(visits)
    routes = top_routes(visits, shown_routes).groupBy("position_id").agg(
        F.max("games").alias("dominant_route_games"), F.sum("games").alias("_shown")
    )
    # Sums per label first: few rows per position, whatever the number of games.
    labels = (
        visits.groupBy("position_id", "opening_family", "eco")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(route_contains("route", token)).alias("_token"),
            F.count_if(F.col("next_move") != "").alias("_next"),
        )
        .groupBy("position_id")
        .agg(
            F.count_distinct(
                F.when(F.col("opening_family") != "Unknown", F.col("opening_family"))
            ).alias("distinct_recorded_families"),
            F.count_distinct(F.when(F.col("eco") != "", F.col("eco"))).alias(
                "distinct_recorded_ecos"
            ),
            F.coalesce(
                F.sum(F.when(F.col("opening_family") == "Unknown", F.col("_n"))), F.lit(0)
            ).alias("unknown_family_games"),
            F.sum("_token").alias("token_played_games"),
            F.sum("_next").alias("next_move_games"),
        )
    )
    acyclic = F.col("games") - F.col("loop_prefix_games")
    dominant = F.coalesce(F.col("dominant_route_games"), F.lit(0))
    bottom = denominator if isinstance(denominator, Column) else F.lit(denominator)
    return (
        counts.join(labels, "position_id")
        .join(routes, "position_id", "left")
        .withColumns(
            {
                "frequency": F.try_divide(F.col("games").cast("double"), bottom),
                "acyclic_games": acyclic,
                "dominant_route_games": dominant,
                "alternative_route_share": 1 - F.try_divide(dominant.cast("double"), acyclic),
                "other_acyclic_route_games": acyclic - F.coalesce(F.col("_shown"), F.lit(0)),
            }
        )
        .drop("_shown")
    )


def family_inventory(visits: DataFrame) -> DataFrame:
    """Distinct games per family, and their share of all games."""
    total = visits.agg(F.count_distinct(_game())).scalar()
    counted = visits.groupBy("opening_family").agg(F.count_distinct(_game()).alias("games"))
    return counted.withColumn("share", F.try_divide(F.col("games").cast("double"), total))


def endpoint_compression(visits: DataFrame) -> DataFrame:
    """Per ply: one minus distinct positions over distinct routes, repeats left out."""
    rows = visits.where(~F.col("route_has_repeat")).groupBy("ply", "route", "position_id").agg(
        F.count("*").alias("_n")
    )
    return (
        rows.groupBy("ply")
        .agg(
            F.count_distinct("route").alias("distinct_routes"),
            F.count_distinct("position_id").alias("distinct_positions"),
            F.sum("_n").alias("included_visits"),
        )
        .withColumn(
            "endpoint_compression",
            F.when(
                F.col("distinct_routes") > 0,
                1 - F.col("distinct_positions") / F.col("distinct_routes"),
            ).otherwise(0.0),
        )
    )


def continuations(
    visits: DataFrame, position_id: str, cohort: str | None = None, limit: int = 8
) -> DataFrame:
    """Next moves at the earliest visit to one position, with shares and a truncated flag."""
    rows = visits.where(F.col("position_id") == position_id)
    if cohort is not None:
        rows = rows.where(F.col("cohort") == cohort)
    counted = earliest_visit(rows).groupBy("next_move").agg(F.count("*").alias("games"))
    facts = counted.agg(
        F.struct(
            F.sum("games").alias("position_games"),
            F.count_if(F.coalesce("next_move", F.lit("")) != "").alias("moves"),
        )
    ).scalar()
    return (
        counted.where(F.coalesce("next_move", F.lit("")) != "")
        .withColumn("_f", facts)
        .orderBy(F.col("games").desc(), "next_move")
        .limit(limit)
        .select(
            "next_move",
            "games",
            F.try_divide(F.col("games").cast("double"), F.col("_f.position_games")).alias(
                "share_of_position_games"
            ),
            (F.col("_f.moves") > limit).alias("truncated"),
        )
    )


def top_families(
    visits: DataFrame, k: int = 12, minimum: int = 1, unknown: str = "Unknown"
) -> DataFrame:
    """The ``k`` largest families, then without the unknown one and those under the minimum."""
    largest = (
        visits.groupBy("opening_family")
        .agg(F.count_distinct(_game()).alias("games"))
        .orderBy(F.col("games").desc(), "opening_family")
        .limit(k)
    )
    return largest.where((F.col("opening_family") != unknown) & (F.col("games") >= minimum))


def id_collisions(visits: DataFrame) -> DataFrame:
    """Ids that stand for more than one key."""
    pairs = visits.select("position_id", "position_key").distinct()
    return pairs.groupBy("position_id").agg(F.count("*").alias("keys")).where("keys > 1")


def reference_prefixes(routes: DataFrame) -> DataFrame:
    """Every prefix of the routes with two flags: goes on in some route, ends a route."""
    moves = F.split("route", " ")
    step = F.posexplode(F.transform(F.sequence(F.lit(0), F.size(moves)), lambda i: F.slice(moves, 1, i)))
    rows = routes.select(F.size(moves).alias("_len"), step.alias("_i", "_p"))
    return rows.groupBy(F.array_join("_p", " ").alias("prefix")).agg(
        F.bool_or(F.col("_i") > 0).alias("is_prefix"),
        F.bool_or(F.col("_i") < F.col("_len")).alias("continues"),
        F.bool_or(F.col("_i") == F.col("_len")).alias("is_endpoint"),
    )


def route_departure(visits: DataFrame, routes: DataFrame) -> DataFrame:
    """First ply at which each game leaves the reference routes; games that stay are absent.

    A game is followed while the moves so far continue some route and do not end one.
    ``routes`` is the reference, usually a few routes for each ranked position; its
    prefixes are stored, so Spark knows their size when it chooses the joins. ``visits``
    must hold every game from ply 1 on: a table that begins later is refused.
    """
    starts = visits.groupBy(*GAME).agg(F.min("ply").alias("first")).where("first > 1")
    if not starts.isEmpty():
        raise ValueError("route_departure needs every game from ply 1 on")
    known = materialize(reference_prefixes(routes), "prefixes")
    previous = F.when(F.col("ply") == 1, F.lit("")).otherwise(
        F.regexp_replace("route", r" ?[^ ]+$", "")
    )
    before = known.select(F.col("prefix").alias("_prev"), "continues", "is_endpoint")
    now = known.where("is_prefix").select(F.col("prefix").alias("route"), "is_prefix")
    steps = (
        visits.select(*GAME, "ply", "route", previous.alias("_prev"))
        .join(before, "_prev", "left")
        .join(now, "route", "left")
    )
    halted = F.coalesce(F.col("is_endpoint"), F.lit(False)) | ~F.coalesce(
        F.col("continues"), F.lit(False)
    )
    gone = F.col("is_prefix").isNull()
    ends = steps.where(halted | gone).select(*GAME, "ply", (gone & ~halted).alias("_left"))
    first = ends.groupBy(*GAME).agg(F.min(F.struct("ply", "_left")).alias("_f"))
    return first.where("_f._left").select(*GAME, F.col("_f.ply").alias("departure_ply"))


def departures_per_ply(visits: DataFrame, routes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Departing games per ply, and those that later come back to a ranked position."""
    left = route_departure(visits, routes)
    ranked = detail_visits(visits, ranks).groupBy(*GAME).agg(F.max("ply").alias("_last"))
    joined = left.join(ranked, GAME, "left")
    back = F.coalesce(F.col("_last") > F.col("departure_ply"), F.lit(False))
    return joined.groupBy("departure_ply").agg(
        F.count("*").alias("games"), F.count_if(back).alias("reentered_games")
    )


def import_positions(visits: DataFrame, ranks: DataFrame, k: int = 20) -> DataFrame:
    """The most reached positions of the chosen games, beside the reference."""
    first = earliest_visit(visits)
    total = visits.agg(F.count_distinct(_game())).scalar()
    counts = position_counts(first)
    top = counts.orderBy(F.col("games").desc(), "position_id").limit(k)
    routes = top_routes(detail_visits(first, top), 1).select(
        "position_id", F.col("games").alias("_dominant")
    )
    inside = F.broadcast(ranks.select("position_id", F.lit(True).alias("in_reference")))
    acyclic = F.col("games") - F.col("loop_prefix_games")
    return (
        top.join(routes, "position_id", "left")
        .join(inside, "position_id", "left")
        .select(
            "position_id",
            "games",
            F.col("loop_prefix_games").alias("loops"),
            "acyclic_routes",
            F.try_divide(F.col("games").cast("double"), total).alias("frequency"),
            F.when(acyclic > 0, 1 - F.col("_dominant") / acyclic).alias("alternative_route_share"),
            F.coalesce("in_reference", F.lit(False)).alias("in_reference"),
        )
    )


def import_totals(games: DataFrame, visits: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: chosen games, games in the window, covered games, positions."""
    reached = visits.groupBy(*GAME).agg(F.count("*").alias("_n"))
    covered = detail_visits(visits, ranks).select(*GAME, F.lit(1).alias("_c")).distinct()
    per_game = games.select(*GAME).distinct().join(reached, GAME, "left").join(covered, GAME, "left")
    counts = position_counts(earliest_visit(visits))
    positions = counts.agg(
        F.struct(F.count("*").alias("d"), F.count_if(F.col("games") >= 2).alias("r"))
    ).scalar()
    return (
        per_game.agg(
            F.count("*").alias("denominator_games"),
            F.count("_n").alias("games_reaching_window"),
            F.count("_c").alias("covered_games"),
        )
        .withColumn(
            "games_shorter_than_window",
            F.col("denominator_games") - F.col("games_reaching_window"),
        )
        .withColumn(
            "coverage_share",
            F.try_divide(F.col("covered_games").cast("double"), F.col("denominator_games")),
        )
        .withColumn("_p", positions)
        .withColumn("distinct_positions", F.col("_p.d"))
        .withColumn("recurring_positions", F.col("_p.r"))
        .drop("_p")
    )


def ranking_invariants(
    ranked: DataFrame,
    curve: DataFrame,
    details: DataFrame,
    routes: DataFrame,
    families: DataFrame,
    denominator: int | Column,
    kind: str = "recurring",
) -> DataFrame:
    """Rows (check, violations); every count is zero when the published view is sound."""
    total = denominator if isinstance(denominator, Column) else F.lit(denominator)
    order = Window.orderBy("rank")  # one row per published rank
    steps = Window.orderBy("n")
    unfit = (F.col("games") < 2) | (
        (F.lit(kind) == "transposing") & (F.col("acyclic_routes") < 2)
    )

    def one(name: str, df: DataFrame, violations: Column) -> DataFrame:
        return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(
            F.lit(name).alias("check"), "violations"
        )

    disorder = ranked.withColumn("_prev", F.lag("games").over(order))
    upto = ranked.select(
        F.col("rank").alias("n"),
        F.max("games").over(order).alias("_max"),
        F.sum("games").over(order).alias("_sum"),
    )
    unions = curve.join(upto, "n", "full_outer")
    rising = curve.withColumn("_prev", F.lag("games").over(steps))
    acyclic = F.col("games") - F.col("loop_prefix_games")
    remainder = (
        (F.col("acyclic_games") != acyclic)
        | ~F.col("other_acyclic_route_games").between(F.lit(0), acyclic)
        | ~F.col("loop_prefix_games").between(F.lit(0), F.col("games"))
        | ~F.col("next_move_games").between(F.lit(0), F.col("games"))
        | (F.col("unknown_family_games") > F.col("games"))
        | (F.col("token_played_games") > F.col("games"))
    )
    dominant = (
        routes.groupBy("position_id").agg(F.max("games").alias("_dom"), F.sum("games").alias("_sum"))
    )
    shares = details.join(dominant, "position_id", "left").where(
        (F.coalesce("_dom", F.lit(0)) != F.col("dominant_route_games"))
        | (
            F.col("other_acyclic_route_games")
            != F.col("acyclic_games") - F.coalesce("_sum", F.lit(0))
        )
    )
    checks = [
        one("ranks_ordered", disorder, F.count_if(F.col("games") > F.col("_prev"))),
        one("ranks_eligible", ranked, F.count_if(unfit)),
        one("ranks_distinct", ranked, F.count("*") - F.count_distinct("position_id")),
        one(
            "union_between_max_and_sum",
            unions,
            F.count_if(~F.coalesce(F.col("games").between(F.col("_max"), F.col("_sum")), F.lit(False))),
        ),
        one("union_within_denominator", curve, F.count_if(F.col("games") > total)),
        one("union_rises", rising, F.count_if(F.col("games") < F.col("_prev"))),
        one("remainders", details, F.count_if(remainder)),
        one("route_shares", shares, F.count("*")),
        one("families_sum", families, F.abs(F.sum("games") - total)),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def lens_visits(visits: DataFrame, games: DataFrame) -> DataFrame:
    return visits.join(games.select(*GAME), GAME, "left_semi")


def cohort_view(
    visits: DataFrame, *, cohort: str | None = None, family: str | None = None
) -> DataFrame:
    """Earliest visits of one cohort, optionally of one family."""
    rows = visits
    for column, value in (("cohort", cohort), ("opening_family", family)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return earliest_visit(rows)


def ranked_ids(counts: DataFrame, kinds: Sequence[str], k: int) -> DataFrame:
    """Ids published under any of the kinds."""
    out = None
    for kind in kinds:
        ids = rank_positions(counts, kind, k).select("position_id")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()
