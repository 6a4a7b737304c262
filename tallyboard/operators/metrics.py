"""Governed metrics: counts first, ratios last, null where the denominator is zero."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions.scalars import (
    RATING_LABELS,
    completed,
    difference_band,
    family,
    rating_band,
)
from tallyboard.operators.filters import cohort_filter, eligible, game_eligibility

KEYS = ["provider", "game_id"]
LOW_SUPPORT = 100


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Null on a zero or missing denominator."""
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(n.cast("double"), d)


def draw_rate(games: DataFrame) -> DataFrame:
    """Drawn and eligible rated standard games, with unknown results and bots beside them."""
    standard = games.where(F.col("rated") & (F.col("variant") == "Standard"))
    ok = eligible()
    return standard.agg(
        F.count_if(ok & (F.col("result") == "1/2-1/2")).alias("drawn"),
        F.count_if(ok).alias("eligible"),
        F.count_if((F.col("result") == "*") & ~F.col("marked_bot")).alias("unknown_results"),
        F.count_if("marked_bot").alias("marked_bots"),
    ).withColumn("draw_rate", ratio("drawn", "eligible"))


def usage_share(games: DataFrame, value: str) -> DataFrame:
    """Eligible games in one family over eligible games with a known family."""
    f = family("source_opening")
    return (
        games.where(eligible())
        .agg(
            F.count_if(f == value).alias("numerator"),
            F.count_if(f.isNotNull()).alias("denominator"),
            F.count_if(f.isNull()).alias("unknown_opening_games"),
        )
        .withColumn("value", ratio("numerator", "denominator"))
    )


def usage_share_grouped(games: DataFrame, limit: int = 500) -> DataFrame:
    """Share of every known family, largest first; ``truncated`` tells of families beyond."""
    counted = (
        games.where(eligible())
        .groupBy(family("source_opening").alias("family"))
        .agg(F.count("*").alias("numerator"))
        .where(F.col("family").isNotNull())
    )
    totals = counted.agg(
        F.struct(F.sum("numerator").alias("games"), F.count("*").alias("families"))
    ).scalar()
    return (
        counted.withColumn("_t", totals)
        .orderBy(F.col("numerator").desc(), "family")
        .limit(limit)
        .select(
            "family",
            "numerator",
            F.col("_t.games").alias("denominator"),
            ratio(F.col("numerator"), F.col("_t.games")).alias("value"),
            (F.col("_t.families") > limit).alias("truncated"),
        )
    )


def cohort_rows(players: DataFrame, games: DataFrame) -> DataFrame:
    """Player rows of eligible games with control and family."""
    g = games.where(eligible()).select(
        *KEYS, "base_seconds", "increment_seconds", family("source_opening").alias("family")
    )
    return players.join(g, KEYS)


def _score_aggs(condition: Column | None = None, suffix: str = "") -> list[Column]:
    c = F.lit(True) if condition is None else condition
    return [
        F.count_if(c & (F.col("score") == 1)).alias(f"wins{suffix}"),
        F.count_if(c & (F.col("score") == 0.5)).alias(f"draws{suffix}"),
        F.count_if(c & (F.col("score") == 0)).alias(f"losses{suffix}"),
        F.sum(F.when(c, F.col("score"))).alias(f"score{suffix}"),
    ]


def player_score(players: DataFrame, games: DataFrame, *, family_name: str, **cohort) -> DataFrame:
    """Wins, draws, losses, win rate and score rate of one exact cohort."""
    rows = cohort_filter(
        cohort_rows(players, games), family_column="family", families=[family_name], **cohort
    )
    total = F.col("wins") + F.col("draws") + F.col("losses")
    return rows.agg(*_score_aggs()).select(
        "wins",
        "draws",
        "losses",
        total.alias("eligible_player_games"),
        ratio(F.col("wins"), total).alias("win_rate"),
        ratio(F.col("score"), total).alias("score_rate"),
        (total < LOW_SUPPORT).alias("low_support"),
    )


def outcomes_by(
    games: DataFrame, by: Sequence[str] = ("utc_date", "base_seconds", "increment_seconds")
) -> DataFrame:
    g = game_eligibility(games)
    return g.groupBy(*by).agg(
        F.count("*").alias("accepted_games"),
        F.count_if("metric_eligible").alias("eligible_games"),
        F.count_if(F.col("metric_eligible") & F.col("drawn")).alias("drawn_games"),
        F.count_if(F.col("result") == "*").alias("unknown_results"),
        F.count_if("marked_bot").alias("marked_bots"),
        F.count_if(F.col("source_opening").isNull()).alias("missing_source_opening"),
    )


@dataclass(frozen=True)
class MetricSet:
    """Declared metrics over one table: simple sums, and ratios of two of them."""

    table: DataFrame
    simple: dict[str, Column]
    ratios: dict[str, tuple[str, str]] = field(default_factory=dict)

    def query(
        self,
        metrics: Sequence[str],
        *,
        where: Column | None = None,
        group_by: Sequence[str] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """All asked metrics in one aggregation, by the first one down, then the groups."""
        unknown = [m for m in metrics if m not in self.simple and m not in self.ratios]
        if unknown or not metrics:
            raise ValueError(f"unknown metrics: {unknown}")
        needed: list[str] = []
        for m in metrics:
            for s in self.ratios.get(m, (m,)):
                if s not in needed:
                    needed.append(s)
        rows = self.table if where is None else self.table.where(where)
        sums = [F.sum(self.simple[s]).alias(s) for s in needed]
        got = rows.groupBy(*group_by).agg(*sums) if group_by else rows.agg(*sums)
        shown = [
            ratio(*self.ratios[m]).alias(m) if m in self.ratios else F.col(m) for m in metrics
        ]
        out = got.select(*group_by, *shown)
        if group_by:
            out = out.orderBy(
                F.col(metrics[0]).desc_nulls_last(), *[F.col(g).asc_nulls_last() for g in group_by]
            )
        return out if limit is None else out.limit(limit)


@dataclass(frozen=True)
class JoinedMetrics:
    """Metrics of several fact tables that share one entity.

    ``entities`` has one row per entity, named by ``keys``, with the dimensions to filter and
    group by. ``facts`` are tables with any number of rows per entity. ``simple`` declares a
    metric as (table, expression to sum), ``ratios`` one simple metric over another, also of
    different tables. Every fact is summed to its entity before it meets the dimensions, and
    the tables meet only as sums per group, so rows of one never repeat those of another.
    """

    entities: DataFrame
    keys: tuple[str, ...]
    facts: dict[str, DataFrame]
    simple: dict[str, tuple[str, Column]]
    ratios: dict[str, tuple[str, str]] = field(default_factory=dict)

    def _condition(self, column: str, op: str, value) -> Column:
        c = F.col(column)
        made = {
            "=": lambda: c == value, "<>": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value,
            ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(*value),
            "is null": lambda: c.isNull(), "is not null": lambda: c.isNotNull(),
        }
        if op not in made:
            raise ValueError(f"unknown comparison: {op}")
        return made[op]()

    def query(
        self, metrics: Sequence[str], *, where: Sequence[tuple] = (), group_by: Sequence[str] = (), limit: int | None = None
    ) -> DataFrame:
        """The asked metrics per group, by the first one down, then the groups.

        A filter is (column, comparison, value). One on a dimension of the entity holds for
        every metric; one on ``table.column`` only for metrics of that table.
        """
        unknown = [m for m in metrics if m not in self.simple and m not in self.ratios]
        foreign = [g for g in group_by if g not in self.entities.columns]
        if unknown or foreign or not metrics:
            raise ValueError(f"unknown metrics or dimensions: {[*unknown, *foreign]}")
        needed = list(dict.fromkeys(s for m in metrics for s in self.ratios.get(m, (m,))))
        entities, own = self.entities, {}
        for column, op, *value in where:
            table, _, inner = column.rpartition(".")
            condition = self._condition(inner, op, value[0] if value else None)
            if table:
                if table not in self.facts:
                    raise ValueError(f"unknown table: {table}")
                own.setdefault(table, []).append(condition)
            else:
                entities = entities.where(condition)
        groups, keys = list(group_by), list(self.keys)
        parts = []
        for table in dict.fromkeys(self.simple[s][0] for s in needed):
            sums = {s: self.simple[s][1] for s in needed if self.simple[s][0] == table}
            rows = self.facts.get(table, entities)
            for condition in own.get(table, ()):
                rows = rows.where(condition)
            if table in self.facts:
                summed = rows.groupBy(*keys).agg(*[F.sum(v).alias(f"_s_{s}") for s, v in sums.items()])
                rows = entities.select(*keys, *[g for g in groups if g not in keys]).join(summed, keys)
                cells = [F.sum(f"_s_{s}").alias(s) for s in sums]
            else:
                cells = [F.sum(v).alias(s) for s, v in sums.items()]
            parts.append(rows.groupBy(*groups).agg(*cells))
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        got = both.groupBy(*groups).agg(*[F.sum(s).alias(s) for s in needed])
        shown = [ratio(*self.ratios[m]).alias(m) if m in self.ratios else F.col(m) for m in metrics]
        out = got.select(*groups, *shown)
        if groups:
            out = out.orderBy(F.col(metrics[0]).desc_nulls_last(), *[F.col(g).asc_nulls_last() for g in groups])
        return out if limit is None else out.limit(limit)


def mean_clamped_loss(evals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clamped loss over evaluable moves."""
    grouped = evals.groupBy(*by) if by else evals.groupBy()
    return grouped.agg(
        F.sum("clamped_deterioration").alias("clamped_loss"),
        F.count_if("evaluable").alias("evaluable_moves"),
    ).withColumn("mean_loss", ratio("clamped_loss", "evaluable_moves"))


def _mate() -> Column:
    return F.col("eval_before_mate_white").isNotNull() | F.col("eval_after_mate_white").isNotNull()


def clock_aggs(condition: Column | None = None, suffix: str = "") -> list[Column]:
    c = F.lit(True) if condition is None else condition
    return [
        F.count_if(c).alias(f"eligible_moves{suffix}"),
        F.count_if(c & F.col("centipawn_deterioration").isNotNull()).alias(
            f"evaluable_moves{suffix}"
        ),
        F.count_if(c & F.coalesce(F.col("error_proxy"), F.lit(False))).alias(
            f"proxy_errors{suffix}"
        ),
        F.count_if(c & _mate()).alias(f"mate_transition_moves{suffix}"),
    ]


def clock_rows(moves: DataFrame, games: DataFrame) -> DataFrame:
    """Moves of eligible zero-increment games."""
    g = games.where(eligible() & (F.col("increment_seconds") == 0))
    return moves.join(g.select(*KEYS, "time_control", "utc_date", "source_opening"), KEYS)


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumn("evaluation_coverage", ratio("evaluable_moves", "eligible_moves")).withColumn(
        "error_proxy_rate", ratio("proxy_errors", "evaluable_moves")
    )


def clock_pressure(moves: DataFrame, games: DataFrame, bucket: str | None = None) -> DataFrame:
    """Errors by the mover's remaining time, for one bucket or for all of them."""
    rows = clock_rows(moves, games).where(F.col("clock_bucket").isNotNull())
    if bucket is not None:
        return _with_rates(rows.where(F.col("clock_bucket") == bucket).agg(*clock_aggs()))
    return _with_rates(rows.groupBy("clock_bucket").agg(*clock_aggs()))


def clock_strata(moves: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """Clock metrics by bucket, control, phase and rating band of the mover."""
    rows = clock_rows(moves, games).where(F.col("clock_bucket").isNotNull())
    rated = players.where(F.col("rating").isNotNull()).select(
        *KEYS, "color", rating_band("rating").alias("rating_band")
    )
    counts = (
        rows.join(rated, [*KEYS, "color"])
        .groupBy("clock_bucket", "time_control", "phase_proxy", "rating_band")
        .agg(*clock_aggs()[:3])
    )
    return _with_rates(counts)


def snapshot_summary(moves: DataFrame, games: DataFrame, top: int = 12) -> DataFrame:
    """The published summary in long form: section, item, measure, value."""
    m = moves.groupBy("provider", "game_id").agg(
        F.count("*").alias("moves"),
        F.count("clock_after_seconds").alias("after_clock_moves"),
        F.count("clock_before_seconds").alias("before_clock_moves"),
        F.count("eval_after_cp_white").alias("cp_eval_moves"),
        F.count("eval_after_mate_white").alias("mate_eval_moves"),
    )
    names = ["moves", "after_clock_moves", "before_clock_moves", "cp_eval_moves", "mate_eval_moves"]
    coverage = m.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.count("*").alias("selected_games"),
    )
    f = family("source_opening")
    blank = F.col("source_opening").isNull() | (F.trim("source_opening") == "")
    opening = games.agg(
        F.count_if(eligible()).alias("eligible_games"),
        F.count_if(eligible() & f.isNotNull()).alias("known_opening_games"),
        F.count_if(blank).alias("missing_source_opening"),
    )

    def long(df: DataFrame, section: str, item: Column, measures: Sequence[str]) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(n).alias("measure"), F.col(n).cast("bigint").alias("value"))
                for n in measures
            ]
        )
        return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(pairs))

    families = (
        games.where(eligible() & f.isNotNull())
        .groupBy(f.alias("family"))
        .agg(F.count("*").alias("eligible_games"))
        .orderBy(F.col("eligible_games").desc(), "family")
        .limit(top)
    )
    clocks = (
        clock_rows(moves, games)
        .where(F.col("clock_before_seconds").isNotNull())
        .groupBy("clock_bucket")
        .agg(*clock_aggs())
    )
    return (
        long(coverage, "move_coverage", F.lit("all"), [*names, "selected_games"])
        .unionByName(
            long(
                opening,
                "opening_coverage",
                F.lit("all"),
                ["eligible_games", "known_opening_games", "missing_source_opening"],
            )
        )
        .unionByName(long(families, "top_families", F.col("family"), ["eligible_games"]))
        .unionByName(
            long(
                clocks,
                "clock_buckets",
                F.col("clock_bucket"),
                ["eligible_moves", "evaluable_moves", "proxy_errors", "mate_transition_moves"],
            )
        )
    )


def compare_scores(
    players: DataFrame, games: DataFrame, *, families: tuple[str, str], **cohort
) -> DataFrame:
    """Two families in one cohort side by side, and the first minus the second."""
    if len(families) != 2 or families[0] == families[1]:
        raise ValueError("two distinct families required")
    rows = cohort_filter(
        cohort_rows(players, games), family_column="family", families=families, **cohort
    )
    one = rows.agg(
        *_score_aggs(F.col("family") == families[0], "_a"),
        *_score_aggs(F.col("family") == families[1], "_b"),
    )
    for s in ("_a", "_b"):
        total = F.col(f"wins{s}") + F.col(f"draws{s}") + F.col(f"losses{s}")
        one = one.withColumns(
            {
                f"games{s}": total,
                f"win_rate{s}": ratio(F.col(f"wins{s}"), total),
                f"score_rate{s}": ratio(F.col(f"score{s}"), total),
            }
        )
    return one.select(
        "games_a",
        "games_b",
        "win_rate_a",
        "win_rate_b",
        "score_rate_a",
        "score_rate_b",
        (F.col("score_rate_a") - F.col("score_rate_b")).alias("score_rate_difference"),
        (F.col("win_rate_a") - F.col("win_rate_b")).alias("win_rate_difference"),
    )


def compare_buckets(moves: DataFrame, games: DataFrame, first: str, second: str) -> DataFrame:
    """Two clock buckets side by side, and the first minus the second."""
    if first == second:
        raise ValueError("two distinct buckets required")
    one = clock_rows(moves, games).agg(
        *clock_aggs(F.col("clock_bucket") == first, "_a")[:3],
        *clock_aggs(F.col("clock_bucket") == second, "_b")[:3],
    )
    for s in ("_a", "_b"):
        one = one.withColumn(
            f"error_proxy_rate{s}", ratio(f"proxy_errors{s}", f"evaluable_moves{s}")
        ).withColumn(f"coverage{s}", ratio(f"evaluable_moves{s}", f"eligible_moves{s}"))
    return one.withColumn(
        "error_rate_difference", F.col("error_proxy_rate_a") - F.col("error_proxy_rate_b")
    ).withColumn("coverage_difference", F.col("coverage_a") - F.col("coverage_b"))


def comparison_rows(
    players: DataFrame, games: DataFrame, *, families: tuple[str, str], **cohort
) -> DataFrame:
    """The rated player rows of two families with stratum and cluster of each."""
    rows = cohort_filter(
        cohort_rows(players, games), family_column="family", families=families, **cohort
    )
    cluster = F.coalesce(
        F.col("player_key"), F.concat(F.col("game_id"), F.lit(":"), F.col("color"))
    )
    return rows.where(F.col("opponent_rating").isNotNull()).select(
        F.col("family").alias("group"),
        cluster.alias("cluster"),
        "score",
        difference_band(F.col("rating") - F.col("opponent_rating")).alias("stratum"),
    )


def corpus_summary(training: DataFrame) -> DataFrame:
    """Per source period and cohort: games, dates, lowest rating of the weaker player."""
    return training.groupBy("source_period", "source_cohort").agg(
        F.count("*").alias("games"),
        F.min("utc_date").alias("first_date"),
        F.max("utc_date").alias("last_date"),
        F.min(F.least("white_rating", "black_rating")).alias("minimum_rating"),
    )


def retained_counts(retained: DataFrame, floor: int = 1000) -> DataFrame:
    w, b = F.col("white_rating"), F.col("black_rating")
    return retained.agg(
        F.count("*").alias("retained"),
        F.count_if((w >= floor) & (b >= floor)).alias("at_floor"),
        F.count_if((w > floor) & (b > floor)).alias("above_floor"),
        F.count_if(w.isNull() | b.isNull()).alias("missing_rating"),
    )


def funnel(games: DataFrame) -> DataFrame:
    """Ordered populations of one set of games, each with the one it is part of."""
    done = completed("result") & ~F.col("marked_bot")
    return funnel_of(
        games,
        [
            ("accepted", F.lit(True), None),
            ("marked_bots", F.col("marked_bot"), "accepted"),
            ("unknown_results", (F.col("result") == "*") & ~F.col("marked_bot"), "accepted"),
            ("eligible_games", done, "accepted"),
            ("known_opening_games", done & family("source_opening").isNotNull(), "eligible_games"),
        ],
    )


def funnel_of(rows: DataFrame, stages: Sequence[tuple[str, Column, str | None]]) -> DataFrame:
    """The stages given as (population, condition, what it is part of), counted in one pass.

    A stage can only be part of one that is given before it.
    """
    known: set[str] = set()
    for name, _, parent in stages:
        if name in known or (parent is not None and parent not in known):
            raise ValueError(f"stage {name} is given twice or part of an unknown one")
        known.add(name)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_order"),
                F.lit(name).alias("population"),
                F.count_if(cond).alias("games"),
                F.lit(parent).cast("string").alias("rolls_up_to"),
            )
            for i, (name, cond, parent) in enumerate(stages)
        ]
    )
    return rows.agg(cells.alias("_r")).select(F.inline("_r"))


def intake_funnel(records: DataFrame, kept: Column) -> DataFrame:
    """Seen, excluded and accepted records, and the populations of the accepted ones."""
    kept = F.coalesce(kept, F.lit(False))
    done = kept & completed("result") & ~F.col("marked_bot")
    return funnel_of(
        records,
        [
            ("seen", F.lit(True), None),
            ("excluded", ~kept, "seen"),
            ("accepted", kept, "seen"),
            ("marked_bots", kept & F.col("marked_bot"), "accepted"),
            ("unknown_results", kept & (F.col("result") == "*") & ~F.col("marked_bot"), "accepted"),
            ("eligible_games", done, "accepted"),
            ("known_opening_games", done & family("source_opening").isNotNull(), "eligible_games"),
        ],
    )


def source_lineage(training: DataFrame, lineage: str = "opening_corpus") -> DataFrame:
    """All training games, then those of each source, which roll up to them.

    Sources are ordered by period and cohort; one row for each source.
    """
    total, part = "training_games", "training_source_games"
    sums = training.groupBy("source_period", "source_cohort").agg(F.count("*").alias("games"))
    order = F.row_number().over(Window.orderBy("source_period", "source_cohort"))
    name, null = F.lit(lineage).alias("lineage"), F.lit(None).cast("string")
    parts = sums.select(
        name, order.alias("stage_order"), F.lit(part).alias("population"), "games", F.col("source_period").alias("period"),
        F.col("source_cohort").alias("cohort"), F.lit(f"{lineage}:{total}").alias("rolls_up_to"),
    )
    whole = sums.agg(F.coalesce(F.sum("games"), F.lit(0)).alias("games")).select(
        name, F.lit(0).alias("stage_order"), F.lit(total).alias("population"), "games", null.alias("period"), null.alias("cohort"), null.alias("rolls_up_to")
    )
    return whole.unionByName(parts)


def rollup_strata(strata: DataFrame) -> DataFrame:
    """Clock strata summed to rating band and control; rates are recomputed from the sums."""
    sums = strata.groupBy("rating_band", "time_control").agg(
        *[F.sum(c).alias(c) for c in ("eligible_moves", "evaluable_moves", "proxy_errors")]
    )
    order = F.array_position(F.array(*[F.lit(b) for b in RATING_LABELS]), F.col("rating_band"))
    return _with_rates(sums).withColumn("band_order", order)


def holdout_inventory(training: DataFrame, start: str) -> DataFrame:
    """Sources at or after a period, and the games in them."""
    kept = training.where(F.col("source_period") >= start)
    return kept.groupBy("source_period", "source_cohort").agg(
        F.count("*").alias("games"),
        F.min("utc_date").alias("first_date"),
        F.max("utc_date").alias("last_date"),
    )


def player_index(players: DataFrame) -> DataFrame:
    """White and black games per provider and folded name."""
    folded = F.lower(F.trim("player_key"))
    return (
        players.where(F.col("player_key").isNotNull())
        .groupBy("provider", folded.alias("key"))
        .agg(
            F.count_if(F.col("color") == "white").alias("white"),
            F.count_if(F.col("color") == "black").alias("black"),
        )
    )
