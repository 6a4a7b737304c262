"""Ordered operators. None of them needs all rows of one hot key in a single task."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyboard.functions.scalars import clock_band, col, deterioration, error_flag, phase

HOT_ROWS = 1_000_000
LONG_PLIES = 1_000_000
KEY_BUCKETS = 1 << 16


def _few(keys: DataFrame, rows_each: int) -> DataFrame:
    """``keys``, each of at least ``rows_each`` rows, to be broadcast where that makes them
    few; else their measured size decides."""
    return F.broadcast(keys) if rows_each >= HOT_ROWS else keys


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    name: str = "ply",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact ``row_number`` per key that splits hot keys.

    ``block`` is an integer column that never decreases along ``order``. A key with
    at most ``hot_rows`` rows is numbered by one window, as usual. A hotter key is
    cut into its blocks, each numbered on its own, and shifted by the rows in its
    earlier blocks. There can be at most ``rows / hot_rows`` hot keys.
    """
    keys = list(keys)
    # A key can only be hot where its bucket of keys is crowded. Only rows of such buckets are
    # counted by key and block: this gives the totals of the keys and the shifts of the blocks.
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    crowded = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    sizes = (
        df.withColumn("_bucket", bucket)
        .join(F.broadcast(crowded.select("_bucket")), "_bucket", "left_semi")  # at most KEY_BUCKETS rows
        .groupBy(*keys, block.cast("bigint").alias("_block"))
        .agg(F.count("*").alias("_n"))
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sizes.withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_total") > hot_rows)
        .select(*keys, "_block", "_shift")
    )
    # At most rows/hot_rows keys (1M for 10^12 rows), so the broadcast stays small.
    hot = _few(shifts.select(*keys).distinct(), hot_rows).withColumn("_hot", F.lit(True))
    marked = df.join(hot, keys, "left").withColumn(
        "_block", F.when(F.col("_hot"), block.cast("bigint")).otherwise(F.lit(0))
    )
    local = F.row_number().over(
        Window.partitionBy(*keys, "_block").orderBy(*[col(c) for c in order])
    )
    # Rows lie by key and block already: only the shifts move.
    numbered = marked.withColumn("_local", local).join(shifts, [*keys, "_block"], "left")
    return numbered.withColumn(
        name, (F.col("_local") + F.coalesce(F.col("_shift"), F.lit(0))).cast("int")
    ).drop("_hot", "_block", "_local", "_shift")


def hash_rank(
    df: DataFrame, identifier: str, name: str = "rank", seed: str = "", digits: int = 3, within: Sequence[str] = ()
) -> DataFrame:
    """Dense 1-based rank of unique ids in SHA-256 order, without a global sort.

    Ids are ranked inside buckets of equal digest prefixes (``digits`` hexadecimal digits: 3
    serve to about 10^10 ids); one row per bucket carries the running total, so no task
    ever sees more than one bucket. With ``within``, each combination of these columns has
    ranks of its own; there should be few of them.
    """
    text = F.concat(F.lit(seed), F.col(identifier)) if seed else F.col(identifier)
    within = list(within)
    hashed = df.withColumn("_h", F.sha2(text, 256)).withColumn(
        "_bucket", F.substring("_h", 1, digits)
    )
    local = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_h", identifier))
    sizes = hashed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return (
        hashed.withColumn("_l", local)
        .join(F.broadcast(shifts), [*within, "_bucket"])  # 16 ** digits rows at most for each
        .withColumn(name, F.col("_l") + F.col("_s"))
        .drop("_h", "_bucket", "_l", "_s")
    )


def lag_values(
    df: DataFrame,
    keys: Sequence[str],
    ply: str,
    lags: dict[str, tuple[Column, int]],
    block: int = LONG_PLIES,
    own: dict[str, Column] | None = None,
    color: str = "color",
) -> DataFrame:
    """Values from earlier plies of the same key, as ``name -> (value, steps back)``, and
    from the last earlier ply of the same color, as ``own: name -> value``.

    Steps are rows in the order of ``ply``; missing plies change nothing. One sort serves
    all of them: the last value of each color is carried along it. Sequences that go beyond
    ply ``block`` are numbered and cut every ``block`` rows, and the last rows of a part are
    copied ahead of the next one, so no window holds more. Which ones these are is found
    when the query runs, from a filter that reaches the scan; there are at most rows /
    ``block`` of them.
    """
    keys, own = list(keys), own or {}
    deep = _few(df.where(F.col(ply) > block).select(*keys).distinct(), block)
    usual = df.join(deep, keys, "left_anti")
    along = Window.partitionBy(*keys).orderBy(ply)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    side = F.col(color)
    named = {name: F.lag(value, steps).over(along) for name, (value, steps) in lags.items()}
    for name, value in own.items():
        # A null value is carried too: it stands inside a struct that is not null.
        last = {c: F.last(F.when(side.eqNullSafe(c), F.struct(value.alias("v"))), True).over(before) for c in ("white", "black", None)}
        named[name] = F.when(side == "white", last["white"]).when(side == "black", last["black"]).otherwise(
            F.when(side.isNull(), last[None])
        )["v"]
    usual = usual.withColumns(named)
    long = df.join(deep, keys, "left_semi")
    if lags:
        long = _cut_lags(long, keys, ply, lags, block)
    if own:
        long = _cut_lags(long, [*keys, color], ply, {name: (value, 1) for name, value in own.items()}, block)
    return usual.unionByName(long)


def _cut_lags(df: DataFrame, keys: list[str], ply: str, lags: dict[str, tuple[Column, int]], block: int) -> DataFrame:
    reach = max(steps for _, steps in lags.values())
    block = max(block, reach)
    numbered = number_rows(df, keys, [ply], F.floor((F.col(ply) - 1) / block), "_row", block)
    zero = (F.col("_row") - 1).cast("bigint")
    tail = (zero % block) >= block - reach
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = numbered.withColumn("_copy", F.explode(copies)).withColumn(
        "_block", F.floor(zero / block).cast("bigint") + F.col("_copy")
    )
    along = Window.partitionBy(*keys, "_block").orderBy(ply)
    cut = spread.withColumns({name: F.lag(value, steps).over(along) for name, (value, steps) in lags.items()})
    return cut.where(F.col("_copy") == 0).drop("_copy", "_block", "_row")


def valid_clock(clock: Column | str, base: Column | str, increment: Column | str) -> Column:
    """Nulls a negative clock, and one above the base time of a zero-increment game."""
    c, b = col(clock), col(base)
    above = (col(increment) == 0) & b.isNotNull() & (c > b)
    return F.when((c < 0) | F.coalesce(above, F.lit(False)), None).otherwise(c)


def same_side_lag(
    moves: DataFrame,
    keys: Sequence[str],
    clock: str,
    ply: str = "ply",
    name: str = "clock_before",
    color: str = "color",
) -> DataFrame:
    """The mover's own previous clock: one row back among the rows of the same color."""
    return lag_values(moves, [*keys, color], ply, {name: (F.col(clock), 1)})


def previous_row_value(
    moves: DataFrame, keys: Sequence[str], value: str, ply: str = "ply", name: str = "before"
) -> DataFrame:
    return lag_values(moves, keys, ply, {name: (F.col(value), 1)})


def move_facts(moves: DataFrame, games: DataFrame) -> DataFrame:
    """The typed per-move facts from raw clocks and evaluations of each ply."""
    keys = ["provider", "game_id"]
    context = games.select(*keys, "base_seconds", "increment_seconds")
    joined = moves.join(context, keys).withColumn(
        "clock_after_seconds",
        valid_clock("clock_after_seconds", "base_seconds", "increment_seconds"),
    )
    evals = {
        "eval_before_cp_white": (F.col("eval_after_cp_white"), 1),
        "eval_before_mate_white": (F.col("eval_after_mate_white"), 1),
    }
    lagged = lag_values(joined, keys, "ply", evals, own={"clock_before_seconds": F.col("clock_after_seconds")})
    loss = deterioration("eval_before_cp_white", "eval_after_cp_white", "color")
    return (
        lagged.withColumn("clock_bucket", clock_band("clock_before_seconds"))
        .withColumn("centipawn_deterioration", loss)
        .withColumn("error_proxy", error_flag("centipawn_deterioration"))
        .withColumn("phase_proxy", phase("ply"))
        .drop("base_seconds", "increment_seconds")
    )


def earliest_visit(
    visits: DataFrame, keys: Sequence[str] = ("provider", "game_id", "position_id"), ply: str = "ply"
) -> DataFrame:
    """One row per key at its smallest ply.

    Spark limits each group before the shuffle, so repeats of a key do not travel.
    """
    w = Window.partitionBy(*keys).orderBy(ply)
    return visits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per key with their rank; each task keeps at most ``n`` per key."""
    w = Window.partitionBy(*keys).orderBy(*[col(c) for c in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def visit_sequence(
    plies: DataFrame,
    keys: Sequence[str],
    *,
    ply: str = "ply",
    move: str = "uci",
    position: str = "position_key",
    min_ply: int = 1,
    max_ply: int = 20,
) -> DataFrame:
    """Route so far, repeat flag and next move of each ply in the opening window.

    The window ends at ``max_ply``, so each group has at most ``max_ply + 1`` rows
    whatever the length of the game; the extra row supplies the last next move.
    """
    # Rows dealt by game serve both windows below.
    opening = plies.where(F.col(ply) <= max_ply + 1).repartition(*keys)
    order = Window.partitionBy(*keys).orderBy(ply)
    prefix = order.rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*keys, position).orderBy(ply)
    seen = opening.withColumn("_again", (F.row_number().over(same) > 1).cast("int"))
    return (
        seen.withColumn("route", F.concat_ws(" ", F.collect_list(move).over(prefix)))
        .withColumn("route_has_repeat", F.max("_again").over(prefix) == 1)
        .withColumn("next_move", F.coalesce(F.lead(move).over(order), F.lit("")))
        .where((F.col(ply) <= max_ply) & (F.col(ply) >= min_ply))
        .drop("_again")
    )


def running_total(df: DataFrame, rank: str, value: str, name: str = "covered") -> DataFrame:
    """Cumulative sum over ranks; ``df`` has one row per published rank."""
    w = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def month_index(period: Column | str) -> Column:
    """``YYYY-MM`` as a month count; other labels are not a series and give null."""
    p = col(period)
    month = F.substring(p, 6, 2).try_cast("int")
    ok = p.rlike(r"^\d{4}-\d{2}\z") & month.between(1, 12)
    return F.when(ok, F.substring(p, 1, 4).try_cast("int") * 12 + month)


def prior_equal_period(
    catalog: DataFrame, selected: Sequence[str], by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Current and prior sums of ``measures`` per group, and their difference.

    The prior block is as many periods as were selected, just before the first of
    them. The prior sums are null unless both blocks are contiguous months, adjoin,
    and every period has the same single cohort and span of days, and also where the
    prior block has no games (``measures`` with ``games`` at 0). Labels that are no months
    have no prior block.
    """
    chosen = sorted(set(selected))
    n = len(chosen)
    if not n:
        raise ValueError("select at least one period")
    span = F.datediff("period_end", "period_start")
    # One row per period: small, and summed before anything else happens.
    periods = catalog.groupBy(*by, "period").agg(
        *[F.sum(m).alias(m) for m in measures],
        F.min("cohort").alias("_c0"),
        F.max("cohort").alias("_c1"),
        F.min(span).alias("_s0"),
        F.max(span).alias("_s1"),
    )
    are_months = all(re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", p) for p in chosen)
    months = [int(p[:4]) * 12 + int(p[5:]) for p in chosen] if are_months else []
    contiguous = are_months and all(b == a + 1 for a, b in zip(months, months[1:], strict=False))
    current = F.col("period").isin(*chosen)
    prior = month_index("period").between(months[0] - n, months[0] - 1) if months else F.lit(False)
    used = periods.where(current | prior).withColumn("_current", current)
    grouped = used.groupBy(*by) if by else used.groupBy()
    got = grouped.agg(
        F.count_if("_current").alias("periods"),
        F.count_if(~F.col("_current")).alias("prior_periods"),
        F.min("_c0").alias("_c0"),
        F.max("_c1").alias("_c1"),
        F.min("_s0").alias("_s0"),
        F.max("_s1").alias("_s1"),
        *[F.sum(F.when(F.col("_current"), F.col(m))).alias(m) for m in measures],
        *[F.sum(F.when(~F.col("_current"), F.col(m))).alias(f"_p_{m}") for m in measures],
    )
    ok = (
        F.lit(contiguous)
        & (F.col("periods") == n)
        & (F.col("prior_periods") == n)
        & (F.col("_c0") == F.col("_c1"))
        & (F.col("_s0") == F.col("_s1"))
    )
    if "games" in measures:
        ok = ok & (F.col("_p_games") > 0)
    out = [*by, "periods"]
    for m in measures:
        was = F.when(ok, F.col(f"_p_{m}"))
        out += [F.col(m), was.alias(f"prior_{m}"), (F.col(m) - was).alias(f"{m}_delta")]
    return got.select(*out)


def shift_back(start: Column | str, end: Column | str) -> tuple[Column, Column]:
    """The window of the same number of days just before ``start``."""
    s, e = col(start), col(end)
    width = F.datediff(e, s) + 1
    return F.date_sub(s, width), F.date_sub(s, 1)


def cap_per_cell(
    rows: DataFrame, cell: Sequence[str], family: str, identifier: str, families: int = 6
) -> DataFrame:
    """Per cell keep the largest families, and in each the row with the lowest id digest."""
    filled = rows.withColumn("_family", F.coalesce(F.col(family), F.lit("")))
    lowest = filled.withColumn("_h", F.sha2(F.col(identifier), 256))
    best = top_n_per_group(lowest, [*cell, "_family"], ["_h", identifier], 1, "_first")
    counts = filled.groupBy(*cell, "_family").agg(F.count("*").alias("family_games"))
    kept = top_n_per_group(
        counts, cell, [F.col("family_games").desc(), F.col("_family")], families, "family_rank"
    )
    same = [best[c].eqNullSafe(kept[c]) for c in [*cell, "_family"]]
    joined = best.join(kept, same)
    return joined.select(*[best[c] for c in rows.columns], "family_games", "family_rank")


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` shuffled by ``keys`` that hardly repeat, ahead of a count by them.

    A count before the shuffle would gather all rows of a task's files in its table and
    leave none out. The number of partitions is the session's and stays, as narrow rows
    take far more room in a task than in a shuffle, whose size would join partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sequence_check(moves: DataFrame, keys: Sequence[str], ply: str = "ply") -> DataFrame:
    """One row per game: whether plies are 1..n once each and colors alternate."""
    parity = F.when(F.col(ply) % 2 == 1, "white").otherwise("black")
    per_ply = dealt(moves, [*keys, ply]).groupBy(*keys, ply).agg(
        F.count("*").alias("_n"),
        F.count_if(~F.col("color").eqNullSafe(parity)).alias("_wrong"),
    )
    return (
        per_ply.groupBy(*keys)
        .agg(
            F.sum("_n").alias("rows"),
            F.count("*").alias("_plies"),
            F.min(ply).cast("bigint").alias("first_ply"),
            F.max(ply).cast("bigint").alias("last_ply"),
            F.sum("_wrong").alias("wrong_color"),
        )
        .withColumn(
            "valid",
            (F.col("rows") == F.col("_plies"))
            & (F.col("first_ply") == 1)
            & (F.col("last_ply") == F.col("rows"))
            & (F.col("wrong_color") == 0),
        )
        .drop("_plies")
    )


def prefix_lookup(
    visits: DataFrame, known: dict[str, str], route: str = "route", name: str = "prefix_family"
) -> DataFrame:
    """Name of the longest known prefix of the route; ``known`` is a small fixed table."""
    r = F.concat(F.col(route), F.lit(" "))
    out = F.lit(None).cast("string")
    for prefix in sorted(known, key=lambda p: len(p.split(" "))):
        out = F.when(r.startswith(prefix + " "), known[prefix]).otherwise(out)
    return visits.withColumn(name, out)
