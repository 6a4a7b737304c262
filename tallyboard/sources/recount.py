"""The published counts once more, straight from record texts.

Nothing here is shared with the readers of annotations, the move facts or the metrics: a
record's comments become arrays, and what stands before a move is looked up in them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header(text: Column, name: str) -> Column:
    """The value of a header line; null where there is no such line."""
    line = rf'(?m)^\[{name} "([^"]*)"\]\s*$'
    return F.when(text.rlike(line), F.regexp_extract(text, line, 1))


def completed(text: Column) -> Column:
    titles = [F.coalesce(header(text, f"{side}Title"), F.lit("")) != "BOT" for side in ("White", "Black")]
    return F.coalesce(header(text, "Result").isin("1-0", "0-1", "1/2-1/2"), F.lit(False)) & titles[0] & titles[1]


def label(text: Column) -> Column:
    """The opening's family: what stands before the first colon."""
    return F.nullif(F.trim(F.split_part(header(text, "Opening"), F.lit(":"), F.lit(1))), F.lit(""))


def recount_clocks(records: DataFrame, text: str = "text") -> DataFrame:
    """``clock_bucket, eligible_moves, evaluable_moves, proxy_errors, mate_transition_moves``.

    Every move has one comment. A clock above the base time of a game without increment is
    unknown. Moves count in completed games without bots and without increment.
    """
    raw = F.col(text)
    control = F.regexp_extract(F.coalesce(header(raw, "TimeControl"), F.lit("")), r"^(\d+)\+0$", 1)
    base = F.nullif(control, F.lit("")).cast("double")
    games = records.where(completed(raw) & base.isNotNull()).select(
        base.alias("base"), F.regexp_extract_all(raw, F.lit(r"\{([^}]*)\}"), F.lit(1)).alias("notes")
    )

    def clock(note: Column) -> Column:
        parts = [F.nullif(F.regexp_extract(note, r"\[%clk (\d+):(\d+):(\d+(?:\.\d+)?)\]", i), F.lit("")).cast("double") for i in (1, 2, 3)]
        seconds = parts[0] * 3600 + parts[1] * 60 + parts[2]
        return F.when(seconds <= F.col("base"), seconds)

    def centipawns(note: Column) -> Column:
        found = F.nullif(F.regexp_extract(note, r"\[%eval (-?\d+(?:\.\d+)?)\]", 1), F.lit(""))
        return F.round(found.cast("double") * 100).cast("bigint")

    seen = games.select(
        F.transform("notes", clock).alias("clocks"),
        F.transform("notes", centipawns).alias("evals"),
        F.transform("notes", lambda n: n.contains("[%eval #")).alias("mates"),
    )
    # Place i counts from 1; a move's own side moved two places before.
    moves = seen.select("*", F.posexplode("clocks").alias("i0", "_c")).select(
        F.when(F.col("i0") >= 2, F.col("clocks")[F.col("i0") - 2]).alias("left"),
        F.when(F.col("i0") >= 1, F.col("evals")[F.col("i0") - 1]).alias("was"),
        F.col("evals")[F.col("i0")].alias("now"),
        (F.col("mates")[F.col("i0")] | F.coalesce(F.when(F.col("i0") >= 1, F.col("mates")[F.col("i0") - 1]), F.lit(False))).alias("mate"),
        F.when(F.col("i0") % 2 == 0, 1).otherwise(-1).alias("side"),
    )
    left = F.col("left")
    bucket = F.when(left < 10, "under_10").when(left < 30, "10_to_29").when(left < 60, "30_to_59").otherwise("60_plus")
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    return moves.where(left.isNotNull()).groupBy(bucket.alias("clock_bucket")).agg(
        F.count("*").alias("eligible_moves"),
        F.count_if(both).alias("evaluable_moves"),
        F.count_if(both & (F.col("side") * (F.col("was") - F.col("now")) >= 200)).alias("proxy_errors"),
        F.count_if("mate").alias("mate_transition_moves"),
    )


def recount_cohorts(
    records: DataFrame, families: Sequence[str], control: str, low: int, high: int, text: str = "text"
) -> DataFrame:
    """``family, color, games, wins, draws, losses`` of players rated low to below high."""
    raw = F.col(text)
    sides = F.array(*[
        F.struct(F.lit(side.lower()).alias("color"), header(raw, f"{side}Elo").alias("elo"), F.lit(won).alias("won"))
        for side, won in (("White", "1-0"), ("Black", "0-1"))
    ])
    rows = records.where(completed(raw) & header(raw, "TimeControl").eqNullSafe(control)).select(
        label(raw).alias("family"), header(raw, "Result").alias("result"), F.inline(sides)
    )
    elo = F.when(F.col("elo").rlike(r"^\d+$"), F.col("elo").cast("bigint"))
    drawn, won = F.col("result") == "1/2-1/2", F.col("result") == F.col("won")
    return rows.where(F.col("family").isin(*families) & (elo >= low) & (elo < high)).groupBy("family", "color").agg(
        F.count("*").alias("games"), F.count_if(won).alias("wins"), F.count_if(drawn).alias("draws"), F.count_if(~won & ~drawn).alias("losses")
    )
