"""Checks as rows: every rule gives a count of violations, zero when it holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.scalars import LOSS_CAP, RESULTS, score_from_result
from tallyboard.operators.joins import orphans, rating_asymmetries
from tallyboard.operators.windows import dealt, sequence_check
from tallyboard.schemas import FORBIDDEN_PARTS, LEAK_PATTERN

KEYS = ["provider", "game_id"]


class QualityError(ValueError):
    """A write was withheld because checks failed."""


def _unfold(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One aggregation over ``df`` as rows (check, failures)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"), F.coalesce(c, F.lit(0)).cast("bigint").alias("failures")
            )
            for n, c in counts.items()
        ]
    )
    return df.agg(rows.alias("_r")).select(F.inline("_r"))


def _one(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def run_checks(
    games: DataFrame,
    players: DataFrame,
    provider: str | None = None,
    id_length: int | None = None,
) -> DataFrame:
    """The fact-table rules as rows (check, failures).

    Both tables are read once and summed per game, players by color first. Ratings are compared per game, for a color with several rows by the
    largest of each.
    """

    def bad(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(True))

    def unless(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    required = unless(F.col("provider").isNotNull() & F.col("game_id").isNotNull())
    if provider is not None:
        required = required | bad(F.col("provider") != provider)
    if id_length is not None:
        required = required | bad(F.length("game_id") != id_length)
    required = (
        required
        | unless(F.col("result").isin(*RESULTS))
        | unless(F.col("rated"))
        | unless(F.col("variant") == "Standard")
        | unless(F.col("source_ordinal") >= 1)
        | F.col("marked_bot").isNull()
        | F.col("record_fingerprint").isNull()
        | unless(F.col("ply_count") >= 0)
    )
    results = [*RESULTS, None]  # None: any other result, which gives no score
    own = games.select(
        *KEYS,
        F.lit(1).cast("bigint").alias("games"),
        required.cast("bigint").alias("required"),
        *[
            (F.coalesce(F.col("result") == r, F.lit(False)) if r else ~F.coalesce(F.col("result").isin(*RESULTS), F.lit(False)))
            .cast("bigint")
            .alias(f"r{i}")
            for i, r in enumerate(results)
        ],
    )
    # Rows by color, of which right under each result; one row per game and color, then per game.
    by_color = players.groupBy(*KEYS, "color").agg(
        F.count("*").alias("n"),
        F.count("score").alias("scored"),
        F.sum("score").alias("total"),
        F.count_if(F.col("score") == 1).alias("won"),
        F.count_if(F.col("score") == 0).alias("lost"),
        F.max("rating").alias("rating"),
        F.max("opponent_rating").alias("opponent_rating"),
        *[
            F.count_if(
                F.col("color").isin("white", "black")
                & F.col("score").eqNullSafe(score_from_result(F.lit(r), "color"))
            ).alias(f"right{i}")
            for i, r in enumerate(results)
        ],
    )
    sides = [
        F.max(F.when(F.col("color") == c, F.col(v))).alias(f"{c}_{v}")
        for c in ("white", "black")
        for v in ("rating", "opponent_rating")
    ]
    sums = ["games", "required", "total", "won", "lost"]
    sums += [f"{v}{i}" for v in ("r", "right") for i in range(len(results))]
    # Games and colors are laid on each other and summed in one shuffle, without a join.
    both = own.unionByName(by_color, allowMissingColumns=True).groupBy(*KEYS).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("color").isNotNull(), F.col("n"))).alias("colored"),
        F.count_if(F.col("n") != 1).alias("repeated"),
        F.count_if(F.col("color").isin("white", "black")).alias("colors"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.count_if(F.col("color") == c).alias(c) for c in ("white", "black")],
        *sides,
    )
    # A null key is no game's key: its player rows are orphans.
    keyed = F.col("provider").isNotNull() & F.col("game_id").isNotNull()
    pairs = F.when(keyed, F.coalesce(F.col("colored") * F.col("games"), F.lit(0))).otherwise(0)
    wrong = sum(
        (
            F.coalesce(F.col(f"r{i}"), F.lit(0)) * (F.coalesce("rows", F.lit(0)) - F.coalesce(f"right{i}", F.lit(0)))
            for i in range(len(results))
        ),
        F.lit(0),
    )
    uneven = ~F.col("white_rating").eqNullSafe(F.col("black_opponent_rating")) | ~F.col(
        "black_rating"
    ).eqNullSafe(F.col("white_opponent_rating"))
    found = F.col("games").isNotNull()
    return _unfold(
        both,
        {
            "unique_game_keys": F.count_if(F.col("games") != 1),
            "unique_player_keys": F.sum("repeated"),
            "required_game_fields": F.sum("required"),
            "two_participants": F.count_if(found & ((pairs != 2) | (F.coalesce("colors", F.lit(0)) != 2))),
            "no_orphans": F.sum(F.when(~found | ~keyed, F.col("rows"))),
            "participant_scores": F.sum(F.when(keyed, wrong)),
            "score_conservation": F.count_if(F.col("total") != 1),
            "wins_equal_losses": F.abs(F.sum("won") - F.sum("lost")),
            "rating_symmetry": F.count_if(
                (F.col("white") > 0) & (F.col("black") > 0) & uneven
            ),
        },
    )


def reconcile_counts(
    totals: DataFrame,
    whole: str = "seen",
    parts: Sequence[str] = ("accepted", "duplicate", "excluded", "quarantine", "conflict"),
) -> DataFrame:
    """Difference between the whole and the sum of its parts, per row of totals."""
    added = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    return totals.withColumn("difference", F.abs(F.col(whole) - added))


@dataclass(frozen=True)
class Rule:
    """One declared column test: not_null, unique, accepted_values or relationships."""

    column: str
    kind: str
    values: tuple = ()
    other: DataFrame | None = None
    other_column: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"


def column_tests(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Declared tests as rows; all row-wise tests share one aggregation."""
    row_wise: dict[str, Column] = {}
    frames = []
    for r in rules:
        c = F.col(r.column)
        if r.kind == "not_null":
            row_wise[r.name] = F.count_if(c.isNull())
        elif r.kind == "accepted_values":
            row_wise[r.name] = F.count_if(c.isNotNull() & ~c.isin(*r.values))
        elif r.kind == "unique":
            repeated = df.where(c.isNotNull()).groupBy(r.column).count().where("count > 1")
            frames.append(_one(r.name, repeated))
        elif r.kind == "relationships":
            known = r.other.select(F.col(r.other_column).alias(r.column))
            frames.append(
                _one(r.name, df.where(c.isNotNull()).join(known, r.column, "left_anti"))
            )
        else:
            raise ValueError(f"unknown test {r.kind}")
    if row_wise:
        frames.append(_unfold(df, row_wise))
    return union(frames)


def model_tests(games: DataFrame, evals: DataFrame, cap: int = LOSS_CAP) -> DataFrame:
    """Family shape and move-evaluation validity."""
    opening, f = F.col("source_opening"), F.col("opening_family")
    expected = F.nullif(F.trim(F.split_part(opening, F.lit(":"), F.lit(1))), F.lit(""))
    shape = (
        F.coalesce(f.contains(":"), F.lit(False))
        | F.coalesce(f == "", F.lit(False))
        | (expected.isNull() & f.isNotNull())
        | (expected.isNotNull() & f.isNull())
    )
    loss, clamped, on = (
        F.col("centipawn_deterioration"),
        F.col("clamped_deterioration"),
        F.col("evaluable"),
    )
    invalid = (
        on.isNull()
        | (on & loss.isNull())
        | (~on & clamped.isNotNull())
        | (on & ~clamped.eqNullSafe(F.least(loss, F.lit(cap).cast("bigint"))))
        | F.coalesce(loss < 0, F.lit(False))
    )
    repeated = evals.groupBy("move_key").count().where("count > 1")
    return union(
        [
            _unfold(games, {"opening_family_shape": F.count_if(shape)}),
            _unfold(evals, {"move_evals_valid": F.count_if(invalid)}),
            _one("move_key_unique", repeated),
        ]
    )


def schema_issues(df: DataFrame, schema: T.StructType) -> list[tuple[str, str]]:
    """Missing, extra and re-typed columns against a declared schema."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema}
    out = [(n, "missing") for n in want if n not in have]
    out += [(n, "extra") for n in have if n not in want]
    out += [(n, "retyped") for n in want if n in have and have[n] != want[n]]
    return sorted(out)


def schema_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every column of the table or the contract: its status and how many values it holds."""
    issues = dict(schema_issues(df, schema))
    names = sorted({*df.columns, *schema.fieldNames()})
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                F.lit(issues.get(n, "ok")).alias("status"),
                (F.count(n) if n in df.columns else F.lit(0)).cast("bigint").alias("values"),
            )
            for n in names
        ]
    )
    return df.agg(rows.alias("_r")).select(F.inline("_r"))


def validate_moves(moves: DataFrame, games: DataFrame) -> DataFrame:
    """Sampled games whose rows do not match the stored ply count or are not 1..n."""
    checked = sequence_check(moves, KEYS).join(games.select(*KEYS, "ply_count"), KEYS)
    repeated = dealt(moves, [*KEYS, "ply"]).groupBy(*KEYS, "ply").count().where("count <> 1")
    return union(
        [
            _unfold(
                checked,
                {
                    "rows_or_last_ply": F.count_if(
                        (F.col("rows") != F.col("ply_count"))
                        | (F.col("last_ply") != F.col("ply_count"))
                    ),
                    "broken_sequence": F.count_if(~F.col("valid")),
                },
            ),
            _one("repeated_ply", repeated),
        ]
    )


def public_check(
    df: DataFrame,
    allowed: dict[str, Sequence[str]] | None = None,
    patterns: dict[str, str] | None = None,
    forbidden: Sequence[str] = FORBIDDEN_PARTS,
    leak: str = LEAK_PATTERN,
) -> DataFrame:
    """Per column: forbidden name (in any case), leaking text, values outside an allowlist or pattern."""
    counts: dict[str, Column] = {}
    for f in df.schema:
        c = F.col(f.name)
        if any(part.casefold() in f.name.casefold() for part in forbidden):
            counts[f"name:{f.name}"] = F.count("*")
        if isinstance(f.dataType, T.StringType):
            counts[f"leak:{f.name}"] = F.count_if(c.rlike(leak))
    for n, values in (allowed or {}).items():
        counts[f"allowed:{n}"] = F.count_if(F.col(n).isNotNull() & ~F.col(n).isin(*values))
    for n, pattern in (patterns or {}).items():
        counts[f"pattern:{n}"] = F.count_if(F.col(n).isNotNull() & ~F.col(n).rlike(pattern))
    return _unfold(df, counts)


def compare_reports(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Keys on which two independently built aggregates disagree; null equals null."""
    keys = list(keys)
    a = left.select(*keys, *values, F.lit(1).alias("_in")).alias("a")
    b = right.select(*keys, *values, F.lit(1).alias("_in")).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    differs = F.col("a._in").isNull() | F.col("b._in").isNull()
    for v in values:
        differs = differs | ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    return a.join(b, same, "full_outer").where(differs).select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        *[F.col(f"a.{v}").alias(f"left_{v}") for v in values],
        *[F.col(f"b.{v}").alias(f"right_{v}") for v in values],
    )


def gated_write(df: DataFrame, checks: DataFrame, path: str) -> None:
    """Write only if every check is zero; otherwise raise and write nothing."""
    failed = checks.where("failures > 0").collect()  # at most one row per rule
    if failed:
        raise QualityError(", ".join(f"{r['check']}={r['failures']}" for r in failed))
    df.write.mode("errorifexists").parquet(path)


def within_tolerance(
    expected: DataFrame, actual: DataFrame, key: str, value: str, tolerance: float
) -> DataFrame:
    """Expected keys whose value is missing, null on one side only, or too far off."""
    a = actual.select(key, F.col(value).alias("actual"), F.lit(True).alias("_here"))
    j = expected.select(key, F.col(value).alias("expected")).join(a, key, "left")
    far = F.abs(F.col("expected") - F.col("actual")) > tolerance
    wrong_null = F.col("expected").isNull() != F.col("actual").isNull()
    return j.where(F.col("_here").isNull() | wrong_null | F.coalesce(far, F.lit(False))).select(
        key, "expected", "actual"
    )


def rederive_totals(
    header: DataFrame, rows: DataFrame, run: str = "run", tolerance: float = 1e-9
) -> DataFrame:
    """One row per run and stored total that its rows do not give.

    ``header`` has the run and stored totals: rows, passed, pass_rate, cost,
    input_tokens, output_tokens, high_severity_misses, unsafe_answers,
    over_abstentions, hard_fail and cases.
    """
    got = rows.groupBy(run).agg(
        F.count("*").cast("double").alias("rows"),
        F.count_if("passed").cast("double").alias("passed"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.sum("cost").alias("cost"),
        F.sum("input_tokens").cast("double").alias("input_tokens"),
        F.sum("output_tokens").cast("double").alias("output_tokens"),
        F.count_if("high_severity_miss").cast("double").alias("high_severity_misses"),
        F.count_if("unsafe_answer").cast("double").alias("unsafe_answers"),
        F.count_if("over_abstention").cast("double").alias("over_abstentions"),
        F.bool_or("high_severity_miss").cast("double").alias("hard_fail"),
        F.count_distinct("case_id").cast("double").alias("cases"),
    )
    names = [c for c in got.columns if c != run]
    stored = header.select(run, *[F.col(n).cast("double").alias(f"_s_{n}") for n in names])
    j = stored.join(got, run, "full_outer")
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("total"), F.col(f"_s_{n}").alias("stored"), F.col(n).alias("derived")
            )
            for n in names
        ]
    )
    differs = ~F.col("stored").eqNullSafe(F.col("derived")) & ~F.coalesce(
        F.abs(F.col("stored") - F.col("derived")) <= tolerance, F.lit(False)
    )
    return j.select(run, F.inline(pairs)).where(differs)


def column_missingness(df: DataFrame, columns: Sequence[str], date: str | None = None) -> DataFrame:
    """Null counts per column, and the first and last date, from one aggregation."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"))
            for c in columns
        ]
    )
    if date is None:
        return df.agg(rows.alias("_r")).select(F.inline("_r"))
    got = df.agg(
        rows.alias("_r"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
    return got.select("first_date", "last_date", F.inline("_r"))
