"""Typed tables: declared schemas, shards, cubes, extracts and receipts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.scalars import score_from_result
from tallyboard.schemas import CUBE


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in declared order and type; a missing column raises."""
    absent = [f.name for f in schema if f.name not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_typed(
    df: DataFrame, path: str, schema: T.StructType, partition_by: Sequence[str] = ()
) -> None:
    writer = apply_schema(df, schema).write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_shards(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Many Parquet shards below one folder as one relation."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("recursiveFileLookup", "false").parquet(folder)


def union_sources(parts: Sequence[tuple[DataFrame, DataFrame, tuple]]) -> DataFrame:
    """Game index rows of several sources, each with both ratings and its source tags.

    A part is ``(games, players, (snapshot, period, file, rank, cohort))``.
    """
    from tallyboard.operators.joins import pivot_colors

    frames = []
    for games, players, (snapshot, period, file, rank, cohort) in parts:
        joined = games.join(pivot_colors(players), ["provider", "game_id"])
        frames.append(
            joined.withColumns(
                {
                    "source_snapshot_id": F.lit(snapshot),
                    "source_period": F.lit(period),
                    "source_file": F.lit(file),
                    "source_rank": F.lit(rank),
                    "source_cohort": F.lit(cohort),
                }
            )
        )
    return reduce(DataFrame.unionByName, frames)


def align_cube(cells: DataFrame, schema: T.StructType = CUBE) -> DataFrame:
    """Cells in the wide sparse schema; columns a grain does not have are null."""
    have = set(cells.columns)
    return cells.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def union_grains(cells: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [align_cube(c) for c in cells])


def write_cube(cells: Sequence[DataFrame], path: str) -> DataFrame:
    """Write all grains as one table partitioned by grain; an empty cube raises."""
    spark = cells[0].sparkSession
    union_grains(cells).write.mode("errorifexists").partitionBy("grain").parquet(path)
    cube = read_cube(spark, path)
    if cube.isEmpty():
        raise ValueError("the cube has no rows")
    return cube


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUBE).parquet(path).select(*[f.name for f in CUBE])


def replace_grains(cube: DataFrame, new: DataFrame, grains: Sequence[str]) -> DataFrame:
    """All other grains as they were, the named ones from ``new``."""
    return cube.where(~F.col("grain").isin(*grains)).unionByName(
        align_cube(new).where(F.col("grain").isin(*grains))
    )


def overwrite_grains(new: DataFrame, path: str) -> None:
    """Replace, in a stored cube, exactly the grain partitions that ``new`` holds."""
    align_cube(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "grain"
    ).parquet(path)


CASE_SCHEMA = "id string, split string, label string, question string"


def read_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).option("header", True).csv(path, sep="\t")


def labelled_text_issues(
    cases: DataFrame, labels: Sequence[str], splits: Sequence[str] = ("dev", "test")
) -> DataFrame:
    """One row of failure counts: ids, labels, splits and blank texts."""
    repeated = cases.groupBy("id").count().where("count > 1").agg(F.count("*")).scalar()
    return cases.agg(
        F.count("*").alias("cases"),
        F.count_if(~F.col("label").isin(*labels) | F.col("label").isNull()).alias("bad_label"),
        F.count_if(~F.col("split").isin(*splits) | F.col("split").isNull()).alias("bad_split"),
        F.count_if(F.coalesce(F.trim("question"), F.lit("")) == "").alias("blank"),
        (F.lit(len(set(labels))) - F.count_distinct(
            F.when(F.col("label").isin(*labels), F.col("label"))
        )).alias("labels_absent"),
    ).withColumn("repeated_ids", repeated)


def label_split_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("split", "label").agg(F.count("*").alias("cases"))


def declared_count_issues(cases: DataFrame, declared: DataFrame) -> DataFrame:
    """Where counts differ from declared ones: rows (kind, name, declared, found).

    ``declared`` has (kind, name, cases) with kind label, split or cases (name ``all``). A
    label or split that only one side has counts 0 on the other.
    """
    kinds = F.array(
        F.struct(F.lit("label").alias("kind"), F.col("label").alias("name")),
        F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")),
        F.struct(F.lit("cases").alias("kind"), F.lit("all").alias("name")),
    )
    found = cases.select(F.inline(kinds)).groupBy("kind", "name").agg(F.count("*").alias("found"))
    zero = F.lit(0).cast("bigint")
    both = declared.select("kind", "name", F.col("cases").cast("bigint").alias("declared"), zero.alias("found")).unionByName(
        found.select("kind", "name", zero.alias("declared"), "found")
    )
    sums = both.groupBy("kind", "name").agg(F.sum("declared").alias("declared"), F.sum("found").alias("found"))
    return sums.where("declared <> found")


RECEIPT_SCHEMA = (
    "run_id string, model string, cases bigint, repeats bigint, headline_passed bigint, "
    "headline_pass_rate double, known_gross_cost_usd double, high_severity_misses bigint, "
    "unsafe_answer bigint, over_abstention bigint, hard_fail boolean, "
    "token_usage struct<input_tokens: bigint, output_tokens: bigint>, "
    "rows array<struct<case_id: string, repeat: bigint, passed: boolean, status: string, "
    "category: string, severity: string, expected_status: string, emitted_status: string, "
    "failures: array<string>, high_severity_miss: boolean, unsafe_answer: boolean, "
    "over_abstention: boolean, gross_cost_usd: double, reserved_cost_usd: double, "
    "seconds: double, usage: struct<input_tokens: bigint, output_tokens: bigint>, "
    "repair_count: bigint>>"
)


def read_run_receipts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Attempt rows of nested run receipts: a JSON document per file, or one per line."""
    docs = spark.read.schema(RECEIPT_SCHEMA).option("multiLine", multi_line).json(path)
    file = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return flatten_receipts(
        docs.withColumn("file_run", F.regexp_extract(file, r"([^/]+?)(?:-receipt)?\.json$", 1))
    )


def flatten_receipts(docs: DataFrame) -> DataFrame:
    keep = [c for c in ("file_run", "run_id", "model", "cases", "repeats") if c in docs.columns]
    return (
        docs.select(*keep, F.posexplode("rows").alias("attempt", "r"))
        .select(*keep, "attempt", "r.*")
        .withColumn("input_tokens", F.col("usage.input_tokens"))
        .withColumn("output_tokens", F.col("usage.output_tokens"))
        .drop("usage")
    )


def extract_tables(
    spark: SparkSession, path: str, schemas: dict[str, T.StructType]
) -> dict[str, DataFrame]:
    """Typed tables of a JSON object of row lists, one frame per declared table."""
    whole = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in schemas.items()])
    doc = spark.read.schema(whole).option("multiLine", True).json(path)
    return {n: doc.select(F.inline(n)) for n in schemas}


def extract_table_from(docs: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Typed rows of the row list that a JSON text column holds."""
    return docs.select(F.inline(F.from_json(column, T.ArrayType(schema))))


def infer_column_types(rows: DataFrame) -> DataFrame:
    """Smallest of boolean, bigint, double, date and string that fits every non-null text.

    All columns are judged in one aggregation; a column with no value is a string.
    """

    def fits(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "boolean":
            ok = c.isin("true", "false")
        elif kind == "date":
            ok = c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & c.try_cast("date").isNotNull()
        elif kind == "bigint":
            ok = c.rlike(r"^-?\d+\z") & c.try_cast("bigint").isNotNull()
        else:
            ok = c.rlike(r"^-?\d+(\.\d+)?([eE]-?\d+)?\z")
        return F.coalesce(F.bool_and(F.when(c.isNotNull(), ok)), F.lit(False))

    def kind(name: str) -> Column:
        out = F.when(F.count(name) == 0, "string")
        for k in ("boolean", "bigint", "double", "date"):
            out = out.when(fits(name, k), k)
        return out.otherwise("string")

    pairs = F.array(
        *[F.struct(F.lit(n).alias("column"), kind(n).alias("type")) for n in rows.columns]
    )
    return rows.agg(pairs.alias("_p")).select(F.inline("_p"))


def time_spine(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date_day"))


def time_spine_of(df: DataFrame, date: str) -> DataFrame:
    """The spine from the first to the last date of a table."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.where("a is not null").select(
        F.explode(F.sequence("a", "b")).alias("date_day")
    )


def synthetic_games(ordinals: DataFrame, column: str = "id") -> DataFrame:
    """Generated games, each a pure function of its number in ``column``."""
    i = F.col(column)
    text = F.lower(F.lpad(F.hex(i), 8, "0"))
    day = F.date_add(F.lit("2013-01-01").cast("date"), (i % 400).cast("int"))
    fifth, third = i % 5, i % 3
    # Fixed values of the generated rows.
    return ordinals.select(
        F.lit("lichess").alias("provider"),
        text.alias("game_id"),
        (i + 1).alias("source_ordinal"),
        F.when(fifth == 1, "0-1")
        .when(fifth == 2, "1/2-1/2")
        .when(fifth == 3, "*")
        .otherwise("1-0")
        .alias("result"),
        F.lit(True).alias("rated"),
        F.lit("Standard").alias("variant"),
        day.alias("utc_date"),
        F.make_timestamp_ltz(
            F.year(day), F.month(day), F.day(day), F.lit(12), F.lit(0), F.lit(0), F.lit("UTC")
        ).alias("played_at"),
        F.lit("second").alias("timestamp_precision"),
        F.when(third == 0, "300+0").when(third == 1, "600+2").otherwise("180+0").alias("time_control"),
        F.when(third == 0, 300).when(third == 1, 600).otherwise(180).cast("bigint").alias("base_seconds"),
        F.when(third == 1, 2).otherwise(0).cast("bigint").alias("increment_seconds"),
        F.when(fifth == 0, "Sicilian Defense: Najdorf")
        .when(fifth == 1, "French Defense: Advance Variation")
        .when(fifth == 3, "King's Pawn Game")
        .when(fifth == 4, "Caro-Kann Defense: Classical")
        .alias("source_opening"),
        F.when(i % 11 == 0, "B90").alias("source_eco"),
        F.lit("Normal").alias("termination"),
        (i % 1000 == 0).alias("marked_bot"),
        (30 + i % 50).cast("bigint").alias("ply_count"),
        F.lit("{}").alias("headers_json"),
        F.concat(F.lit("fp-"), text).alias("record_fingerprint"),
    )


def synthetic_players(games: DataFrame) -> DataFrame:
    """The two player rows of each generated game."""
    n = F.col("source_ordinal")
    white, black = 1200 + n % 800, 1200 + (n * 3) % 800

    def side(color: str, key: Column, own: Column, other: Column) -> Column:
        return F.struct(
            F.lit(color).alias("color"),
            F.concat(F.lit("lichess:p"), F.lpad(key.cast("string"), 5, "0")).alias("player_key"),
            own.cast("bigint").alias("rating"),
            other.cast("bigint").alias("opponent_rating"),
            score_from_result("result", F.lit(color)).alias("score"),
        )

    sides = F.array(
        side("white", n % 4000, white, black), side("black", (n + 17) % 4000, black, white)
    )
    return games.select("provider", "game_id", F.inline(sides))


def synthetic_facts(spark: SparkSession, start: int, count: int) -> tuple[DataFrame, DataFrame]:
    """``count`` generated games numbered from ``start``, and their player rows."""
    if count < 1:
        raise ValueError("count must be positive")
    games = synthetic_games(spark.range(start, start + count))
    return games, synthetic_players(games)
