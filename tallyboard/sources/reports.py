"""Tables out of JSON: receipts of runs as they are written, and rows of nested reports.

Types come from the kinds that the JSON values have (numbers, texts, truth values), never
from how a text looks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How a receipt's file is named, and what a receipt must have.
RECEIPT_NAME = r"^live-eval-receipt-(?:(\d+)|.+-r\d+-(\d+))\.json$"
RECEIPT_FIELDS = ("model", "rows", "cases")
RECEIPT = (
    "model string, reasoning_effort string, cases bigint, repeats bigint, run_id string, "
    "rows array<struct<case_id: string, repeat: bigint, passed: boolean, failures: array<string>, "
    "severity: string, high_severity_miss: boolean, over_abstention: boolean, unsafe_answer: boolean, "
    "repair_count: bigint, gross_cost_usd: double, "
    "model_plan_before_semantic_repair: struct<status: string>, "
    "usage: struct<input_tokens: bigint, output_tokens: bigint, "
    "input_tokens_details: struct<cached_tokens: bigint>>>>"
)
CASE = "id string, category string, question string, expected_status string, severity string, split string, template_family string"


# --- receipts -----------------------------------------------------------------------


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, body`` of every receipt file below a folder, whole files."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body"))


def run_number(name: Column) -> Column:
    """The run number at the end of a receipt's file name; null where there is none."""
    found = F.concat(F.regexp_extract(name, RECEIPT_NAME, 1), F.regexp_extract(name, RECEIPT_NAME, 2))
    return F.nullif(found, F.lit("")).cast("bigint")


def receipt_attempts(receipts: DataFrame) -> DataFrame:
    """One row per attempt of ``file_name, body`` receipts, with what the file leaves out.

    The emitted status stands in the plan before repair and is null where there is no plan;
    cached tokens stand in the details of the input tokens. Absent flags are false, absent
    counts and costs 0, an absent severity is normal. A body that is no object, or without
    the fields that a receipt must have, fails the job with its file's name.
    """
    parsed = receipts.withColumn("r", F.from_json("body", RECEIPT))
    absent = [F.get_json_object("body", f"$.{f}").isNull() for f in RECEIPT_FIELDS]
    bad = F.col("r").isNull() | absent[0] | absent[1] | absent[2]
    fail = F.raise_error(F.concat(F.lit("not a receipt: "), "file_name")).cast("boolean")
    runs = parsed.where(F.when(bad, fail).otherwise(F.lit(True))).select(
        "file_name",
        run_number(F.col("file_name")).alias("run_number"),
        F.col("r.model").alias("model"),
        F.coalesce("r.reasoning_effort", F.lit("none")).alias("effort"),
        F.posexplode("r.rows").alias("attempt", "a"),
    )
    zero = F.lit(0).cast("bigint")

    def flag(name: str) -> Column:
        return F.coalesce(f"a.{name}", F.lit(False)).alias(name)

    def count(name: str, out: str) -> Column:
        return F.coalesce(f"a.{name}", zero).alias(out)

    named = F.when(F.col("effort").isin("none", ""), F.col("model")).otherwise(
        F.concat_ws(" · ", "model", "effort")
    )
    return runs.select(
        "file_name",
        "run_number",
        named.alias("run_label"),
        "attempt",
        F.col("a.case_id").alias("case_id"),
        F.col("a.repeat").alias("repeat"),
        flag("passed"),
        F.coalesce("a.failures", F.array().cast("array<string>")).alias("failures"),
        F.coalesce("a.severity", F.lit("normal")).alias("severity"),
        flag("high_severity_miss"),
        flag("over_abstention"),
        flag("unsafe_answer"),
        count("repair_count", "repair_count"),
        F.col("a.model_plan_before_semantic_repair.status").alias("emitted_status"),
        F.coalesce("a.gross_cost_usd", F.lit(0.0)).alias("gross_cost_usd"),
        count("usage.input_tokens", "input_tokens"),
        count("usage.input_tokens_details.cached_tokens", "cached_tokens"),
        count("usage.output_tokens", "output_tokens"),
    )


def with_cases(attempts: DataFrame, cases: DataFrame) -> DataFrame:
    """Attempts with category, expected status and split of their case, and the place of
    the run among all runs: by its number, files without a number last, then by name."""
    listed = cases.select(F.col("id").alias("case_id"), "category", "expected_status", "split")
    place = Window.orderBy(F.col("run_number").asc_nulls_last(), "file_name")
    # One row for each file.
    files = attempts.select("file_name", "run_number").distinct().withColumn("run_order", F.row_number().over(place))
    return attempts.join(listed, "case_id", "left").join(files.drop("run_number"), "file_name")


# --- rows of a JSON object -----------------------------------------------------------


def json_rows(docs: DataFrame, body: str, table: str) -> DataFrame:
    """``row`` (variant) of every element of the list ``table`` of JSON objects."""
    return _exploded(docs.select(F.variant_get(F.parse_json(body), f"$.{table}", "variant").alias("_v")), "_v").select(
        F.col("value").alias("row")
    )


def _exploded(df: DataFrame, column: str) -> DataFrame:
    """All rows of ``df`` beside ``key, value`` of the fields or elements of a variant."""
    spark = df.sparkSession
    return df.lateralJoin(spark.tvf.variant_explode(F.col(column).outer())).drop("pos")


def column_kinds(rows: DataFrame) -> DataFrame:
    """``column, type`` of rows of JSON objects: text, boolean, bigint or double.

    A column without any value is text. Texts beside numbers, or truth values beside either,
    are no type; a column with lists or objects is none either. ``type`` is null there.
    """
    cells = _exploded(rows.select(F.col("row").alias("_v")), "_v")
    kind = F.schema_of_variant("value")
    found = cells.select(
        F.col("key").alias("column"),
        F.when(kind == "STRING", "s").when(kind == "BOOLEAN", "b").when(kind == "BIGINT", "i")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "f").when(kind != "VOID", "o").alias("kind"),
    )
    seen = found.groupBy("column").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in "sbifo"])
    own = {k: F.col(k) > 0 for k in "sbifo"}
    only = {k: ~sum((F.col(o) for o in "sbifo" if o not in k), F.lit(0)).cast("boolean") for k in ("s", "b", "i", "if")}
    return seen.select(
        "column",
        F.when(only["s"], "string").when(only["b"] & own["b"], "boolean").when(only["i"] & own["i"], "bigint").when(only["if"], "double").alias("type"),
    )


def typed_rows(rows: DataFrame) -> DataFrame:
    """Rows of JSON objects as typed columns, in the order of their names.

    A column of mixed kinds, a name with other signs than lower-case letters, digits and
    underscores, or rows with other names than the rest are refused. One row for each column
    reaches the driver.
    """
    kinds = column_kinds(rows).orderBy("column").collect()
    mixed = [r["column"] for r in kinds if r["type"] is None]
    if mixed:
        raise ValueError(f"mixed column: {mixed[0]}")
    odd = [r["column"] for r in kinds if not r["column"] or r["column"].strip("abcdefghijklmnopqrstuvwxyz0123456789_")]
    if odd:
        raise ValueError(f"column name is not lower-case: {odd[0]}")
    names = [r["column"] for r in kinds]
    same = F.array_sort(F.json_object_keys(F.to_json("row"))) == F.array(*[F.lit(n) for n in names]).cast("array<string>")
    if not rows.where(~F.coalesce(same, F.lit(False))).isEmpty():
        raise ValueError("rows have different columns")
    return rows.select(*[F.variant_get("row", f"$.{r['column']}", r["type"]).alias(r["column"]) for r in kinds])


# --- the report of opening positions -------------------------------------------------

# The report that is read, and its fields.
REPORT_KIND, REPORT_VERSION = "observed_white_opening_positions", "1.1.0"
COMPRESSION = {
    "ply": "bigint", "included_visits": "bigint", "distinct_positions": "bigint", "distinct_routes": "bigint", "endpoint_compression": "double",
}
VIEW = {"denominator_games": "bigint", "distinct_positions": "bigint", "recurring_positions": "bigint", "transposing_positions": "bigint"}
POINT = {"n": "bigint", "games": "bigint", "additional_games": "bigint", "share": "double"}


def report_tables(reports: DataFrame, body: str, view: str = "all") -> dict[str, DataFrame]:
    """``views``, ``compression`` and ``coverage`` of nested reports in a JSON text column.

    Cohorts, views and ranking modes are names in the report and become columns. Coverage
    points are those of one view. Another kind or version of report fails the job.
    """
    spoken = F.struct(F.variant_get("_v", "$.kind", "string"), F.variant_get("_v", "$.version", "string"))
    wanted = F.struct(F.lit(REPORT_KIND), F.lit(REPORT_VERSION))
    cohorts = F.variant_get("_v", "$.cohorts", "variant")
    checked = F.when(spoken.eqNullSafe(wanted), cohorts).otherwise(F.raise_error(F.lit("another kind or version of report")).cast("variant"))
    parsed = reports.select(F.parse_json(body).alias("_v")).select(checked.alias("_v"))
    by_cohort = _exploded(parsed, "_v").select(F.col("key").alias("cohort"), F.col("value").alias("_b"))

    def part(df: DataFrame, carry: Sequence[str], path: str, key: str | None = None) -> DataFrame:
        inner = _exploded(df.select(*carry, F.variant_get("_b", path, "variant").alias("_v")), "_v")
        return inner.select(*carry, *([F.col("key").alias(key)] if key else []), F.col("value").alias("_b"))

    def fields(df: DataFrame, carry: Sequence[str], names: dict[str, str]) -> DataFrame:
        return df.select(*carry, *[F.variant_get("_b", f"$.{n}", t).alias(n) for n, t in names.items()])

    views = part(by_cohort, ["cohort"], "$.views", "view")
    modes = part(views.where(F.col("view") == view), ["cohort", "view"], "$.rankings", "mode")
    return {
        "views": fields(views, ["cohort", "view"], VIEW),
        "compression": fields(part(by_cohort, ["cohort"], "$.compression_by_ply"), ["cohort"], COMPRESSION),
        "coverage": fields(part(modes, ["cohort", "view", "mode"], "$.coverage_curve"), ["cohort", "view", "mode"], POINT),
    }
