"""Line dedup over a suffix array of line ids, built by distributed prefix doubling.

The corpus is the sequence of the non-blank lines of all documents, in ascending doc_id,
with an end after each document. Suffixes are ranked by their first 1, 2, 4, ... lines: the
rank after a doubling comes from the ranks of the two halves. Suffixes with equal ranks
after k doublings form an interval whose common prefix has at least 2**k lines. A suffix
that is alone in its interval begins no repeated run and is dropped, so each round works on
the repeated part only; the rounds end when no two suffixes are left in one interval.

A run of lines counts as repeated where it has ``min_lines`` lines, or ``min_chars``
characters. Of every interval of such runs the first copy (by doc_id, then place) stays,
and the lines of the later ones are deleted. Deleted runs that touch are one maximal run.

Null and empty texts have no lines and stay as they are; blank lines are no part of a run
and stay. A null doc_id orders before all others. Rows equal in doc_id and text count as
one document. Further columns are carried along, except those in ``ADDED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.shared import stage_table, table

ADDED = ["n_lines", "n_removed", "longest_run"]
KEY = ["k", "th"]
SPLIT = 1 << 16


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with the keys of its documents: doc_id (null first) and a hash of the text."""
    return df.withColumns({
        "k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64(F.col("text"))
    })


def smaller(counts: DataFrame, group: list[str], coarse: Column, order: list[str]) -> DataFrame:
    """``counts`` with ``before``: the sum of ``n`` over smaller rows of the same group.

    ``coarse`` is a coarser order over ``order``: sums of its values are added up first,
    so no window holds more than the rows of one value or the values of one group.
    """
    split = counts.withColumn("_c", coarse)
    sums = split.groupBy(*group, "_c").agg(F.sum("n").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*group, "_c", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_s"))
    inner = Window.partitionBy(*group, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        split.withColumn("_i", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(shifts, [*group, "_c"]).withColumn("before", F.col("_s") + F.col("_i")).drop("_c", "_i", "_s")
    )


def line_ids(df: DataFrame) -> DataFrame:
    """``k, th, pos, chars, h1, h2``: the non-blank lines, numbered in each document."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda s: F.trim(s) != "")
    rows = df.select(*KEY, F.posexplode(lines).alias("pos", "line"))
    return rows.select(
        *KEY, "pos", F.length("line").alias("chars"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
    )


def levels(lines: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """(depth, ``k, th, pos, chars, r, first``) for the depths 1, 2, 4, ... and min_lines.

    Rows with equal ``r`` are an interval of at least two suffixes that have ``depth`` lines
    in common; ``r`` is the number of kept suffixes before the interval in suffix order,
    ``chars`` the length of the common run and ``first`` whether the row is its first copy.
    """
    place = F.struct(*KEY, "pos")
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    ranks = smaller(ids, [], F.shiftright("h1", 48), ["h1", "h2"])
    level = stage_table(
        lines.join(ranks, ["h1", "h2"]).select(*KEY, "pos", "chars", F.col("before").alias("r"), (place == F.col("least")).alias("first")),
        "suffixes",
    )
    out, depth = [(1, level)], 1
    while True:
        if depth < min_lines < 2 * depth:
            out.append((min_lines, lengthened(level, min_lines - depth, depth)))
        level = lengthened(level, depth, depth)
        depth *= 2
        if level.isEmpty():
            return out
        out.append((depth, level))


def lengthened(level: DataFrame, step: int, depth: int) -> DataFrame:
    """Intervals of ``depth + step`` lines, from those of ``depth`` lines (step <= depth).

    Both halves of a repeated run are repeated, so suffixes that were dropped never return.
    """
    place = F.struct(*KEY, "pos")
    tail = level.select(*KEY, (F.col("pos") - step).alias("pos"), F.col("chars").alias("more"), F.col("r").alias("b"))
    pairs = level.drop("first").withColumnRenamed("r", "a").join(tail, [*KEY, "pos"])
    seen = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    ranks = smaller(seen, ["a"], F.floor(F.col("b") / SPLIT), ["b"])
    # Overlapping halves serve min_lines alone, where the length does not matter.
    chars = F.col("chars") + F.col("more") if step == depth else F.col("chars")
    return stage_table(
        pairs.join(ranks, ["a", "b"]).select(
            *KEY, "pos", chars.alias("chars"), (F.col("a") + F.col("before")).alias("r"), (place == F.col("least")).alias("first")
        ),
        "suffixes",
    )


def removals(df: DataFrame, min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """``k, th, gone, n_removed, longest``: the stretches of deleted lines of each document
    (``first`` to before ``end``), their lines, and the length of the longest one."""
    runs = None
    for depth, level in levels(line_ids(df), min_lines):
        counts = F.lit(depth >= min_lines) | (F.col("chars") >= min_chars)
        found = level.where(~F.col("first") & counts).select(*KEY, "pos", F.lit(depth).alias("depth"))
        runs = found if runs is None else runs.unionByName(found)
    # Of the runs beginning at one place the longest covers the others.
    starts = runs.groupBy(*KEY, "pos").agg(F.max("depth").alias("depth"))
    # Runs that overlap or touch are one stretch: it begins where no earlier run reaches.
    along = Window.partitionBy(*KEY).orderBy("pos")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("pos") + F.col("depth"))
    marked = starts.withColumn("fresh", F.coalesce(F.col("pos") > reach.over(before), F.lit(True)).cast("int"))
    numbered = marked.withColumn("stretch", F.sum("fresh").over(along))
    stretches = numbered.groupBy(*KEY, "stretch").agg(F.min("pos").alias("first"), reach.alias("end"))
    size = F.col("end") - F.col("first")
    return stretches.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("first", "end"))).alias("gone"), F.sum(size).alias("n_removed"), F.max(size).alias("longest")
    )


def dedup_lines(df: DataFrame, min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """``df`` with later copies of repeated runs deleted from ``text``, and the numbers of
    non-blank lines and of deleted ones, and the longest deleted run, of each row."""
    # Further columns go along in one, so that none of them clashes with a name used here.
    more = [c for c in df.columns if c not in ("doc_id", "text", *ADDED)]
    rest = F.struct(*more) if more else F.lit(0)
    rows = keyed(df.select("doc_id", "text", rest.alias("rest")))
    base = rows.select(*KEY, "text")
    if not rows.groupBy(*KEY).count().where("count > 1").isEmpty():
        base = base.dropDuplicates(KEY)
    gone = stage_table(removals(base, min_lines, min_chars), "removed")
    joined = rows.join(gone.hint("shuffle_hash"), KEY, "left")
    lines = F.split(F.col("text"), "\n")
    # Where the non-blank lines stand, those of the stretches among them, and the others.
    full = F.filter(F.transform(lines, lambda s, i: F.when(F.trim(s) != "", i)), lambda i: i.isNotNull())
    lost = F.flatten(F.transform("gone", lambda g: F.slice("_full", g["first"] + 1, g["end"] - g["first"])))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), lost)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    joined = joined.withColumn("_lines", lines).withColumn("_full", full)
    return joined.select(
        "doc_id", text.alias("text"), "rest",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.coalesce(F.size("_full"), F.lit(0))).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
    ).select("doc_id", "text", *([F.col("rest.*")] if more else []), *ADDED)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines, deleted lines, longest deleted run, digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", *ADDED, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
