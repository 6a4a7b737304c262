"""Text records: framing, tags, annotations, classification and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyboard.functions import scalars as S

MARKER = '[Event "'
# The tag line and the two annotations inside a comment.
TAG_LINE = r'(?m)^\[(\w+) "((?:[^"\\]|\\.)*)"\]\r?$'
CLOCK = r"\[%clk\s+(\d+):(\d+):(\d+(?:\.\d+)?)\]"
EVAL = r"\[%eval\s+([#-]?[-\d.]+)\]"
GAME_ID = r"^https?://lichess\.org/([A-Za-z0-9]{8})\z"


def read_records(spark: SparkSession, path: str, marker: str = MARKER, by_folder: bool = False) -> DataFrame:
    """Records that start with ``marker``, with file name and 1-based ordinal per file.

    With ``by_folder`` the files of one folder are one source: their records are numbered on
    from file to file, in the order of the files' names.

    Files are split over tasks at the marker. A record's ordinal is its running number in
    its split plus the records of earlier splits; only a table with one row for each split
    is moved, no text is.
    """
    pieces = (
        spark.read.option("lineSep", "\n" + marker)
        .text(path)
        .select(
            F.col("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )
    first = (F.col("block") == 0) & F.col("value").startswith(marker)
    body = F.when(first, F.col("value")).otherwise(F.concat(F.lit(marker), F.col("value")))
    # A file may open with blank lines before the first marker.
    opened = F.ltrim(F.regexp_replace("value", r"^\s+", ""))
    framed = (
        pieces.withColumn("record", F.when(opened.startswith(marker), opened).otherwise(body))
        .where(F.trim(F.regexp_replace("value", r"\s+", "")) != "")
        .select("file", "block", "record", F.monotonically_increasing_id().alias("mono"))
    )
    sizes = framed.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("mono").alias("first")
    )
    source = F.regexp_replace("file", "/[^/]*$", "") if by_folder else F.col("file")
    before = Window.partitionBy(source).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    # One row for each split of the input, whatever its size in bytes.
    return framed.join(F.broadcast(shifts), ["file", "block"]).select(
        "file", (F.col("mono") + F.col("shift") + 1).alias("ordinal"), "record"
    )


def _head(record: Column) -> Column:
    """Lines before the first non-blank line that is not a tag line."""
    start = F.regexp_instr(record, F.lit(r"(?m)^(?:[ \t\r]+\S|[^\[\s])"))
    return F.when(start > 0, F.substring(record, F.lit(1), start - 1)).otherwise(record)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are read.

    Plain projections would be merged with what reads them, and the patterns below be
    matched again for every use; rows made by ``inline`` are not.
    """
    return df.select(
        "*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    )


def split_record(df: DataFrame, record: str = "record") -> DataFrame:
    """``head`` and ``body`` columns of a record text."""
    parts = bind(df, head=_head(F.col(record)))
    return parts.withColumn("body", F.expr(f"substr({record}, length(head) + 1)"))


def _named(df: DataFrame, record: str) -> DataFrame:
    """``_n`` names, ``_v`` values and the number of tag lines of the head."""
    head = F.col("head")
    return bind(
        split_record(df, record),
        _n=F.regexp_extract_all(head, F.lit(TAG_LINE), F.lit(1)),
        _v=F.regexp_extract_all(head, F.lit(TAG_LINE), F.lit(2)),
        _lines=F.size(F.regexp_extract_all(head, F.lit(r"(?m)^(\[)"), F.lit(1))),
    )


def parse_tags(df: DataFrame, record: str = "record") -> DataFrame:
    """``tags`` map and ``tag_reason``; a malformed or repeated tag gives the reason."""
    bad = (F.size("_n") != F.col("_lines")) | (F.size(F.array_distinct("_n")) != F.size("_n"))
    return bind(
        _named(df, record),
        tag_reason=F.when(bad, "malformed_header"),
        tags=F.when(~bad, F.map_from_arrays("_n", "_v")),
    ).drop("_n", "_v", "_lines")


def first_tags(df: DataFrame, record: str = "record") -> DataFrame:
    """Tolerant ``tags``: unreadable lines are skipped and the first of a name wins."""
    pairs = F.arrays_zip(F.col("_n").alias("n"), F.col("_v").alias("v"))
    staged = bind(_named(df, record), _p=pairs)
    keep = F.expr(
        "filter(_p, (x, i) -> i = 0 or not exists(slice(_p, 1, i), y -> y.n = x.n))"
    )
    return bind(staged, tags=F.map_from_entries(keep)).drop("_p", "_n", "_v", "_lines")


def classify_record(df: DataFrame, record: str = "record") -> DataFrame:
    """Ordered rules, first match wins: ``disposition`` and ``reason`` of each record.

    Adds the parsed tags and dates. Whether the moves are legal is not judged here.
    """
    t = parse_tags(df, record)

    def tag(name: str) -> Column:
        return F.col("tags").getItem(name)

    site = F.regexp_extract(F.coalesce(tag("Site"), F.lit("")), GAME_ID, 1)
    result = F.coalesce(F.col("result"), F.lit(""))
    bare = F.regexp_replace(F.col("body"), r"\{[^}]*\}|;[^\n]*", " ")

    def bad_rating(name: str) -> Column:
        v = F.coalesce(tag(name), F.lit("?"))
        return ~v.isin("?", "-", "") & ~v.rlike(r"^\d+\z")

    base, increment = S.time_control(tag("TimeControl"))
    staged = bind(
        t,
        game_id=F.nullif(site, F.lit("")),
        result=tag("Result"),
        _utc=S.utc_struct(tag("UTCDate"), tag("UTCTime")),
        base_seconds=base,
        increment_seconds=increment,
        # The last word of the moves once comments are gone.
        _last=F.regexp_extract(bare, r"(\S+)\s*\z", 1),
    )
    reason = (
        F.when(F.col("tag_reason").isNotNull(), F.col("tag_reason"))
        .when(F.coalesce(tag("Variant"), F.lit("Standard")) != "Standard", "unsupported_variant")
        .when(~F.coalesce(tag("Event"), F.lit("")).startswith("Rated "), "not_rated")
        .when(
            (F.coalesce(tag("SetUp"), F.lit("0")) != "0") | tag("FEN").isNotNull(),
            "nonstandard_start",
        )
        .when(F.col("game_id").isNull() | ~result.isin(*S.RESULTS), "required_header")
        .when(F.col("_last") != result, "missing_or_mismatched_termination")
        .when(F.col("_utc.invalid_utc"), "invalid_utc")
        .when(bad_rating("WhiteElo") | bad_rating("BlackElo"), "invalid_rating")
    )
    excluded = ("unsupported_variant", "not_rated", "nonstandard_start")
    return (
        bind(staged, reason=reason)
        .select(
            "*",
            *[F.col(f"_utc.{n}") for n in ("utc_date", "played_at", "timestamp_precision")],
        )
        .withColumn(
            "disposition",
            F.when(F.col("reason").isNull(), "accepted")
            .when(F.col("reason").isin(*excluded), "excluded")
            .otherwise("quarantine"),
        )
        .drop("_utc", "_last", "tag_reason", "head")
    )


def resolve_copies(
    classified: DataFrame, place: Sequence[str] = ("file", "ordinal")
) -> DataFrame:
    """Accepted records that repeat an earlier id become duplicates or conflicts.

    The first record of an id, by file and then ordinal, stays accepted; a later one is a
    duplicate if its whole text is the same, else a conflict. ``place`` names the columns
    that identify a record and order the records. Only the places of copies are joined
    back. ``classified`` is read three times: give a stored table.
    """
    from tallyboard.operators.dedupe import dedupe_or_conflict

    place = list(place)
    accepted = F.col("disposition") == "accepted"
    marked = classified.where(accepted).select(
        "game_id",
        F.struct(*place).alias("_place"),
        S.fingerprint(F.btrim("record", F.lit(" \t\r\n")).alias("text")).alias("_print"),
    )
    status = (
        dedupe_or_conflict(marked, ["game_id"], "_print", "_place")
        .where("status <> 'accepted'")
        .select("_place.*", "status")
    )
    reason = F.when(F.col("status") == "duplicate", "identical_game").when(
        F.col("status") == "conflict", "conflicting_game"
    )
    return (
        classified.join(status, place, "left")
        .withColumn("disposition", F.coalesce("status", "disposition"))
        .withColumn("reason", F.coalesce("reason", reason))
        .drop("status")
    )


def record_games(classified: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Typed game rows of the accepted records. Ply counts need a replay and are left out."""

    def tag(name: str) -> Column:
        return F.col("tags").getItem(name)

    def rating(name: str) -> Column:
        return F.when(tag(name).rlike(r"^\d+\z"), tag(name).cast("bigint"))

    bot = (tag("WhiteTitle") == "BOT") | (tag("BlackTitle") == "BOT")
    return classified.where(F.col("disposition") == "accepted").select(
        F.lit("lichess").alias("provider"),
        "game_id",
        F.col(ordinal).alias("source_ordinal"),
        "result",
        "utc_date",
        "played_at",
        "timestamp_precision",
        tag("TimeControl").alias("time_control"),
        "base_seconds",
        "increment_seconds",
        tag("Opening").alias("source_opening"),
        tag("ECO").alias("source_eco"),
        tag("Termination").alias("termination"),
        F.coalesce(
            (F.coalesce(tag("WhiteTitle"), F.lit("")) == "BOT")
            | (F.coalesce(tag("BlackTitle"), F.lit("")) == "BOT"),
            bot,
        ).alias("marked_bot"),
        F.to_json("tags").alias("headers_json"),
        S.fingerprint(F.btrim("record", F.lit(" \t\r\n")).alias("text")).alias("record_fingerprint"),
        tag("White").alias("white"),
        tag("Black").alias("black"),
        rating("WhiteElo").alias("white_rating"),
        rating("BlackElo").alias("black_rating"),
    )


def to_participants(games: DataFrame) -> DataFrame:
    """Two rows per game: own and opponent rating, score and folded key."""

    def side(color: str, other: str) -> Column:
        return F.struct(
            F.lit(color).alias("color"),
            S.player_key(color).alias("player_key"),
            F.col(f"{color}_rating").cast("bigint").alias("rating"),
            F.col(f"{other}_rating").cast("bigint").alias("opponent_rating"),
            S.score_from_result("result", F.lit(color)).alias("score"),
        )

    sides = F.array(side("white", "black"), side("black", "white"))
    return games.select("provider", "game_id", F.inline(sides))


def extract_annotations(
    df: DataFrame, body: str = "body", keys: Sequence[str] = ("file", "ordinal")
) -> DataFrame:
    """One row per annotated ply: clock in seconds, centipawns, and the mate flag.

    ``keys`` identify the record: its file and its ordinal there.

    Every comment stands for one ply, in order; a comment may lack either annotation.
    """
    comments = F.regexp_extract_all(F.col(body), F.lit(r"(\{[^}]*\})"), F.lit(1))
    plies = df.select(*keys, F.posexplode(comments).alias("_i", "comment"))
    has_clock = F.col("comment").rlike(CLOCK)

    def clock(i: int) -> Column:
        return F.regexp_extract("comment", CLOCK, i)

    seconds = F.when(
        has_clock,
        clock(1).try_cast("double") * 3600 + clock(2).try_cast("double") * 60 + clock(3).try_cast("double"),
    )
    text = F.regexp_extract("comment", EVAL, 1)
    mate = text.startswith("#")
    # Centipawns are cut toward zero, in exact decimal arithmetic.
    points = F.when(~mate & (text != ""), (text.try_cast("decimal(12,4)") * 100).cast("bigint"))
    return plies.select(
        *keys,
        (F.col("_i") + 1).alias("ply"),
        seconds.alias("clock_seconds"),
        points.alias("eval_cp"),
        mate.alias("eval_mate"),
    )


def route_dispositions(
    classified: DataFrame, place: Sequence[str] = ("file", "ordinal")
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted rows, set-aside rows with their raw text, and counts by disposition and reason."""
    accepted = classified.where(F.col("disposition") == "accepted")
    aside = classified.where(~F.col("disposition").isin("accepted", "duplicate")).select(
        *place, "disposition", "reason", F.col("record").alias("raw")
    )
    counts = classified.groupBy("disposition", "reason").agg(F.count("*").alias("records"))
    return accepted, aside, counts


IDENTITY = r'(?m)^\[LichessURL "(https://lichess\.org/[A-Za-z0-9]{8})"\]\r?$'
SITE = r'(?m)^\[Site "[^"\n]*"\]'


def restore_identity(df: DataFrame, record: str = "record", identity: str = IDENTITY) -> DataFrame:
    """Records whose id tag is the canonical address, placed as the second line.

    The first Site tag gives way to it, later ones stay. ``identity_reason`` is set, and
    the text left alone, where no address is found.
    """
    found = F.regexp_extract(record, identity, 1)
    at = F.regexp_instr(record, F.lit(SITE))
    old = F.length(F.regexp_extract(record, SITE, 0))
    text = F.col(record)
    without = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + old, F.length(text)))
    bare = F.when(at > 0, without).otherwise(text)
    cut = F.instr(bare, "\n")
    first = F.substring(bare, F.lit(1), cut - 1)
    rest = F.substring(bare, cut + 1, F.length(bare))
    rebuilt = F.concat(first, F.lit('\n[Site "'), found, F.lit('"]\n'), rest)
    return df.withColumn(
        "identity_reason", F.when(found == "", "no_unambiguous_identity")
    ).withColumn(record, F.when(found == "", F.col(record)).otherwise(rebuilt))


def first_complete(records: DataFrame, n: int, place: Sequence[str] = ("file", "ordinal")) -> DataFrame:
    """The first ``n`` records of each file; of a file that ends before, not its open last one."""
    *file, ordinal = place
    last = records.groupBy(*file).agg(F.max(ordinal).alias("_last"))
    # One row for each file.
    joined = records.join(F.broadcast(last), file) if file else records.crossJoin(F.broadcast(last))
    return joined.where((F.col(ordinal) <= n) & (F.col(ordinal) < F.col("_last"))).drop("_last")


def raw_recount(classified: DataFrame) -> DataFrame:
    """The game metrics again, straight from tags and texts, bypassing the fact tables."""

    def tag(name: str) -> Column:
        return F.col("tags").getItem(name)

    opening = tag("Opening")
    done = tag("Result").isin(*S.COMPLETED)
    bot = (F.coalesce(tag("WhiteTitle"), F.lit("")) == "BOT") | (
        F.coalesce(tag("BlackTitle"), F.lit("")) == "BOT"
    )
    blank = F.coalesce(F.trim(opening), F.lit("")) == ""
    label = F.trim(F.regexp_extract(opening, r"^([^:]*)", 1))
    rows = classified.where(F.col("disposition") == "accepted")
    return rows.agg(
        F.count("*").alias("accepted_games"),
        F.count_if(done & ~bot).alias("eligible_games"),
        F.count_if(done & ~bot & (tag("Result") == "1/2-1/2")).alias("drawn_games"),
        F.count_if(done & ~bot & ~blank & (label != "")).alias("known_opening_games"),
        F.count_if(blank).alias("missing_source_opening"),
    )
