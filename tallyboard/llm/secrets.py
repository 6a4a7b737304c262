"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and long hexadecimal runs in whole texts. Their
values, and every other run of credential characters that looks random, are candidates. A
run of fewer than 16 characters or with a dot is one only if a base value is equal to it;
dots at the end belong to no value, and the parts between dots are runs of their own too.
Candidate hashes are counted over distinct documents (the repositories) and distinct
sources (the owners) of the whole corpus. A value seen with many owners is a widely copied
example; one that few owners have and that looks random is taken as live. A live value is
added as a span of kind ``owned`` wherever it stands outside a base span.

A null or empty text has no spans. A null source counts as one owner of its own. Rows are
told apart by doc_id and text together: repeated rows each get the same answer and count as
one repository. Columns of the input other than doc_id, text and source are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.shared import passes, stage_table, table

#: The base patterns; a match of "assign" counts with 6 characters of value.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex"]
LEAST_VALUE = 6

#: All that a live base value can be; of it, PLAIN runs of LEAST_ALONE are candidates alone.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
PLAIN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LEAST_ALONE = 16
WORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)


def entropy(value: str) -> float:
    """Bits per character by the value's own character frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """At least 12 characters, a digit and a letter, and 3 bits per character."""
    return (
        len(value) >= 12
        and any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
        and entropy(value) >= 3
    )


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base patterns, by start, then kind."""
    found = []
    if WORDS.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def other_spans(text: str, base) -> list[tuple[int, int, str, bool]]:
    """(start, end, value, whether it is a candidate alone) of random-looking runs that no
    base span touches."""
    # Base spans by their start, and the furthest end up to each.
    starts = [s for s, *_ in base]
    furthest = list(itertools.accumulate((e for _, _, e, _ in base), max, initial=0))
    found = []
    for m in RUN.finditer(text):
        parts = {(p.start(), p.end()) for p in PLAIN.finditer(text, m.start(), m.end())}
        parts.add((m.start(), m.start() + len(m[0].rstrip("."))))
        for at, until in sorted(parts):
            value = text[at:until]
            if looks_random(value) and furthest[bisect.bisect_left(starts, until)] <= at:
                found.append((at, until, value, len(value) >= LEAST_ALONE and "." not in value))
    return found


SCAN = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, base string, row_id string, "
    "candidates array<struct<at:int,until:int,hash:string,added:boolean,live:boolean>>"
)


def scan(df: DataFrame) -> DataFrame:
    """``doc_id, source`` and the findings of each text; see ``SCAN``."""

    def run(batches):
        for batch in batches:
            for a, b in passes(batch.column("text")):
                part = batch.slice(a, b - a)
                rows = []
                for doc, source, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "source", "text"))):
                    whole = text or ""
                    base = base_spans(whole)
                    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                    held = [(s, e, digest(v.rstrip(".")), False, looks_random(v.rstrip("."))) for s, _, e, v in base]
                    held += [(s, e, digest(v), True, alone) for s, e, v, alone in other_spans(whole, base)]
                    kinds = Counter(k for _, k, _, _ in base)
                    own = hashlib.sha256(f"{doc}|{text is None}|{whole}".encode()).hexdigest()[:32] if held else None
                    rows.append({
                        "doc_id": doc, "source": source, "n_assign": kinds[0], "n_access": kinds[1], "n_hex": kinds[2],
                        "base_sha256": hashlib.sha256(joined.encode()).hexdigest(), "base": joined, "row_id": own,
                        "candidates": [dict(zip(("at", "until", "hash", "added", "live"), h)) for h in held],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    item = pa.struct([("at", pa.int32()), ("until", pa.int32()), ("hash", pa.string()), ("added", pa.bool_()), ("live", pa.bool_())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("source", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()), ("row_id", pa.string()),
        ("candidates", pa.list_(item)),
    ])
    rows = df.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, " + SCAN)


def ownership(candidates: DataFrame, wide: int = 3) -> DataFrame:
    """``hash, n_docs, n_owners, owned`` of every candidate value.

    ``candidates`` has ``row_id, source, hash, live``. Counts are combined before each
    shuffle, so a value in a third of all rows is no large group. A value is ``owned`` if
    it looks random and fewer than ``wide`` owners have it.
    """
    own = candidates.select("hash", "row_id", F.coalesce("source", F.lit("\u0000")).alias("owner"), "live").distinct()
    by_owner = own.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("live").alias("live"))
    return by_owner.groupBy("hash").agg(
        F.sum("n").alias("n_docs"), F.count("*").alias("n_owners"), F.max("live").alias("live")
    ).select("hash", "n_docs", "n_owners", (F.col("live") & (F.col("n_owners") < wide)).alias("owned"))


def find(df: DataFrame, wide: int = 3) -> DataFrame:
    """One row per row of ``df``: base counts and digest, all spans, and the numbers of
    live (owner-specific) and widely copied values in it."""
    found = stage_table(scan(df), "secrets")
    each = found.where(F.size("candidates") > 0).select(
        "row_id", "source", F.explode("candidates").alias("c")
    ).select("row_id", "source", "c.*")
    # Runs that are no candidates alone count where a base value or another run has their hash.
    known = each.where("not added or live").select("hash").distinct()
    verdict = ownership(each.join(known, "hash", "left_semi"), wide)
    extra = F.col("added") & F.col("owned")
    # A part of an added value is not added beside it: what begins before it, or with it and
    # is longer, reaches its end.
    before = Window.partitionBy("row_id", extra).orderBy("at", F.desc("until")).rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.max("until").over(before) >= F.col("until"), F.lit(False))
    spans = (
        each.drop("source").distinct().join(verdict, "hash")
        .withColumn("part", extra & part)
        .groupBy("row_id")
        .agg(
            F.array_sort(F.collect_list(F.when(extra & ~F.col("part"), F.struct("at", "until")))).alias("more"),
            F.sum((F.col("owned") & ~F.col("part")).cast("long")).alias("n_owned"),
            F.sum((F.col("n_owners") >= wide).cast("long")).alias("n_copied"),
        )
    )
    added = F.transform("more", lambda s: F.struct(s["at"].alias("at"), F.lit(4).alias("kind"), F.concat_ws(":", F.lit("owned"), s["at"], s["until"]).alias("word")))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("at"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).cast("int").alias("kind"), s.alias("word")),
    )
    # Base kinds are numbered 1 to 3 here, so an added span follows them at the same start.
    merged = F.array_sort(F.concat(base, F.coalesce(added, F.array().cast("array<struct<at:int,kind:int,word:string>>"))))
    return found.drop("candidates").join(spans, "row_id", "left").select(
        "doc_id", "source", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(merged, lambda s: s["word"]), ",").alias("spans"),
        F.coalesce("n_owned", F.lit(0)).cast("long").alias("n_owned"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).drop("source")
