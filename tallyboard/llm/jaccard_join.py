"""Exact n-gram Jaccard join by vertical partitioning.

The global order of shingle hashes is cut into fragments (ranges). Fragments are worked on
by themselves and their counts are summed, per document and per pair:

1. Documents with the same set form one class; only classes are compared.
2. In each fragment the shingles that two classes share are found. A class that links with
   any other shares all but a quarter of its shingles, so the sums over fragments leave
   only classes that may have a link (``possible``). Half the hash space serves: at most
   n // 4 shingles of a class may be missing in it.
3. Of those, shingles are ordered from rare to common. Two linked classes share a shingle
   among the first n - ceil(0.75 n) + 1 of each. Classes with such a shingle in common are
   first compared with one leader among those of their shingles, the class with the smallest
   share of shingles of its own, and then, across components only, with each other. Pairs whose
   sizes, places of the shingle and parity bits leave too little to share are left out. So one large
   group of near copies is not compared pair by pair, and no link between components is
   passed over.
4. A pair's overlap is counted fragment by fragment and summed.

Sets are sets of 64-bit hashes. A null text, and one without words, has an empty set and is
linked with nothing; fewer than five words are one shingle. Repeated rows and equal texts
are one class. ``component_id`` ignores null doc_ids. Columns other than doc_id and text
are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.components import components
from tallyboard.llm.shared import passes, shingle_hashes, splitmix, stage_table, table, word_hashes

WORDS = 5
PASS = 2 << 20
FRAGMENT = 2_000_000
FRAGMENTS = 8
MARK = np.uint16(0xFFFF)
HALF = np.uint64(1 << 63)


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    words, bounds = word_hashes(texts)
    return [np.unique(shingle_hashes(words[s:e], WORDS)) for s, e in zip(bounds.tolist(), bounds[1:].tolist())]


def signature(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    if not len(own):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(splitmix(own).sum().view(np.int64)), int(splitmix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def heads(df: DataFrame) -> DataFrame:
    """``doc_id, n, half, s1, s2``: set size, its part in the lower half, signature."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in passes(texts, PASS):
                sets = sets_of(texts.slice(a, b - a))
                signs = [signature(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "half": pa.array([int(np.searchsorted(s, HALF)) for s in sets], pa.int64()),
                    "s1": pa.array([s[0] for s in signs], pa.int64()),
                    "s2": pa.array([s[1] for s in signs], pa.int64()),
                })

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, half long, s1 long, s2 long"
    )


def _fragments(count: int):
    """Packs the lower half of the sets of a pass by fragment.

    A hash that several classes of the pass have is resolved here: its owners are counted
    at once and a single mark is sent on, so a common shingle costs one entry per pass.
    """

    def run(batches):
        own_pass = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            for a, b in passes(texts, PASS):
                sets = {}
                for own in sets_of(texts.slice(a, b - a)):
                    if len(own):
                        sets.setdefault(signature(own)[0], own)
                held = list(sets.items())
                for at in range(0, len(held), 60_000):
                    own_pass += 1
                    part = held[at : at + 60_000]
                    signs = np.array([s for s, _ in part], np.int64)
                    lower = [s[: np.searchsorted(s, HALF)] for _, s in part]
                    owners = np.repeat(np.arange(len(part), dtype=np.uint16), [len(s) for s in lower])
                    hashes = np.concatenate(lower)
                    order = np.argsort(hashes, kind="stable")
                    hashes, owners = hashes[order], owners[order]
                    if not len(hashes):
                        continue
                    first = np.append(True, hashes[1:] != hashes[:-1])
                    alone = first & np.append(first[1:], True)
                    local = np.bincount(owners[~alone], minlength=len(part))
                    some = np.flatnonzero(local)
                    yield pa.RecordBatch.from_pydict({
                        "fragment": pa.array([-1 - own_pass % 64], pa.int32()), "pass": pa.array([own_pass], pa.int64()),
                        "signs": pa.array([signs[some].tobytes()], pa.binary()), "owners": pa.array([b""], pa.binary()),
                        "hashes": pa.array([local[some].astype(np.uint32).tobytes()], pa.binary()),
                    })
                    owners = np.where(alone, owners, MARK)[first]
                    hashes = hashes[first]
                    fragment = ((hashes >> np.uint64(31)) * np.uint64(count)) >> np.uint64(32)
                    cuts = np.searchsorted(fragment, np.arange(count + 1, dtype=np.uint64))
                    low = hashes.astype(np.uint32)
                    rows = []
                    for f in range(count):
                        s, e = cuts[f], cuts[f + 1]
                        if s == e:
                            continue
                        used, index = np.unique(owners[s:e], return_inverse=True)
                        marked = len(used) and used[-1] == MARK
                        index = np.where(owners[s:e] == MARK, MARK, index.astype(np.uint16))
                        rows.append((f, low[s:e].tobytes(), index.astype(np.uint16).tobytes(), signs[used[:-1] if marked else used].tobytes()))
                    yield pa.RecordBatch.from_pydict({
                        "fragment": pa.array([r[0] for r in rows], pa.int32()), "pass": pa.array([own_pass] * len(rows), pa.int64()),
                        "signs": pa.array([r[3] for r in rows], pa.binary()), "owners": pa.array([r[2] for r in rows], pa.binary()),
                        "hashes": pa.array([r[1] for r in rows], pa.binary()),
                    })

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Of one fragment: how many of its hashes each class shares with another class."""
    passes_, signs = group.column("pass").to_numpy(), [np.frombuffer(v.as_buffer(), np.int64) for v in group.column("signs")]
    if group.num_rows and group.column("fragment")[0].as_py() < 0:
        counts = [np.frombuffer(v.as_buffer(), np.uint32) for v in group.column("hashes")]
        return pa.table({
            "s1": pa.array(np.concatenate(signs)), "pass": pa.array(np.repeat(passes_, [len(s) for s in signs])),
            "n": pa.array(np.concatenate(counts).astype(np.int64)),
        })
    hashes = np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in group.column("hashes")])
    owners = [np.frombuffer(v.as_buffer(), np.uint16) for v in group.column("owners")]
    shift = np.cumsum([0, *(len(s) for s in signs)])
    marked = np.concatenate([o == MARK for o in owners])
    flat = np.concatenate([np.where(o == MARK, 0, o.astype(np.int64) + s) for o, s in zip(owners, shift)])
    every = np.concatenate([*signs, np.zeros(1, np.int64)])
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    sign, mark, where = every[flat[order]], marked[order], flat[order]
    low = np.where(mark, np.iinfo(np.int64).max, sign)
    high = np.where(mark, np.iinfo(np.int64).min, sign)
    shared = np.logical_or.reduceat(mark, starts) | (np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts))
    each = np.repeat(shared, np.diff(np.append(starts, len(hashes)))) & ~mark
    counts = np.bincount(where[each], minlength=len(every))
    some = np.flatnonzero(counts)
    owner_pass = np.repeat(passes_, [len(s) for s in signs])
    return pa.table({"s1": pa.array(every[some]), "pass": pa.array(owner_pass[some]), "n": pa.array(counts[some].astype(np.int64))})


def possible(df: DataFrame, classes: DataFrame, n_shingles: int) -> DataFrame:
    """The rows of ``classes`` that can have a link with another class."""
    count = max(32, -(-n_shingles // (2 * FRAGMENT)))
    packed = df.select("text").mapInArrow(
        _fragments(count), "fragment int, pass long, signs binary, owners binary, hashes binary"
    )
    partial = packed.groupBy("fragment").applyInArrow(_shared, "s1 long, pass long, n long")
    # A class in several passes is counted in full in each.
    sums = partial.groupBy("s1", "pass").agg(F.sum("n").alias("n")).groupBy("s1").agg(F.max("n").alias("shared"))
    return classes.join(sums, "s1", "left").where("coalesce(shared, 0) >= half - n div 4").drop("shared")


def sets_table(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``s1, n, bits, fragment, hashes array<long>`` of the wanted classes, FRAGMENTS rows each.

    ``bits`` has, for each of 256 ranges of hashes, whether the set has an odd number of
    them: bits that differ bound from below how many shingles two sets do not share.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        wanted.select(F.col("rep").alias("doc_id"), F.col("s1").alias("want")).hint("shuffle_hash"), "doc_id"
    )

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in passes(texts, PASS):
                out = {"s1": [], "n": [], "bits": [], "fragment": [], "hashes": []}
                for want, own in zip(batch.column("want").slice(a, b - a).to_pylist(), sets_of(texts.slice(a, b - a))):
                    if not len(own) or signature(own)[0] != want:
                        continue  # another text with the same doc_id
                    odd = np.bincount((own >> np.uint64(56)).astype(np.intp), minlength=256) & 1
                    bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    cuts = np.searchsorted(own, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61))
                    for f, part in enumerate(np.split(own, cuts)):
                        if len(part):
                            out["s1"].append(want)
                            out["n"].append(len(own))
                            out["bits"].append(bits)
                            out["fragment"].append(f)
                            out["hashes"].append(part.view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "s1": pa.array(out["s1"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "bits": pa.array(out["bits"], pa.list_(pa.int64())),
                    "fragment": pa.array(out["fragment"], pa.int32()), "hashes": pa.array(out["hashes"], pa.list_(pa.int64())),
                })

    # Rows with one doc_id and one text twice give the same fragments twice.
    found = rows.mapInArrow(run, "s1 long, n long, bits array<long>, fragment int, hashes array<long>")
    return found.dropDuplicates(["s1", "fragment"])


def prefixes(sets: DataFrame) -> DataFrame:
    """``s1, n, own, h, p``: of each class, the share of shingles that no other has, and the
    shared shingles among its first n - ceil(0.75 n) + 1 from rare to common, with the
    number of shingles before each."""
    each = sets.select("s1", "n", "bits", F.explode("hashes").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    joined = each.join(common, "h")
    ranked = joined.groupBy("s1", "n").agg(F.first("bits").alias("bits"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("by"))
    # Shingles of one class alone come first in the order and give no pair.
    keep = F.greatest(F.lit(0), F.expr("n - (3 * n + 3) div 4 + 1 - (n - size(by))")).cast("int")
    own = (F.col("n") - F.size("by")) / F.col("n")
    first = ranked.select("s1", "n", "bits", own.alias("own"), (F.col("n") - F.size("by")).alias("u"), F.posexplode(F.slice("by", 1, keep)).alias("i", "t"))
    return first.select("s1", "n", "bits", "own", "t.h", (F.col("u") + F.col("i")).alias("p"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose classes link: partial overlaps by fragment, summed."""
    left = sets.select(F.col("s1").alias("a"), F.col("n").alias("na"), "fragment", F.col("hashes").alias("ha"))
    right = sets.select(F.col("s1").alias("b"), F.col("n").alias("nb"), "fragment", F.col("hashes").alias("hb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("o")
    )
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).where(
        "100 * o >= 75 * (na + nb - o)"
    ).select("a", "b")


#: If ``h`` is the first shingle that two classes have in common, those from ``h`` on bound
#: the overlap, which must be 3/7 of the sum of the sizes. A linked pair keeps its first one.
#: What two linked sets do not share is at most 1/7 of the sum of their sizes.
NEAR = "7 * least(n - p, m - q) >= 3 * (n + m) and 7 * (" + " + ".join(
    f"bit_count(bits[{i}] ^ others[{i}])" for i in range(4)
) + ") <= n + m"


def _pairs(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
    """Distinct pairs (``a > b``) of classes of ``left`` (s1) and ``right`` (b) that share
    ``h``, differ, and can overlap enough from ``h`` on."""
    joined = left.join(right, "h").where(f"s1 <> b and {NEAR} and ({condition})")
    return joined.select(F.greatest("s1", "b").alias("a"), F.least("s1", "b").alias("b")).distinct()


def _leaders(rows: DataFrame, by: list[str]) -> DataFrame:
    """The class with the smallest share of own shingles in each group."""
    best = F.min(F.struct("own", F.xxhash64("s1").alias("r"), "s1", "n", "p", "bits"))
    return rows.groupBy(*by).agg(best.alias("t")).select(
        *by, F.col("t.s1").alias("b"), F.col("t.n").alias("m"), F.col("t.p").alias("q"), F.col("t.bits").alias("others"), F.struct("t.own", "t.r").alias("order")
    )


def _mixed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` of shingles that several components have, with their component ``c`` and the
    component ``major`` that has most rows of the shingle."""
    roots = components(links).withColumnRenamed("node", "s1")
    tagged = rows.join(roots, "s1", "left").withColumn("c", F.coalesce("root", "s1")).drop("root")
    tagged = stage_table(tagged, "tagged")
    sizes = tagged.groupBy("h", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("h").agg(F.max(F.struct("k", "c")).alias("t"), F.count("*").alias("parts")).where("parts > 1")
    return stage_table(tagged.join(mixed.select("h", F.col("t.c").alias("major")), "h"), "mixed")


def link(sets: DataFrame) -> DataFrame:
    """Links (``a, b``) between classes that join all components; see the module."""
    rows = stage_table(prefixes(sets), "prefixes")
    # Of the leaders a class can link with it meets the first one only.
    met = rows.join(_leaders(rows, ["h"]), "h").where(f"s1 <> b and {NEAR}")
    one = met.groupBy("s1").agg(F.min(F.struct("order", "b")).alias("t")).select("s1", F.col("t.b").alias("b"))
    tried = stage_table(
        one.select(F.greatest("s1", "b").alias("a"), F.least("s1", "b").alias("b")).distinct(), "pairs"
    )
    links = stage_table(overlaps(tried, sets), "links")
    # What is left is compared across components; the largest needs no pairs of its own.
    rows = _mixed(rows, links)
    other = rows.select("h", F.col("s1").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("bits").alias("others"), F.col("c").alias("d"))
    few = rows.where("c <> major").select("h", "s1", "n", "p", "bits", "c", "major")
    cross = _pairs(few, other, "c <> d and (d = major or s1 < b)").join(tried, ["a", "b"], "left_anti")
    return links.unionByName(overlaps(stage_table(cross, "pairs"), sets))


def near_components(df: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``df``."""
    top = stage_table(heads(df), "heads")
    classes = stage_table(
        top.where("n > 0").groupBy("s1", "s2", "n", "half").agg(F.min("doc_id").alias("rep")), "classes"
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    wanted = stage_table(possible(df, classes, total), "possible")
    sets = stage_table(sets_table(df, wanted), "sets")
    roots = components(link(sets))
    named = classes.join(roots.withColumnRenamed("node", "s1"), "s1", "left").withColumn("root", F.coalesce("root", "s1"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "root").select("s1", "s2", "n", "component_id")
    return top.join(ids, ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
