"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Centres are fitted on a bounded sample, and every vector is put into the list of its nearest
centre. A list of any size is cut into blocks. Where a block meets queries, both are turned
by one random rotation and read in blocks of ``COLUMNS`` dimensions. After d of D dimensions
the partial squared distance of a pair is held against the distance that the query's present
``best``-th score allows: a difference of squared length r shows, under a random rotation,
a share of r in d dimensions that is Beta(d/2, (D-d)/2) distributed, so a pair whose partial
distance is beyond r * (mean + Z deviations) is abandoned. What is left after all dimensions
gets its inner product on the original vectors, in double precision.

A query first scans the best eighth of its lists and then, with the score reached, the
others. How many lists are probed is calibrated on the sample for a share of ``TARGET`` of
its exact neighbours; these lie further off than those among all rows, so the share among
all rows is higher. Rows of the search are not sampled.

Vectors that are null, zero, or hold a null or a non-finite number take no part, nor do
those whose dimension is not the most frequent one (of several, the largest), nor rows with a
null vec_id. Rows with one vec_id count as one candidate, by their best score, and as one
query. Further columns are left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.shared import reach, splitmix, stage_table, table

BEST = 20
COLUMNS = 16
#: Deviations beyond the mean share at which a pair is abandoned.
Z = 3.0
TARGET = 0.96
MAX_LISTS = 1024
#: Sampled vectors for each list.
PER_LIST = 32
#: Vectors and queries that meet in one task.
BLOCK = 8192
QUERIES = 2048
#: Vectors of one step; the first, smaller step gives a first score to beat.
STEP, FIRST = 2048, 256
ROUNDS = 10
SEED = 7


class Index(NamedTuple):
    """Fitted on the sample: centres, rotation and the number of lists to probe."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """(``vec_id, embedding`` of the rows that take part, their dimension, their number)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
    return rows.where(F.size("embedding") == dim), dim, n


def order_lists(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lists of each query, the most promising first."""
    return np.argsort(-(queries @ centres.T), axis=1, kind="stable")


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(vectors @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


def fit(sample: np.ndarray, lists: int, best: int, target: float) -> Index:
    """Lloyd's rounds on the sample, then the number of lists that ``target`` asks for."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:lists]].copy()
    for _ in range(ROUNDS):
        own = nearest_centre(sample, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    rotation, upper = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))
    asked = rng.permutation(len(sample))[:256]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(best, max(len(sample) - 1, 1))]
    place = np.argsort(order_lists(sample[asked], centres), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest_centre(sample, centres)[near], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    return Index(centres, rotation * np.sign(np.diag(upper)), probes)


def build(rows: DataFrame, dim: int, n: int, best: int, target: float) -> Index:
    """The index, from at most 2 * MAX_LISTS * PER_LIST rows chosen by a hash of their id."""
    lists = int(min(MAX_LISTS, max(1, round(n**0.5))))
    wanted = lists * PER_LIST
    share = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, wanted / n) * (1 << 30)) + 1
    sample = rows.where(share).limit(2 * wanted).select("embedding").toArrow()
    if not len(sample):
        sample = rows.limit(1).select("embedding").toArrow()
    held = matrix(sample.column("embedding"), dim)
    return fit(held[np.lexsort(held.T)], lists, best, target)


def listed(rows: DataFrame, dim: int, index: Index) -> DataFrame:
    """``list, salt, vec_id, embedding``: every vector in its list; salts deal it to blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # at most MAX_LISTS centres

    def run(batches):
        done, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            own = nearest_centre(matrix(batch.column("embedding"), dim), shared.value.centres)
            with np.errstate(over="ignore"):
                salt = splitmix(np.arange(done, done + len(batch), dtype=np.uint64) + (np.uint64(part + 1) << np.uint64(40)))
            done += len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array((salt >> np.uint64(1)).astype(np.int64)), batch.column("vec_id"), batch.column("embedding")],
                ["list", "salt", "vec_id", "embedding"],
            )

    return rows.mapInArrow(run, "list int, salt long, vec_id long, embedding array<double>")


def probing(rows: DataFrame, dim: int, index: Index) -> DataFrame:
    """``query_id, embedding, early, late``: the lists of each query, best eighth first."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        cut = -(-own.probes // 8)
        for batch in batches:
            order = order_lists(matrix(batch.column("embedding"), dim), own.centres).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(list(order[:, :cut]), pa.list_(pa.int32())),
                 pa.array(list(order[:, cut : own.probes]), pa.list_(pa.int32()))],
                ["query_id", "embedding", "early", "late"],
            )

    return rows.mapInArrow(run, "query_id long, embedding array<double>, early array<int>, late array<int>")


def keep_best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, best: int) -> np.ndarray:
    """Rows of each query's ``best`` ids, by score, then id; an id counts once."""
    order = np.lexsort((ids, -scores, query))
    q, i = query[order], ids[order]
    again = np.lexsort((np.arange(len(order)), i, q))
    first = np.ones(len(order), bool)
    first[again[1:]] = (q[again][1:] != q[again][:-1]) | (i[again][1:] != i[again][:-1])
    order = order[first]
    q = query[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return order[place < best]


def scan(
    vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, rotation: np.ndarray,
    best: int = BEST, columns: int = COLUMNS, z: float = Z, read: list | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the best of a block for each query, by adaptive dimension scan.

    ``least`` is the score that each query has reached elsewhere (minus infinity: none).
    ``read`` gets the number of (pair, dimension) cells that were read.
    """
    dim = vectors.shape[1]
    turned, asked = vectors @ rotation, queries @ rotation
    ends = [*range(columns, dim, columns), dim]
    # Squared lengths of the first d dimensions, by column blocks.
    lengths = [np.zeros(len(turned))] + [(turned[:, :e] ** 2).sum(1) for e in ends]
    asked_lengths = [np.zeros(len(asked))] + [(asked[:, :e] ** 2).sum(1) for e in ends]
    least = least.copy()
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start = 0
    while start < len(vectors):
        stop = start + (FIRST if start == 0 else STEP)
        part = slice(start, min(stop, len(vectors)))
        # Squared distances that reach the present score; tiny slack for rounding.
        whole = asked_lengths[-1][:, None] + lengths[-1][part]
        limit = whole * (1 + 1e-9) - 2 * least[:, None]
        at, row, col, begin = None, None, None, 0
        for block, end in enumerate(ends, 1):
            if at is None:
                partial = asked_lengths[block][:, None] + lengths[block][part] - 2 * (asked[:, :end] @ turned[part, :end].T)
                cells = partial.size
            else:
                dot = np.einsum("ij,ij->i", asked[row, begin:end], turned[part][col, begin:end])
                partial = at + (asked_lengths[block] - asked_lengths[block - 1])[row] + (lengths[block] - lengths[block - 1])[part][col] - 2 * dot
                cells = len(row)
            if read is not None:
                read.append(cells * (end - begin))
            share = end / dim
            room = share + z * np.sqrt(2 * share * (1 - share) / (dim + 2))
            if at is None:
                keep = partial <= limit * room
                row, col = np.nonzero(keep)
                at = partial[keep]
                limit = limit[keep]
            else:
                keep = partial <= limit * room
                row, col, at, limit = row[keep], col[keep], partial[keep], limit[keep]
            begin = end
        own = ids[part][col] != query_ids[row]
        row, col = row[own], col[own]
        scores = np.empty(len(row))
        for a in range(0, len(row), 1 << 16):
            b = a + (1 << 16)
            scores[a:b] = (queries[row[a:b]] * vectors[part][col[a:b]]).sum(1)
        near = scores >= least[row]
        found = tuple(np.concatenate([x, y]) for x, y in zip(found, (row[near], ids[part][col[near]], scores[near])))
        kept = keep_best(*found, best)
        found = tuple(v[kept] for v in found)
        full, n = np.unique(found[0], return_counts=True)
        last = np.cumsum(n) - 1
        least[full[n == best]] = np.maximum(least[full[n == best]], found[2][last[n == best]])
        start = stop
    return found


def meet(vectors: DataFrame, queries: DataFrame, dim: int, index: Index, best: int) -> DataFrame:
    """``query_id, vec_id, score`` from the lists of the queries (``list, query_id, embedding, least``).

    Blocks of a list meet blocks of its queries; either has a bounded number of rows.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    held = vectors.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    asked = queries.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    sizes = F.broadcast(held.join(asked, "list"))  # one row for each list, at most MAX_LISTS
    zero = F.lit(0).cast("long")
    left = vectors.join(sizes, "list").select(
        "list", F.pmod("salt", "parts").alias("part"), F.explode(F.sequence(zero, F.col("turns") - 1)).alias("turn"), "vec_id", "embedding"
    )
    right = queries.join(sizes, "list").select(
        "list", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id", "embedding"), "turns").alias("turn"),
        "query_id", "embedding", "least",
    )

    def run(block: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(block) or not len(asking):
            row, ids, scores, names = (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))
        else:
            names = asking.column("query_id").to_numpy()
            row, ids, scores = scan(
                matrix(block.column("embedding"), dim), block.column("vec_id").to_numpy(), matrix(asking.column("embedding"), dim),
                names, asking.column("least").to_numpy(), shared.value.rotation, best,
            )
        return pa.table({"query_id": names[row], "vec_id": ids, "score": scores})

    keys = ["list", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, best: int = BEST, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found for each row of ``queries``.

    ``queries`` has vec_id and embedding; a query's own vec_id is no candidate.
    """
    spark = vectors.sparkSession
    reach(spark)
    rows, dim, n = usable(vectors)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(rows, dim, n, best, target)
    own = stage_table(listed(rows, dim, index), "lists")
    asking, asked_dim, _ = usable(queries)
    asking = asking.where(F.size("embedding") == dim).dropDuplicates()
    asked = stage_table(probing(asking, dim, index), "probes")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)

    none = F.lit(float("-inf"))
    early = asked.select(F.explode("early").alias("list"), "query_id", "embedding", none.alias("least"))
    first = stage_table(meet(own, early, dim, index, best), "near")
    reached = ranked(first).where(F.col("rank") == best).select("query_id", F.col("score").alias("least"))
    late = asked.join(reached, "query_id", "left").select(
        F.explode("late").alias("list"), "query_id", "embedding", F.coalesce("least", none).alias("least")
    )
    more = meet(own, stage_table(late, "late"), dim, index, best)
    return ranked(first.unionByName(more)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
