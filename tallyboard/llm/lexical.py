"""Ranked lexical search with sorted accesses only (NRA).

Terms are the runs of characters other than ASCII blanks, signs and punctuation, A-Z in
lower case. One pass over the texts keeps, for every document, its length and the counts of
the terms that some item asks for. A second pass cuts the documents into shards of at most
``SHARD`` and, in each, lays out one list per term, sorted by descending impact. An item
reads its lists from the top in growing steps. Of each document met it holds a lower end
(impacts read so far) and an upper end (the next impact of every list that has not shown it
added). A list is read on while an unseen document could still enter, or while a document
that could still be among the best has not been met in it. At the end every document that
can matter has equal ends, so members, ties and scores are exact. A task carries an item's
best documents from shard to shard, so later shards stop early.

Items are worked in blocks of at most about ``ITEMS``, which bounds what is broadcast.

Documents are rows: repeated rows are documents of their own, a null doc_id orders last. A
null or empty text has no terms. Rows of ``items`` with equal id and text count once; an
item without terms, or whose terms no document has, gives no rows. Columns other than id
and text are left out. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.shared import passes, reach, stage_table, table, word_hashes

#: Documents of one shard: the impact-sorted lists of one are held by a task.
SHARD = 8192
#: Items that are broadcast together.
ITEMS = 2000
#: Cells of the table of terms by documents that one search holds; long items get smaller shards.
CELLS = 1 << 26
#: First step of a list; each further step is as long as all before it.
STEP = 256
BEST = 20
#: Bytes between terms.
BETWEEN = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    BETWEEN[_low : _high + 1] = True


class Items(NamedTuple):
    """Distinct term hashes in order; term numbers and counts of each item; item ids."""

    terms: np.ndarray
    ids: list
    numbers: list[np.ndarray]
    counts: list[np.ndarray]


class Corpus(NamedTuple):
    """Documents with a term, all their terms, documents of each asked term."""

    documents: int
    length: int
    holding: np.ndarray


def read_items(rows: list) -> Items:
    """Terms of (id, text) rows, whole texts."""
    found, bounds = word_hashes(pa.array([r[1] for r in rows], pa.large_string()), BETWEEN)
    terms, at = np.unique(found, return_inverse=True)
    numbers, counts = [], []
    for s, e in zip(bounds.tolist(), bounds[1:].tolist()):
        own, n = np.unique(at[s:e], return_counts=True)
        numbers.append(own)
        counts.append(n.astype(np.int64))
    return Items(terms, [r[0] for r in rows], numbers, counts)


def held_terms(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id, n_terms, numbers, counts``: what each document with terms has of the asked ones."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)  # bounded by ITEMS

    def run(batches):
        terms = shared.value
        for batch in batches:
            texts = batch.column("text")
            for a, b in passes(texts):
                found, bounds = word_hashes(texts.slice(a, b - a), BETWEEN)
                owner = np.repeat(np.arange(b - a), np.diff(bounds))
                place = np.minimum(np.searchsorted(terms, found), max(len(terms) - 1, 0))
                asked = terms[place] == found if len(terms) else np.zeros(len(found), bool)
                cell, n = np.unique(owner[asked] * len(terms) + place[asked], return_counts=True)
                row, number = np.divmod(cell, max(len(terms), 1))
                kept = np.flatnonzero(np.diff(bounds))
                offsets = pa.array(np.append(np.searchsorted(row, kept), len(cell)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(kept)).cast(pa.int64()),
                    "n_terms": pa.array(np.diff(bounds)[kept].astype(np.int64)),
                    "numbers": pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int32))),
                    "counts": pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_terms long, numbers array<int>, counts array<int>")


def corpus_of(held: DataFrame, n_terms: int) -> Corpus:
    """Sums over all documents; as many rows reach the driver as there are asked terms."""

    def run(batches):
        sums = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            sums[0] += len(batch)
            sums[1] += batch.column("n_terms").to_numpy().sum()
            numbers = batch.column("numbers").flatten().to_numpy()
            sums[2:] += np.bincount(numbers, minlength=n_terms)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"k": pa.array(there), "v": pa.array(sums[there])})

    sums = np.zeros(n_terms + 2, np.int64)
    for row in held.select("n_terms", "numbers").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[row["k"]] = row["v"]
    return Corpus(int(sums[0]), int(sums[1]), sums[2:])


def weights(corpus: Corpus) -> np.ndarray:
    return np.floor(1000 * np.log((2 * corpus.documents + 2) / (2 * corpus.holding + 1))).astype(np.int64)


class Lists(NamedTuple):
    """Impact-sorted lists of a shard: of term t the rows ``first[t]`` to ``first[t + 1]``."""

    first: np.ndarray
    doc: np.ndarray
    impact: np.ndarray


def lists_of(n_terms: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray, corpus: Corpus, weight: np.ndarray) -> Lists:
    """``sizes`` of ``numbers`` and ``counts`` belong to each document of the shard."""
    scale = 100 - 25 + (25 * n_terms.astype(np.int64) * corpus.documents) // max(corpus.length, 1)
    doc = np.repeat(np.arange(len(n_terms)), sizes)
    tf = counts.astype(np.int64)
    impact = weight[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 12 * scale[doc]))
    order = np.lexsort((-impact, numbers))
    return Lists(np.searchsorted(numbers[order], np.arange(len(weight) + 1)), doc[order], impact[order])


def search(lists: Lists, n_docs: int, terms: np.ndarray, repeats: np.ndarray, best: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that hold all of the shard's ``best`` highest scores of at least
    ``floor`` and above 0, ties included; every score is exact.

    Only sorted accesses: list by list from the highest impact down.
    """
    first, stop = lists.first[terms], lists.first[terms + 1]
    there = stop > first
    terms, repeats, first, stop = terms[there], repeats[there], first[there], stop[there]
    at = first.copy()
    low = np.zeros(n_docs, np.int64)
    met = np.zeros((len(terms), n_docs), bool)
    seen = np.zeros(n_docs, bool)
    bound = repeats * lists.impact[first] if len(terms) else np.zeros(0, np.int64)  # of what is next in each list
    wanted = np.arange(len(terms))
    while True:
        for t in wanted.tolist():
            a = at[t]
            b = min(stop[t], a + max(STEP, a - first[t]))
            own = lists.doc[a:b]
            low[own] += repeats[t] * lists.impact[a:b]  # a list shows a document once
            met[t, own] = True
            seen[own] = True
            at[t] = b
            bound[t] = repeats[t] * lists.impact[b] if b < stop[t] else 0
        docs = np.flatnonzero(seen)
        least = floor
        if len(docs) >= best:
            least = max(floor, int(np.partition(low[docs], len(docs) - best)[len(docs) - best]))
        least = max(least, 1)
        open_ = bound > 0
        high = low[docs] + bound @ ~met[:, docs]
        docs = docs[high >= least]
        if bound.sum() >= least:
            wanted = np.flatnonzero(open_)  # an unseen document could still enter
        else:
            wanted = np.flatnonzero(open_ & ~met[:, docs].all(1))
        if not len(wanted):
            return docs, low[docs]


def rank_shards(held: DataFrame, items: Items, corpus: Corpus, best: int, shard: int) -> DataFrame:
    """``item, doc_id, score``: each task's best documents of each item."""
    context = held.sparkSession.sparkContext
    shared = context.broadcast((items.numbers, items.counts, corpus))  # bounded by ITEMS
    shard = min(shard, max(64, CELLS // max([1, *map(len, items.numbers)])))

    def run(batches):
        numbers, counts, corpus = shared.value
        weight = weights(corpus)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(numbers)

        def work(parts):
            rows = pa.Table.from_batches(parts).combine_chunks()
            ids = rows.column("doc_id").combine_chunks()
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            held_numbers = rows.column("numbers").combine_chunks()
            sizes = held_numbers.value_lengths().to_numpy()
            lists = lists_of(
                rows.column("n_terms").to_numpy(), sizes, held_numbers.flatten().to_numpy(),
                rows.column("counts").combine_chunks().flatten().to_numpy(), corpus, weight,
            )
            for i, (terms, n) in enumerate(zip(numbers, counts)):
                had_id, had, had_null = found[i]
                floor = int(had[-1]) if len(had) >= best else 0
                docs, scores = search(lists, len(ids), terms, n, best, floor)
                if len(docs):
                    both = np.concatenate([had_id, ids[docs]]), np.concatenate([had, scores]), np.concatenate([had_null, absent[docs]])
                    order = np.lexsort((both[0], both[2], -both[1]))[:best]
                    found[i] = tuple(v[order] for v in both)

        parts, n = [], 0
        for batch in batches:
            start = 0
            while start < len(batch):
                take = batch.slice(start, shard - n)
                parts.append(take)
                n, start = n + len(take), start + len(take)
                if n == shard:
                    work(parts)
                    parts, n = [], 0
        if parts:
            work(parts)
        sizes = [len(f[1]) for f in found]
        if sum(sizes):
            ids, scores, absent = (np.concatenate(v) for v in zip(*found))
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(np.repeat(np.arange(len(found)), sizes)), "doc_id": pa.array(ids, mask=absent), "score": pa.array(scores),
            })

    return held.mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, shard: int = SHARD, block: int = ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's highest-scoring documents."""
    spark = docs.sparkSession
    reach(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    if blocks > 1:
        asked = stage_table(asked, "items")
    out = None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in asked.where(F.col("_block") == b).collect()]  # one block
        own = read_items(rows)
        held = stage_table(held_terms(docs, own), "terms")
        found = rank_shards(held, own, corpus_of(held, len(own.terms)), best, shard)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = spark.createDataFrame([(i, item) for i, item in enumerate(own.ids)], "item long, item_id long")
        top = top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        top = stage_table(top, "ranked") if blocks > 1 else top
        out = top if out is None else out.unionByName(top)
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
