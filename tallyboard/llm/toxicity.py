"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, of the whole word and of its first letters.
Filters of width 1, 2 and 3 run over the words of a whole text; the largest answer of each
filter, wherever it stands, feeds a logistic output. The net is fitted on all labelled rows
that are not held out. In each epoch shards of about ``SHARD`` rows go on from one net, each
in a task of its own, and their changes are averaged by Spark. A fifth of the rows is left
out of the fit; on all of it the output is calibrated and a threshold is found for each
language.

Labels, language, source and doc_id are no inputs of a score. Null and empty texts are
scored like a text without known words. Repeated rows get equal scores. Of several labels
of a document the highest counts.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.shared import PUNCTUATION, passes, stage_table, table, word_hashes

#: Rows, about, that a net is fitted on before it is averaged with those of other shards.
SHARD = 4096
BUCKETS = 1 << 18
SIZE = 8
FILTERS = 8
WIDTHS = [1, 2, 3]
HEAD = 5
EPOCHS = 3
RATE = 0.03
CUT = 0.7
#: Labels that may be broadcast (12 bytes each); beyond it texts are shuffled.
BROADCAST_ROWS = 1_000_000
#: Buckets whose changes are averaged together.
BLOCK = 1024
#: Steps of a logit of 1 that the calibration tells apart.
GRID = 1024


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word and of its head, as two rows; where each text begins)."""
    words, bounds, heads = word_hashes(texts, PUNCTUATION, HEAD)
    return np.stack([words % np.uint64(BUCKETS // 2), heads % np.uint64(BUCKETS // 2) + np.uint64(BUCKETS // 2)]).astype(np.int32), bounds


class Net:
    """Weights, training and scoring."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.embed = np.zeros((BUCKETS, SIZE), np.float32)
        self.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        self.slope, self.level = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def start(self, counts: np.ndarray, totals: np.ndarray, rng) -> None:
        """Embeddings of the words seen in ``counts`` rows of each class, of ``totals``: first
        the log odds of the classes, drawn towards 0 by two standard errors and clipped, then
        small noise. A bucket that was never seen stays zero."""
        seen = counts.sum(0) > 0
        odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
        error = np.sqrt((1 / (counts + 0.5)).sum(0))
        sure = np.sign(odds) * np.maximum(np.abs(odds) - 2 * error, 0)
        self.embed[seen] = rng.normal(0, 0.02, (int(seen.sum()), SIZE))
        self.embed[seen, 0] = np.clip(sure, -3, 3)[seen] / 3
        for f in self.filters:
            f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5

    def answers(self, ids: np.ndarray, bounds: np.ndarray):
        """The answers of all filters at all places, one zero word after each text."""
        n_docs = len(bounds) - 1
        place = np.arange(ids.shape[1]) + np.repeat(np.arange(n_docs), np.diff(bounds))
        x = np.zeros((ids.shape[1] + n_docs, SIZE), np.float32)
        x[place] = self.embed[ids[0]] + self.embed[ids[1]]
        starts = bounds[:-1] + np.arange(n_docs)
        ends = bounds[1:] + np.arange(n_docs)  # the zero word of each text
        parts = []
        for width, f in zip(WIDTHS, self.filters):
            z = x @ f[0]
            for j in range(1, width):
                more = np.zeros_like(z)
                more[:-j] = (x @ f[j])[j:]
                # Words of the next text are no neighbours.
                for back in range(j - 1):
                    at = ends - back - 1
                    more[at[at >= starts]] = 0
                more[ends] = 0
                z += more
            parts.append(z)
        return x, starts, np.concatenate(parts, 1) + self.bias

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        _, starts, z = self.answers(ids, bounds)
        pooled = np.maximum(np.maximum.reduceat(z, starts, axis=0), 0)
        return (pooled @ self.out + self.shift).astype(np.float64)

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(ids, bounds) + self.level, -30, 30)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, rng, rate: float) -> None:
        """Plain stochastic gradient steps, one text at a time, through the pooled places."""
        for i in rng.permutation(len(docs)):
            ids = docs[i]
            x, _, z = self.answers(ids, np.array([0, ids.shape[1]]))
            best = z.argmax(0)
            pooled = np.maximum(z[best, np.arange(z.shape[1])], 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))
            error = np.float32(p - labels[i])
            back = error * self.out * (pooled > 0)
            self.out -= rate * (error * pooled + 1e-4 * self.out)
            self.shift -= rate * error
            self.bias -= rate * back
            at = 0
            for width, f in zip(WIDTHS, self.filters):
                for k in range(FILTERS):
                    g, start = back[at + k], int(best[at + k])
                    if g == 0:
                        continue
                    for j in range(min(width, len(x) - start)):
                        change = rate * g * f[j, :, k]
                        f[j, :, k] -= rate * g * x[start + j]
                        if start + j < ids.shape[1]:
                            self.embed[ids[:, start + j]] -= change
                at += FILTERS

    def dense(self) -> np.ndarray:
        """All weights but the embeddings."""
        return np.concatenate([*(f.ravel() for f in self.filters), self.bias, self.out, [self.shift]]).astype("<f4")

    def move(self, steps: pa.Table) -> None:
        """Add the changes of an epoch."""
        for part, at, change in zip(*(steps.column(c).to_pylist() for c in ("part", "at", "change"))):
            change = np.frombuffer(change, "<f4")
            if part >= 0:
                self.embed[np.frombuffer(at, "<i4")] += change.reshape(-1, SIZE)
                continue
            sizes = [*(f.size for f in self.filters), self.bias.size, self.out.size]
            *filters, bias, out, shift = np.split(change, np.cumsum(sizes))
            for f, c in zip(self.filters, filters):
                f += c.reshape(f.shape)
            self.bias += bias
            self.out += out
            self.shift += shift[0]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, n: np.ndarray, langs: list[str]) -> None:
        """A logistic fit of labels on logits (a little shrunk), each ``n`` times, then for each
        language the threshold with the best F1, midway between neighbouring scores."""
        slope, level, weight = 1.0, 0.0, n / n.sum()
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(slope * logits + level, -30, 30)))
            slope -= 0.05 * (weight @ ((p - labels) * logits) + 1e-3 * (slope - 1))
            level -= 0.05 * (weight @ (p - labels) + 1e-3 * level)
        self.slope, self.level = float(max(slope, 1e-3)), float(level)
        scores = 1 / (1 + np.exp(-np.clip(self.slope * logits + self.level, -30, 30)))
        langs = np.array(langs, object)
        for lang in sorted(set(langs)):
            own = langs == lang
            if len(set(labels[own].tolist())) < 2:
                continue
            s, at = np.unique(-scores[own], return_inverse=True)
            s, every = -s, np.bincount(at, n[own])
            hits = np.cumsum(np.bincount(at, n[own] * labels[own]))
            k = int(np.argmax(2 * hits / (np.cumsum(every) + hits[-1])))
            below = s[k + 1] if k + 1 < len(s) else 0.0
            self.thresholds[lang] = float((s[k] + below) / 2)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """``doc_id, toxic, lang, text, h, outer``: all rows with a label that are not held out;
    ``outer`` ones are left out of the fit. Of several labels the highest counts."""
    number = F.col("doc_id").cast("long").alias("doc_id")
    known = (
        labels.select(number, F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    )
    known = stage_table(known, "known")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(number, "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).where(~held_out())
    return stage_table(rows.join(known, "doc_id").select(
        "doc_id", "toxic", "lang", "text", F.xxhash64("doc_id", "text").alias("h"),
        (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0).alias("outer"),
    ), "labelled")


def ids_of(texts: pa.Array):
    """(first row, ids, bounds) of each pass over ``texts``."""
    for a, b in passes(texts):
        yield a, *word_ids(texts.slice(a, b - a))


def seen_words(rows: DataFrame) -> np.ndarray:
    """In how many rows of each class (0, 1) each bucket stands."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            labels = batch.column("toxic").to_numpy()
            for a, ids, bounds in ids_of(batch.column("text")):
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                once = np.unique((owner * BUCKETS + ids).ravel())
                for y in (0, 1):
                    counts[y] += np.bincount((once % BUCKETS)[labels[a + once // BUCKETS] == y], minlength=BUCKETS)
        some = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n0": pa.array(counts[0, some]), "n1": pa.array(counts[1, some])})

    found = rows.select("toxic", "text").mapInArrow(run, "bucket int, n0 long, n1 long")
    sums = found.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    counts[:, sums.column("bucket").to_numpy()] = sums.column("n0").to_numpy(), sums.column("n1").to_numpy()
    return counts


def epoch_steps(rows: DataFrame, net: Net, shards: int, rate: float, seed: list[int]) -> pa.Table:
    """``part, at, change``: what one epoch over all ``rows`` changes.

    Each shard of the rows goes on from ``net`` by itself. The embedding of a bucket moves by
    the mean of the shards that moved it, all else (part -1) by the mean over all rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)  # bounded: BUCKETS * SIZE floats

    def fit(key, group):
        shard = key[0].as_py()
        group = group.sort_by([("doc_id", "ascending"), ("h", "ascending")])
        docs = []
        for _, ids, bounds in ids_of(group.column("text").combine_chunks()):
            docs += [ids[:, s:e] for s, e in zip(bounds, bounds[1:])]
        base, own = shared.value, copy.deepcopy(shared.value)
        own.fit(docs, group.column("toxic").to_numpy(), np.random.default_rng([*seed, shard]), rate)
        moved = own.embed - base.embed
        some = np.flatnonzero(moved.any(1))
        parts, starts = np.unique(some // BLOCK, return_index=True)
        at = [a.astype("<i4") for a in np.split(some, starts[1:])] if len(some) else []
        out = [(-1, b"", (own.dense() - base.dense()).tobytes())]
        out += [(int(p), a.tobytes(), moved[a].tobytes()) for p, a in zip(parts, at)]
        part, at, change = zip(*out)
        return pa.table({
            "shard": pa.array([shard] * len(out), pa.int64()), "n": pa.array([len(docs)] * len(out), pa.int64()),
            "part": pa.array(part, pa.int32()), "at": pa.array(at, pa.binary()), "change": pa.array(change, pa.binary()),
        })

    def mean(key, group):
        part = key[0].as_py()
        group = group.sort_by("shard")
        changes = [np.frombuffer(c, "<f4").astype(float) for c in group.column("change").to_pylist()]
        if part < 0:
            at, change = b"", np.average(changes, axis=0, weights=group.column("n").to_numpy())
        else:
            total, times = np.zeros((BLOCK, SIZE)), np.zeros(BLOCK)
            for places, c in zip(group.column("at").to_pylist(), changes):
                places = np.frombuffer(places, "<i4") - part * BLOCK
                total[places] += c.reshape(-1, SIZE)
                times[places] += 1
            some = np.flatnonzero(times)
            at, change = (some + part * BLOCK).astype("<i4").tobytes(), total[some] / times[some, None]
        return pa.table({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.binary()), "change": pa.array([change.astype("<f4").tobytes()], pa.binary())})

    dealt = rows.select("doc_id", "toxic", "text", "h", F.pmod("h", F.lit(shards)).alias("shard")).repartition(shards, "shard")
    moves = dealt.groupBy("shard").applyInArrow(fit, "shard long, n long, part int, at binary, change binary")
    steps = stage_table(moves.groupBy("part").applyInArrow(mean, "part int, at binary, change binary"), "steps").toArrow()  # bounded like the net
    shared.unpersist()
    return steps


def outer_logits(rows: DataFrame, net: Net) -> pa.Table:
    """``lang, toxic, logit, n``: how many rows have which logit, in steps of 1 / GRID."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # bounded: BUCKETS * SIZE floats

    def run(batches):
        for batch in batches:
            for a, ids, bounds in ids_of(batch.column("text")):
                n = len(bounds) - 1
                steps = np.rint(np.clip(shared.value.logits(ids, bounds), -30, 30) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "lang": batch.column("lang").slice(a, n), "toxic": batch.column("toxic").slice(a, n), "step": pa.array(steps),
                })

    found = rows.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic int, step int")
    # At most 60 * GRID steps for each language and class.
    return found.groupBy("lang", "toxic", "step").agg(F.count("*").alias("n")).orderBy("lang", "toxic", "step").select(
        "lang", "toxic", (F.col("step") / F.lit(float(GRID))).alias("logit"), "n"
    ).toArrow()


def train(docs: DataFrame, labels: DataFrame, seed: int = 1) -> Net:
    """A net fitted on all labelled rows that are not held out.

    A fifth of the documents, by a hash of doc_id, is left out of the fit and calibrates the
    output. Where a class has no rows there is nothing to learn, and every text scores 0.5.
    """
    rows = labelled(docs, labels, seed)
    sizes = {(r["outer"], r["toxic"]): r["count"] for r in rows.groupBy("outer", "toxic").count().collect()}  # at most 4 rows
    net, rng = Net(seed), np.random.default_rng(seed)
    if len({toxic for _, toxic in sizes}) < 2:
        return net
    totals = np.array([sizes.get((False, 0), 0), sizes.get((False, 1), 0)])
    if totals.sum():
        inner, rate = rows.where("not outer"), RATE
        net.start(seen_words(inner), totals, rng)
        for epoch in range(EPOCHS):
            net.move(epoch_steps(inner, net, -(-int(totals.sum()) // SHARD), rate, [seed, epoch]))
            rate *= 0.5
    if sum(sizes.values()) > totals.sum():
        seen = outer_logits(rows.where("outer"), net)
        net.calibrate(*(seen.column(c).to_numpy() for c in ("logit", "toxic", "n")), seen.column("lang").to_pylist())
    return net


def score(df: DataFrame, net: Net, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``df`` with a score (0 to 1) and a prediction (1 from CUT on) under ``names``; columns
    of these names are replaced."""
    keep = [c for c in df.columns if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(net)  # bounded: BUCKETS * SIZE floats

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column("text")
            for a, b in passes(texts):
                scores = own.score(*word_ids(texts.slice(a, b - a)))
                columns = {c: batch.column(c).slice(a, b - a) for c in keep}
                yield pa.RecordBatch.from_pydict(
                    columns | dict(zip(names, (pa.array(scores), pa.array((scores >= CUT).astype(np.int32)))))
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.select(*keep).mapInArrow(run, kept + f", `{names[0]}` double, `{names[1]}` int")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; ``lang_predicted`` uses the threshold of its language."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    limit = F.lit(CUT)
    for lang, value in net.thresholds.items():
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return score(docs.select("doc_id", "lang", "text"), net).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted",
        limit.alias("lang_threshold"), (F.col("score") >= limit).cast("int").alias("lang_predicted"),
    )
