"""Byte-level BPE encoding and decoding with the ranks of a vocabulary file.

Texts are cut by :mod:`pretoken`; the distinct pre-tokens are merged by ascending rank and
kept in a bounded cache. Ids keep the byte offset at which each token ends, so any run of
ids can be decoded to its place in the text.

Null and empty texts have no ids. Rows are worked on one by one: repeated rows, ties and
further columns change nothing. Texts are whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm import pretoken
from tallyboard.llm.shared import passes, table


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read on the driver: lines of base64 bytes and a rank.

    Its size is bounded by the vocabulary (under 1 MB for 50,000 entries).
    """
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    def __init__(self, data: bytes):
        self.ranks = {}
        for line in data.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.pieces = pretoken.Pieces(self.encode_pieces)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none can be merged."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self._merge_long(parts)
        none = len(ranks) + (1 << 40)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for a very long piece, with a heap: n log n steps."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = left + right, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [ranks[p] for p, there in zip(parts, alive) if there]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [self.merge(p.encode()) for p in pieces]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        return self.data[pretoken.spread(self.starts[ids], sizes)].tobytes()


@lru_cache(maxsize=2)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def _with(batch: pa.RecordBatch, keep: list[str], fields: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in keep if n not in fields} | fields
    return pa.RecordBatch.from_pydict(columns)


def _schema(df: DataFrame, keep: list[str], added: str) -> str:
    new = {p.split()[0] for p in added.split(", ")}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep and f.name not in new]
    return ", ".join([*kept, added])


def encode(df: DataFrame, vocabulary: bytes, text: str = "text") -> DataFrame:
    """``df`` with ``ids array<int>`` and ``ends array<int>`` (byte offset after each token).

    Columns of ``df`` with these names are replaced.
    """
    keep = [c for c in df.columns]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: one vocabulary

    def run(batches):
        own = _vocabulary(shared.value)
        for batch in batches:
            texts = batch.column(text)
            for a, b in passes(texts):
                part = batch.slice(a, b - a)
                values = [t or "" for t in part.column(text).to_pylist()]
                ids, bounds = pretoken.encode_texts(values, own.pieces)
                sizes = own.lengths[ids]
                ends = np.cumsum(sizes)
                base = np.concatenate([[0], ends])[bounds[:-1]]
                ends = ends - np.repeat(base, np.diff(bounds))
                offsets = pa.array(bounds.astype(np.int32))
                yield _with(part, keep, {
                    "ids": pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    "ends": pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32))),
                })

    return df.mapInArrow(run, _schema(df, keep, "ids array<int>, ends array<int>"))


def decode(df: DataFrame, vocabulary: bytes) -> DataFrame:
    """``df`` with ``decoded binary``, the bytes of ``ids``; checked against ``ends``."""
    keep = [c for c in df.columns]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = _vocabulary(shared.value)
        for batch in batches:
            lists, ends = batch.column("ids"), batch.column("ends")
            out = []
            for i in range(len(lists)):
                if not lists[i].is_valid:
                    out.append(None)
                    continue
                ids = lists[i].values.to_numpy()
                data = own.decode(ids)
                if len(ids) and ends[i].values[-1].as_py() != len(data):
                    raise ValueError("ids and offsets do not belong together")
                out.append(data)
            yield _with(batch, keep, {"decoded": pa.array(out, pa.binary())})

    return df.mapInArrow(run, _schema(df, keep, "decoded binary"))


def ids_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256)


def digests(df: DataFrame) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of encoded and decoded rows."""
    return df.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": ids_digest(),
        "decoded_sha256": F.sha2(F.col("decoded"), 256),
    })


def round_trip(df: DataFrame, vocabulary: bytes, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``ids array<int>`` and ``decoded_sha256``, the digest of
    the bytes that the ids decode to.

    The same as :func:`encode`, :func:`decode` and a digest, in one worker and one text at a
    time, so neither texts nor decoded bytes travel back. Columns with these names are replaced.
    """
    keep = [c for c in df.columns if c != text]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: one vocabulary

    def run(batches):
        own = _vocabulary(shared.value)
        for batch in batches:
            texts = batch.column(text)
            for a, b in passes(texts):
                ids, bounds = pretoken.encode_texts([t or "" for t in texts.slice(a, b - a).to_pylist()], own.pieces)
                ends = np.concatenate([[0], own.ends(ids)])[bounds]
                out = []
                for i in range(b - a):
                    data = own.decode(ids[bounds[i] : bounds[i + 1]])
                    if len(data) != ends[i + 1] - ends[i]:
                        raise ValueError("ids and offsets do not belong together")
                    out.append(hashlib.sha256(data).hexdigest())
                yield _with(batch.slice(a, b - a), keep, {
                    "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    "decoded_sha256": pa.array(out, pa.string()),
                })

    return df.mapInArrow(run, _schema(df, keep, "ids array<int>, decoded_sha256 string"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, decoded and digested."""
    import public_tokenizers

    vocabulary = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs, vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), "decoded_sha256")
