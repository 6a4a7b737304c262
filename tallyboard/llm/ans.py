"""Token-id output as static range-ANS blocks.

All blocks share one frequency table, counted over the whole corpus. A block holds whole
documents, is encoded by itself over interleaved lanes, and keeps checkpoints (states of
all lanes and the place in the word stream) from which decoding can start as well as a
checksum of its ids. Blocks are stored as rows, so Spark's writer gives the commit and
retry behaviour and any store Spark can write to will do.

Layout of a block (little endian): ``magic, n_ids, lanes, every, n_checkpoints, n_words,
crc32`` as 7 unsigned 32-bit numbers; for each checkpoint its word offset (32 bits) and the
state of each lane (64 bits); then the words (32 bits). Id i is in lane ``i % lanes`` of
step ``i // lanes``; checkpoint c stands before step ``c * every``.
"""

from __future__ import annotations

import itertools
import os
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm import pretoken
from tallyboard.llm.shared import passes, stage_table, table

MAGIC = 0x534E4152
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
EVERY = 128
BLOCK_IDS = 1 << 18
#: Pre-tokens that the library gets as one text.
JOINED = 1000


class Frequencies(NamedTuple):
    """Scaled counts (sum 2**20), their running sums and the id of each slot."""

    count: np.ndarray
    below: np.ndarray
    slot: np.ndarray


def scaled(counts: np.ndarray) -> Frequencies:
    """Counts scaled to 2**20, at least 1 for each id that occurs."""
    seen = counts > 0
    room = (1 << SCALE_BITS) - int(seen.sum())
    if room < 0:
        raise ValueError("too many different ids for the frequency table")
    total = int(counts.sum())
    out = np.zeros(len(counts), np.int64)
    if total:
        share = counts.astype(np.float64) / total * room
        out[seen] = 1 + np.floor(share[seen]).astype(np.int64)
        out[int(np.argmax(counts))] += (1 << SCALE_BITS) - int(out.sum())
    below = np.cumsum(out) - out
    return Frequencies(out.astype(np.uint64), below.astype(np.uint64), np.repeat(np.arange(len(out), dtype=np.int32), out))


def encode_block(ids: np.ndarray, table: Frequencies, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block; ids may be empty."""
    n = len(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    count, below = table.count[ids], table.below[ids]
    words, marks, sent = [], [], 0
    shift, limit = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    for s in range(steps - 1, -1, -1):
        f, c = count[s * lanes : (s + 1) * lanes], below[s * lanes : (s + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << limit)
        if full.any():
            out = x[full].astype(np.uint32)[::-1]
            words.append(out)
            sent += len(out)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << shift) + (x - q * f) + c
        if s % every == 0:
            marks.append((sent, state.copy()))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    head = np.array([MAGIC, n, lanes, every, len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
    parts = [head.tobytes()]
    for at, lane_states in reversed(marks):
        parts += [np.array([len(stream) - at], "<u4").tobytes(), lane_states.astype("<u8").tobytes()]
    return b"".join([*parts, stream.astype("<u4").tobytes()])


def decode_block(block: bytes, table: Frequencies, checkpoint: int | None = None) -> np.ndarray:
    """The ids of a block, or those from one checkpoint up to the next.

    A whole block is held against its checksum; a damaged one raises ``ValueError``.
    """
    head = np.frombuffer(block, "<u4", 7)
    magic, n, lanes, every, n_marks, n_words, crc = (int(v) for v in head)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    size = 4 + 8 * lanes
    stream = np.frombuffer(block, "<u4", n_words, 28 + n_marks * size)
    mark = checkpoint or 0
    if n_marks == 0:
        return np.zeros(0, np.int32)
    at = int(np.frombuffer(block, "<u4", 1, 28 + mark * size)[0])
    state = np.frombuffer(block, "<u8", lanes, 32 + mark * size).astype(np.uint64)
    first, steps = mark * every, -(-n // lanes)
    last = steps if checkpoint is None else min(steps, first + every)
    out = np.zeros(min(n, last * lanes) - first * lanes, np.int32)
    mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for s in range(first, last):
        wide = min(lanes, n - s * lanes)
        x = state[:wide]
        slot = x & mask
        found = table.slot[slot.astype(np.intp)]
        out[(s - first) * lanes : (s - first) * lanes + wide] = found
        x = table.count[found] * (x >> shift) + slot - table.below[found]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << np.uint64(32)) | stream[at : at + len(need)].astype(np.uint64)
            at += len(need)
        state[:wide] = x
    if checkpoint is None and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("the checksum of a block does not hold")
    return out


@lru_cache(maxsize=1)
def _pieces(data: bytes) -> pretoken.Pieces:
    """Encodes pre-tokens with the tokenizers library.

    The library cuts a text by the same pattern and encodes each pre-token by itself, so
    distinct pre-tokens need the library only once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(data.decode())
    own.encode_special_tokens = True
    vocabulary = own.get_vocab()
    lengths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
    for token, number in vocabulary.items():
        lengths[number] = len(token)  # a byte-level token has one sign for each byte

    def encode(pieces):
        # A blank and letters are a pre-token wherever they stand before the next such one:
        # these go to the library as one text, whose ids are dealt out by their bytes.
        plain = [p[:1] == " " and p[1:].isalpha() for p in pieces]
        some = list(itertools.compress(pieces, plain))
        joined = own.encode_batch_fast(["".join(some[a : a + JOINED]) for a in range(0, len(some), JOINED)], add_special_tokens=False)
        ids = [i for e in joined for i in e.ids]
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in some), np.int64, len(some)))
        at = np.concatenate([[0], np.searchsorted(np.cumsum(lengths[ids]), ends, "left") + 1]) if some else [0]
        dealt = iter([ids[a:b] for a, b in zip(at, at[1:])])
        others = iter([e.ids for e in own.encode_batch_fast([p for p, is_plain in zip(pieces, plain) if not is_plain], add_special_tokens=False)])
        return [next(dealt if is_plain else others) for is_plain in plain]

    return pretoken.Pieces(encode)


def tokenize(df: DataFrame, tokenizer: bytes, end_id: int, parts: int | None = None) -> DataFrame:
    """``doc_id, part, place, n_tokens, ids``: rows sorted by doc_id inside ranges of doc_id.

    ``ids`` are unsigned 16-bit numbers, ``place`` counts the ids of the same part before
    the row. A null text counts as empty and has the end id alone. Null doc_ids come first,
    equal ones in the order of their texts. Further columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)  # bounded: one vocabulary

    def run(batches):
        pieces, part, place = _pieces(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in passes(texts):
                values = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                ids, bounds = pretoken.encode_texts(values, pieces)
                sizes = np.diff(bounds)
                whole = np.insert(ids, bounds[1:], end_id).astype("<u2")
                ends = np.cumsum(sizes + 1)
                offsets = np.concatenate([[0], ends * 2]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                    "part": pa.array(np.full(b - a, part, np.int32)),
                    "place": pa.array(place + ends - sizes - 1),
                    "n_tokens": pa.array(sizes + 1),
                    "ids": data,
                })
                place += int(ends[-1])

    rows = df.select("doc_id", "text")
    # Rows of one id are dealt by how their texts begin, which agrees with their order.
    keys = ["doc_id", F.left("text", F.lit(64))]
    rows = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(
        run, "doc_id long, part int, place long, n_tokens long, ids binary"
    )


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id over all rows; at most ``size`` numbers reach the driver."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column("ids"):
                counts += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=size)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(there), "n": pa.array(counts[there])})

    out = np.zeros(size, np.int64)
    found = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for row in found.collect():
        out[row["id"]] = row["n"]
    return out


def encode_blocks(tokens: DataFrame, counts: np.ndarray) -> DataFrame:
    """``part, start, doc_ids, sizes, block``: whole documents, about 2**18 ids to a block.

    ``start`` counts all ids before the block: the place in its part plus the sums of the
    parts before, a table with one row for each part.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        table = scaled(shared.value)

        def block(rows):
            ids = np.concatenate([np.frombuffer(r[4], "<u2") for r in rows])
            return {
                "part": pa.array([rows[0][0]], pa.int32()),
                "place": pa.array([rows[0][1]], pa.int64()),
                "doc_ids": pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
                "sizes": pa.array([[r[3] for r in rows]], pa.list_(pa.int64())),
                "block": pa.array([encode_block(ids, table)], pa.binary()),
            }

        held, n, follows = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "doc_id", "n_tokens", "ids"))):
                if held and (n >= BLOCK_IDS or (row[0], row[1]) != follows):
                    yield pa.RecordBatch.from_pydict(block(held))
                    held, n = [], 0
                held.append(row)
                n += row[3]
                follows = (row[0], row[1] + row[3])
        if held:
            yield pa.RecordBatch.from_pydict(block(held))

    blocks = tokens.mapInArrow(run, "part int, place long, doc_ids array<long>, sizes array<long>, block binary")
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    return blocks.join(F.broadcast(shifts), "part").select(  # bounded: one row for each part
        "part", (F.col("place") + F.col("_shift")).alias("start"), "doc_ids", "sizes", "block"
    )


def read_blocks(blocks: DataFrame, counts: np.ndarray) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from its block."""
    shared = blocks.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        table = scaled(shared.value)
        for batch in batches:
            for start, docs, sizes, block in zip(*(batch.column(c) for c in ("start", "doc_ids", "sizes", "block"))):
                data = decode_block(block.as_buffer(), table).astype("<u4")
                sizes = sizes.values.to_numpy()
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(data[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": docs.values,
                    "start": pa.array(start.as_py() + ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                })

    return blocks.select("start", "doc_ids", "sizes", "block").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def write(df: DataFrame, tokenizer: bytes, vocabulary_size: int, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """(stored blocks, id counts) of all texts of ``df``.

    Ids are kept in 16 bits before they are coded; a larger vocabulary is refused.
    """
    if vocabulary_size > 1 << 16 or not 0 <= end_id < vocabulary_size:
        raise ValueError("ids must lie below the size of the vocabulary, which is at most 65,536")
    tokens = stage_table(tokenize(df, tokenizer, end_id), "tokens")
    counts = count_ids(tokens, vocabulary_size)
    return stage_table(encode_blocks(tokens, counts), "blocks"), counts


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, written as blocks, and read back from them."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        tokenizer = file.read()
    blocks, counts = write(table(spark, sf_dir, "documents"), tokenizer, 50_257, 0)
    return read_blocks(blocks, counts)
