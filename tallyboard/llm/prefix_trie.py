"""Prefix trie of conversations, summed bottom-up by time-forward processing.

A node is a distinct sequence of first turns. It is known by two XOR sums of 64-bit hashes
of (depth, role, text), so prefixes are running sums, and by its least member and its depth
in the result. Nodes with equal members lie below each other in one chain; the trie of
chains has fewer than two chains for each conversation and all sums run over it.

A chain belongs to level k when it has more than ``FAN**k`` and at most ``FAN**(k + 1)``
members, and to the shard of its highest ancestor in that level. So a shard has at most
2 * FAN chains that no other shard of its level holds, however wide or hot the trie is.
Within shards the chains are sorted in reverse level order and each passes its subtree's
totals to its parent through a priority queue that spills sorted runs to the task's disk.
Totals of shard roots are summed by their parent and enter the next level, up to the root.

Rows of one conversation are ordered by turn, null first, then by role and text; repeated
rows are turns of their own. A null conv_id names no conversation, such rows are left out.
Null roles and texts count as empty. Further columns are left out. An empty table has no
nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.shared import reach, stage_table, table
from tallyboard.operators.joins import join_back
from tallyboard.operators.windows import number_rows

#: Members of a shard's root are at most so many times those of the level below.
FAN = 4096
#: Messages that a queue holds before it spills.
QUEUE = 100_000
#: Turns of one conversation that a window orders; longer ones are cut.
BLOCK = 4096
#: Conversation ids that are joined to one text of ids.
ENDS = 4096
GROUP, HEAD = 5, 9  # fixed values of the rebuilding rule


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: turns numbered from 1 in each conversation."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    return number_rows(rows, ["conv_id"], order, block, "place").select("conv_id", "place", "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv_id, depth, role, text`` of the rebuilt conversations, ``conv_id`` of all).

    Conversation c begins with the first h turns of c - c % 5 and goes on with its own turns
    after the h-th, h = crc32 of the decimal c modulo 9.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stage_table(
        convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations"
    )
    first = turns.where(F.col("place") < HEAD).withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "h").join(first, "base").where(F.col("place") <= F.col("h")).select(
        "conv_id", F.col("place").cast("long").alias("depth"), "role", "text"
    )
    rest = join_back(turns, convs.select("conv_id", "n", "h", "lent"), ["conv_id"], "n").where(F.col("place") > F.col("h"))
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "role", "text")
    return heads.unionByName(rest), convs.select("conv_id")


def running(df: DataFrame, keys: list[str], at: str, sums: dict[str, Column], fold, join, block: int = BLOCK) -> DataFrame:
    """``df`` with running folds of columns along ``at`` in each key; keys that go beyond
    ``block`` are cut there, and the totals of earlier parts are added."""
    names = list(sums)
    rows = df.withColumns({**sums, "_part": F.floor(F.col(at) / block).cast("long")})
    long = rows.where(F.col("_part") > 0).select(*keys).distinct()
    totals = rows.join(long, keys, "left_semi").groupBy(*keys, "_part").agg(*[fold(n).alias(n) for n in names])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, "_part", *[fold(n).over(before).alias(f"_before_{n}") for n in names])
    along = Window.partitionBy(*keys, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: fold(n).over(along) for n in names}).join(shifts, [*keys, "_part"], "left")
    return local.withColumns({n: join(F.col(n), F.coalesce(F.col(f"_before_{n}"), F.lit(0))) for n in names}).drop(
        "_part", *[f"_before_{n}" for n in names]
    )


def paths(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, depth, k1, k2, bytes``: the nodes below the root that a conversation passes."""
    hashes = {f"h{i}": F.xxhash64(F.lit(i), "depth", "role", "text") for i in (1, 2)}
    narrow = stage_table(rows.select("conv_id", "depth", *[h.alias(n) for n, h in hashes.items()], F.octet_length("text").cast("long").alias("bytes")), "turns")
    folded = running(
        narrow, ["conv_id"], "depth", {"k1": F.col("h1"), "k2": F.col("h2")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b), block
    )
    return stage_table(folded.select("conv_id", "depth", "k1", "k2", "bytes"), "paths")


def chains_of(steps: DataFrame, nodes: DataFrame, convs: DataFrame, least: int | None, total: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(chains, ends): every chain with its parent, level and shard; the chain each
    conversation ends in.

    A chain is named by its least member and its number of members; the root has ``least``
    and ``total``.
    """
    key = ["depth", "k1", "k2"]
    on_path = join_back(steps, nodes.select(*key, "rep", "n", F.col("n").alias("rows")), key, "rows")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), F.lit(least).cast("long").alias("rep"), F.lit(total).cast("long").alias("n"), zero.alias("bytes"))
    cells = on_path.select("conv_id", "depth", "rep", "n", "bytes").unionByName(root).groupBy("conv_id", "rep", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum((F.col("n") - 1) * F.col("bytes")).alias("weight")
    )
    cells = cells.withColumn("level", sum((F.col("n") > float(fan) ** k).cast("int") for k in range(1, 8)))
    down = Window.partitionBy("conv_id").orderBy(F.desc("n"))
    above = F.lag(F.struct("rep", "n", "top", "level")).over(down)
    cells = cells.withColumns({
        "above": above,
        "shard": F.max(F.struct("n", "rep")).over(Window.partitionBy("conv_id", "level")),
        "last": F.lead("n").over(down).isNull(),
    })
    cells = stage_table(cells, "chains")
    chains = cells.where("conv_id = rep").select(
        "rep", "n", "top", "bottom", "weight", "level", F.col("shard.rep").alias("shard_rep"), F.col("shard.n").alias("shard_n"),
        F.col("above.rep").alias("up_rep"), F.col("above.n").alias("up_n"), F.col("above.top").alias("up_top"), F.col("above.level").alias("up_level"),
    )
    return chains, cells.where("last").select("conv_id", "rep", "n")


class SpillingQueue:
    """A priority queue of tuples of nine integers that keeps at most ``limit`` in memory.

    Beyond it the held entries go to a sorted run on disk; runs are read back in order.
    """

    ENTRY = struct.Struct("<9q")

    def __init__(self, limit: int = QUEUE):
        self.limit, self.held, self.runs, self.spilled = limit, [], [], 0

    def push(self, entry: tuple[int, ...]) -> None:
        heapq.heappush(self.held, entry)
        if len(self.held) > self.limit:
            run = self._run(sorted(self.held))
            self.held = []
            self.spilled += 1
            heapq.heappush(self.runs, (next(run), self.spilled, run))

    def _run(self, entries) -> Iterator[tuple[int, ...]]:
        file = tempfile.TemporaryFile()
        for entry in entries:
            file.write(self.ENTRY.pack(*entry))
        file.seek(0)

        def read():
            with file:
                while data := file.read(self.ENTRY.size):
                    yield self.ENTRY.unpack(data)

        return read()

    def peek(self) -> tuple[int, ...] | None:
        heads = [h for h in (self.held[0] if self.held else None, self.runs[0][0] if self.runs else None) if h is not None]
        return min(heads) if heads else None

    def pop(self) -> tuple[int, ...]:
        first = self.peek()
        if self.held and self.held[0] == first:
            return heapq.heappop(self.held)
        head, at, run = self.runs[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, at, run))
        return head


COLUMNS = ["shard_rep", "shard_n", "top", "rep", "n", "weight", "up_rep", "up_n", "up_top", "inside", "leaves", "saved", "children"]


def forward(rows: Iterator[tuple], limit: int = QUEUE) -> Iterator[tuple]:
    """(rep, n, leaves, saved, children, up_rep, up_n, inside) of chains in reverse level
    order: what a chain got, what its subtree sums to, and whether its shard had its parent.

    Rows hold COLUMNS; leaves, saved and children are what came from the levels below.
    """
    queue = SpillingQueue(limit)
    for shard_rep, shard_n, top, rep, n, weight, up_rep, up_n, up_top, inside, leaves, saved, children in rows:
        own = (shard_rep, shard_n, -top, rep, n)
        while (head := queue.peek()) is not None and head[:5] == own:
            entry = queue.pop()
            leaves, saved, children = leaves + entry[5], saved + entry[6], children + entry[7]
        leaves = leaves or 1  # nothing below
        yield rep, n, leaves, saved + weight, children, up_rep, up_n, inside
        if inside:
            # The last number tells messages of one parent apart.
            queue.push((shard_rep, shard_n, -up_top, up_rep, up_n, leaves, saved + weight, 1, rep))


def totals(chains: DataFrame, limit: int = QUEUE) -> DataFrame:
    """``rep, n, leaves, saved, children`` of all chains, level by level."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in COLUMNS))

        held = []
        for row in forward(rows(), limit):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    names = ["rep", "n", "leaves", "saved", "children", "up_rep", "up_n", "inside"]
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    schema = ", ".join(f"{c} {'boolean' if c == 'inside' else 'long'}" for c in names)
    levels = sorted(r["level"] for r in chains.select("level").distinct().collect())  # a handful
    out, below = None, None
    for level in levels or [0]:
        own = chains.where(F.col("level") == level).withColumn("inside", F.coalesce(F.col("up_level") == level, F.lit(False)))
        zero = F.lit(0).cast("long")
        if below is None:
            own = own.withColumns({c: zero for c in ("leaves", "saved", "children")})
        else:
            sent = below.where("not inside").groupBy(F.col("up_rep").alias("rep"), F.col("up_n").alias("n")).agg(
                F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children")
            )
            own = own.join(sent, ["rep", "n"], "left").withColumns({c: F.coalesce(c, zero) for c in ("leaves", "saved", "children")})
        dealt = own.select(*COLUMNS).repartition("shard_rep", "shard_n")
        done = stage_table(dealt.sortWithinPartitions("shard_rep", "shard_n", F.desc("top"), "rep", "n").mapInArrow(run, schema), "totals")
        out = done if out is None else out.unionByName(done)
        # A chain may have its parent any number of levels up.
        below = out
    return out.select("rep", "n", "leaves", "saved", "children")


def end_digests(ends: DataFrame) -> DataFrame:
    """``rep, n, ends_sha256``: of the ids of the conversations that end in each chain.

    Ids are joined to texts of at most ENDS, which a task reads in order and never holds
    together.
    """
    part = F.floor(F.col("conv_id") / ENDS).cast("long").alias("part")
    texts = ends.groupBy("rep", "n", part).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids")
    )

    def run(batches):
        held, digest, out = None, None, []
        for batch in batches:
            for rep, n, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "ids"))):
                if held == (rep, n):
                    digest.update(b",")
                else:
                    if held:
                        out.append((*held, digest.hexdigest()))
                    held, digest = (rep, n), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["rep", "n", "ends_sha256"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*held, digest.hexdigest())], ["rep", "n", "ends_sha256"])

    dealt = texts.repartition("rep", "n").sortWithinPartitions("rep", "n", "part")
    return dealt.select("rep", "n", "ids").mapInArrow(run, "rep long, n long, ends_sha256 string")


def trie(conversations: DataFrame, fan: int = FAN, block: int = BLOCK, limit: int = QUEUE) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of every node of the rebuilt conversations."""
    reach(conversations.sparkSession)
    turns = stage_table(own_turns(conversations), "own-turns")
    rows, convs = rebuilt(turns)
    steps = paths(rows, block)
    # A conversation has one row of each depth, so members are rows.
    nodes = stage_table(
        steps.groupBy("depth", "k1", "k2").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.max("bytes").alias("bytes")), "nodes"
    )
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).first()
    chains, ends = chains_of(steps, nodes, convs, root["rep"], root["n"], fan)
    zero = F.lit(0).cast("long")
    top = [(0, root["n"], root["rep"], 0)] if root["n"] else []
    every = nodes.select("depth", "n", "rep", "bytes").unionByName(
        nodes.sparkSession.createDataFrame(top, "depth long, n long, rep long, bytes long")
    )
    named = chains.join(totals(chains, limit), ["rep", "n"]).join(end_digests(ends), ["rep", "n"], "left")
    named = stage_table(
        named.select("rep", "n", "top", "bottom", "up_rep", "leaves", "saved", "children", "ends_sha256", (F.col("bottom") - F.col("top") + 1).alias("rows")),
        "named",
    )
    # Only chains of several members save anything; the sum down to a node is taken from all.
    weight = (F.col("n") - 1) * F.col("bytes")
    shared = running(every.where("n > 1"), ["rep", "n"], "depth", {"passed": weight}, F.sum, lambda a, b: a + b, block).withColumn(
        "passed", F.col("passed") - weight
    )
    placed = shared.unionByName(every.where("n = 1").withColumn("passed", zero))
    full = join_back(placed, named, ["rep", "n"], "rows")
    last = F.col("depth") == F.col("bottom")
    return full.select(
        F.col("rep").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("top"), F.col("rep")).otherwise(F.col("up_rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("passed")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
