"""Prefix trie of conversations: count-min screening of prefix digests, exact grouping of what may be shared.

A node is a distinct sequence of first turns (role and text), the root the empty one; its members are the conversations that start with
it. Turns are reduced to a 128-bit hash and their size when read; texts never travel.

1. Turns are sorted by conversation over all tasks, so a long conversation spans several. A task chains the prefix digests, values of a polynomial
   of the turn hashes modulo 2^127 - 1. A conversation cut by a task border is chained from zero there and completed with the digest at the
   end of the task before: the digests compose, and a row per task is enough to know all borders.
2. Every task enters its digests into a count-min sketch of two rows of saturating counters (none, one, more), kept as bitmaps; the
   sketches are merged block by block. Only the bits for "more" are needed afterwards: 2 x ``WIDEST`` bits at most (32 MB), sent to all tasks.
3. An estimate of one proves a singleton, as counters never count too little. All nodes below the last possibly shared prefix of a
   conversation are such, and are emitted where they are read: one member, one leaf, nothing saved. More prefixes than the widest sketch tells
   apart make it prove less, not wrong: the rest is grouped.
4. Only possibly shared prefixes are exchanged, with partial sums per task, so a prefix of very many conversations is a row per task.
   Subtree sums need no walk over levels. A node is owned by its smallest member, and owns of one conversation are the lower end of its
   path; so what a node saves in its subtree is the sum of all that its members own, less what its own smallest member owns above it.
   Leaves are counted alike, children by their parent's digest.
5. Members that end in a node are sorted over all tasks, joined to pieces of PIECE ids, and the hash of a node runs over its pieces.

Turns are ordered by turn (null first), equal turns by the hash of role and text; repeated rows are turns of their own. A null role or text counts
as empty, rows without conversation id are left out. Empty table: no node, not even a root. Extra columns are ignored. Two different
sequences share a digest with a chance of about 2^-120 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import arrow_schema, cut_lineage, in_order, partitions

PRIME = (1 << 127) - 1
#: Base of the polynomial; any large odd number will do.
BASE = 0x5DEECE66D1234567_9E3779B97F4A7C15 % PRIME
LOW = (1 << 64) - 1
#: Counters of a sketch row: four per prefix, within these limits.
NARROWEST, WIDEST = 1 << 16, 1 << 27
#: Counters of a block.
BLOCK = 1 << 15
PIECE = 512
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, n_bytes): each turn as a 128-bit hash of role and text, and the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("long").alias("n_bytes"))


def shared_starts(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share starts: the first h turns of conversation c - c % ``group``, then c's own turns after its first h, where
    h = crc32(c) % ``most``. Returns the turns, numbered anew, and all conversation ids."""
    placed = in_order(turns, "conv_id", F.asc_nulls_first("turn"), "a", "b", "n_bytes")
    known = cut_lineage(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    head = known.select(F.col("conv_id").alias("start"), F.col("n").alias("n_start"))
    plan = known.select("conv_id", "first", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("start")).join(head, "start", "left")
    at = F.col("place") - F.col("first")
    own = (placed.join(plan, "conv_id").filter(at >= F.col("h"))
           .select("conv_id", (at - F.col("h") + F.least("h", F.coalesce("n_start", F.lit(0)))).alias("turn"), "a", "b", "n_bytes"))
    heads = (placed.filter(F.col("conv_id") % group == 0).join(known.drop("n"), "conv_id").filter(at < most - 1)
             .select(F.col("conv_id").alias("start"), at.alias("turn"), "a", "b", "n_bytes"))
    taken = heads.join(plan.select("conv_id", "start", "h"), "start").filter("turn < h").select("conv_id", "turn", "a", "b", "n_bytes")
    return own.union(taken), known.select("conv_id")


CHAIN = "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, n_bytes long, last boolean, open boolean, part long"
PREFIX = "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, n_bytes long, last boolean"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the digests of their prefixes, relative to the task's first row where that continues a conversation (``open``)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, conv, depth, digest, opened = [], None, 0, 1, False

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        schema = arrow_schema(CHAIN)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for c, is_turn, a, b, n_bytes in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "is_turn", "a", "b", "n_bytes"))):
            if held and held[-1][0] == c:
                held[-1] = (*held[-1][:7], False, *held[-1][8:])
            if not is_turn:
                conv, depth, digest, opened, up = c, 0, 1, False, 0
            else:
                if c != conv:
                    conv, depth, digest, opened = c, 0, 0, True
                up = digest
                digest = (digest * BASE + ((a & (LOW >> 1)) << 64 | b & LOW)) % PRIME
                depth += 1
            held.append((c, depth, digest >> 64, signed(digest & LOW), up >> 64, signed(up & LOW), n_bytes, True, opened, part))
        if len(held) > 8192:
            yield pack(held[:-1])
            held = held[-1:]
    if held:
        yield pack(held)


def whole_number(hi: int, lo: int) -> int:
    return hi << 64 | lo & LOW


def borders(parts: list) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """From a row per task (part, opens, last conversation, depth, hi, lo and whether these are relative): the (depth, digest) that a task continues,
    and the conversation at the end of each task that is continued by the next one."""
    carry, continued, state, before = {}, {}, (0, 1), None
    for p in sorted(parts, key=lambda r: r.part):
        if p.opens:
            carry[p.part] = state
            continued[before.part] = before.conv
        digest = whole_number(p.hi, p.lo)
        state = (state[0] + p.depth, (state[1] * pow(BASE, p.depth, PRIME) + digest) % PRIME) if p.relative else (p.depth, digest)
        before = p
    return carry, continued


def _completed(carry: dict, continued: dict) -> Callable:
    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False).copy() for name in batch.schema.names}
            opened = np.flatnonzero(columns["open"])
            for i in opened:
                depth, digest = carry[int(columns["part"][i])]
                k = int(columns["depth"][i])
                for hi, lo, power in (("hi", "lo", k), ("up_hi", "up_lo", k - 1)):
                    d = (digest * pow(BASE, power, PRIME) + whole_number(int(columns[hi][i]), int(columns[lo][i]))) % PRIME
                    columns[hi][i], columns[lo][i] = d >> 64, signed(d & LOW)
                columns["depth"][i] = depth + k
            for part, conv in continued.items():
                columns["last"] &= ~((columns["part"] == part) & (columns["conv_id"] == conv))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow_schema(PREFIX)], schema=arrow_schema(PREFIX))

    return complete


def prefixes(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Every prefix of every conversation, the empty one too: digest, digest of the prefix before, whether it is the whole conversation."""
    known = (turns if conversations is None else conversations).select("conv_id").distinct()
    none = F.lit(0).cast("long")
    roots = known.select("conv_id", F.lit(False).alias("is_turn"), *(none.alias(c) for c in ("turn", "a", "b", "n_bytes")))
    rows = roots.union(turns.select("conv_id", F.lit(True), "turn", "a", "b", "n_bytes"))
    chain = cut_lineage(rows.orderBy("conv_id", "is_turn", F.asc_nulls_first("turn"), "a", "b").mapInArrow(_chained, CHAIN))
    end = F.max(F.struct("conv_id", "depth", "hi", "lo", "open")).alias("end")
    parts = chain.groupBy("part").agg(F.max("open").alias("opens"), end).select(
        "part", "opens", F.col("end.conv_id").alias("conv"), "end.depth", "end.hi", "end.lo", F.col("end.open").alias("relative")).collect()
    return chain.mapInArrow(_completed(*borders(parts)), PREFIX)


def slots(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return lo & (width - 1), hi & (width - 1)


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def mark(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


SKETCH = "block long, once binary, more binary"


def _sketched(width: int) -> Callable:
    """Count-min sketch of a task's prefixes, as the blocks that hold anything."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = (np.zeros((2, width // 8), np.uint8) for _ in range(2))
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo"))
            for row, at in enumerate(slots(hi, lo, width)):
                at, n = np.unique(at, return_counts=True)
                mark(more[row], at[(n > 1) | marked(once[row], at)])
                mark(once[row], at)
        size = BLOCK // 8
        once, more = once.reshape(-1, size), more.reshape(-1, size)
        filled = np.flatnonzero(once.any(1))
        for start in range(0, len(filled), 512):
            at = filled[start:start + 512]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array([x[i].tobytes() for i in at], pa.binary()) for x in (once, more))],
                                             schema=arrow_schema(SKETCH))

    return sketch


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by number, equal ones added up; those with a counter above one."""
    block, once, more = None, None, None

    def out() -> Iterator[pa.RecordBatch]:
        if block is not None and more.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([more.tobytes()], pa.binary())], names=["block", "more"])

    for batch in batches:
        for b, o, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
            o, m = np.frombuffer(o, np.uint8), np.frombuffer(m, np.uint8)
            if b != block:
                yield from out()
                block, once, more = b, o, m
            else:
                more, once = more | m | once & o, once | o
    yield from out()


def shared_slots(found: DataFrame, width: int) -> np.ndarray:
    """Both rows of the sketch over all prefixes, one bit per counter: more than one."""
    blocks = found.select("hi", "lo").mapInArrow(_sketched(width), SKETCH)
    merged = blocks.repartition(partitions(found.sparkSession), "block").sortWithinPartitions("block").mapInArrow(_merged, "block long, more binary")
    bits = np.zeros((2 * width // BLOCK, BLOCK // 8), np.uint8)
    for r in merged.toLocalIterator():
        bits[r.block] = np.frombuffer(bytes(r.more), np.uint8)
    return bits.reshape(2, -1)


def _screened(sketch, width: int) -> Callable:
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for batch in batches:
            for name, hi, lo in (("shared", "hi", "lo"), ("up_shared", "up_hi", "up_lo")):
                hi, lo = (batch.column(c).to_numpy(zero_copy_only=False) for c in (hi, lo))
                first, second = slots(hi, lo, width)
                batch = batch.append_column(name, pa.array(marked(bits[0], first) & marked(bits[1], second)))
            yield batch

    return screen


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (hi, lo, conv_id) as runs of up to PIECE ids of one node, joined by commas."""
    node, ids, rows = None, [], []

    def packed() -> pa.RecordBatch:
        schema = arrow_schema("hi long, lo long, first long, ids string")
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def close() -> None:
        if ids:
            rows.append((*node, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for hi, lo, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (hi, lo) != node or len(ids) == PIECE:
                close()
                node, ids = (hi, lo), []
            ids.append(conv)
        if len(rows) > 1024:
            yield packed()
            rows = []
    close()
    if rows:
        yield packed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, sorted by node and first id, joined by commas."""
    node, digest, rows = None, None, []

    def packed() -> pa.RecordBatch:
        schema = arrow_schema("hi long, lo long, ends_sha256 string")
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for hi, lo, ids in zip(*(batch.column(name).to_pylist() for name in ("hi", "lo", "ids"))):
            if (hi, lo) != node:
                if node:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (hi, lo), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(rows) > 8192:
            yield packed()
            rows = []
    if node:
        rows.append((*node, digest.hexdigest()))
        yield packed()


def ends(found: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes in which conversations end."""
    pieces = (found.select("hi", "lo", "conv_id").orderBy("hi", "lo", "conv_id").mapInArrow(_pieces, "hi long, lo long, first long, ids string"))
    return (pieces.repartition(partitions(found.sparkSession), "hi", "lo").sortWithinPartitions("hi", "lo", "first")
            .mapInArrow(_hashed, "hi long, lo long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Nodes of the trie over digested turns (``turn_digests``): one row per distinct prefix.

    ``conversations``: all ids (column conv_id), if some have no turn. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of last turns that all but one member need not repeat, over the subtree), ends_sha256.
    """
    spark = turns.sparkSession
    found = cut_lineage(prefixes(turns, conversations))
    width = NARROWEST
    while width < min(WIDEST, 4 * found.count()):
        width *= 2
    sketch = spark.sparkContext.broadcast(shared_slots(found, width))
    found = cut_lineage(found.mapInArrow(_screened(sketch, width), f"{PREFIX}, shared boolean, up_shared boolean"))
    shared, single = found.filter("shared"), found.filter("not shared")

    nodes = shared.groupBy("hi", "lo").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.bool_and("last").alias("childless"), F.max("depth").alias("depth"),
        F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), F.bool_or("up_shared").alias("up_shared"),
        ((F.count("*") - 1) * F.max("n_bytes")).alias("saves"))
    nodes = in_order(nodes, "conv_id", "depth", value=F.col("saves"))
    owned = nodes.select("conv_id", "saves", "childless", "before").union(single.filter("last").select("conv_id", F.lit(0), F.lit(True), F.lit(None)))
    owned = cut_lineage(owned.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.max(F.col("childless").cast("long")).alias("leaf"), F.min("before").alias("start")))
    below = shared.select("conv_id", "hi", "lo").join(owned, "conv_id").select("hi", "lo", "saves", "leaf", F.lit(0).alias("child"))
    children = nodes.filter("depth > 0").select("up_hi", "up_lo").union(single.filter("up_shared").select("up_hi", "up_lo"))
    sums = (below.union(children.select("up_hi", "up_lo", F.lit(0), F.lit(0), F.lit(1))).groupBy("hi", "lo")
            .agg(*(F.sum(c).alias(f"all_{c}") for c in ("saves", "leaf", "child"))))
    ended = ends(shared.filter("last"))
    parent = nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    grouped = (nodes.join(owned.select("conv_id", "start"), "conv_id").join(sums, ["hi", "lo"]).join(ended, ["hi", "lo"], "left")
               .join(parent, ["up_hi", "up_lo"], "left")
               .select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs",
                       F.col("all_child").alias("n_children"), F.col("all_leaf").alias("n_leaves"),
                       (F.col("all_saves") - (F.col("before") - F.col("start"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))

    def alone(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select("conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                           F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                           F.lit(0).cast("long").alias("saved_tokens"),
                           F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"))

    tails = alone(single.filter("not up_shared"), F.when(F.col("depth") > 0, F.col("conv_id")))
    tops = alone(single.filter("up_shared").join(parent, ["up_hi", "up_lo"]), F.col("parent_conv_id"))
    return grouped.unionByName(tails).unionByName(tops)
