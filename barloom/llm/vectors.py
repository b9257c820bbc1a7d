"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length are linked when their cosine is at least ``least``, that is when they are at most
epsilon = sqrt(2 - 2 * least) apart. Each gets the cell of a grid of width epsilon on the leading principal dimensions (axes
fitted on the SAMPLE vectors with the lowest hash; they steer the order, never the result). Vectors are sorted
by cell, dimension by dimension, and cut into blocks and tiles of blocks. The join recurses over pairs of sequence intervals, first
of tiles in Spark, then of blocks and their halves inside a task, and skips a pair whose bounding boxes are more
than epsilon apart; leaves are matrix products, checked again in double precision.

Equal vectors are one class with a count, so copies cost one row. A task emits, per pair of tiles, the link count of each
class and the edges of a spanning forest, never all pairs.

The skipping helps as far as the vectors spread over more than a few cells. On directions spread evenly over many dimensions, hardly any
pair of blocks is provably distant, and the work is that of a blocked matrix product.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. A shorter vector is
continued with zeros. Rows repeating a vec_id are vectors of their own with that id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import arrow_rows, cut_lineage, grow_components, partitions

LEAST = 0.9
SAMPLE = 4096
LEADING = 16
BLOCK = 1024
TILE = 8
FAN = 8
LEAF = 512
# Tiles of a file: a task holds two files and sends its pairs of tiles, some 9 MB each, to Python.
SPAN = 4


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one."""
    out, good = np.zeros((len(column), width)), np.zeros(len(column), bool)
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                out[i, :len(x)] = x / np.sqrt(x @ x)
                good[i] = True
    return out, good


def _classes(width: int) -> Callable:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = unit_rows(batch.column("embedding"), width)
            raw = [r.tobytes() if g else None for r, g in zip(x, good)]
            nodes = [None if r is None else int(np.uint64(xxhash.xxh3_64_intdigest(r)).view(np.int64)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "node", "v"])

    return name


def _cells(axes: np.ndarray, epsilon: float) -> Callable:
    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v) for v in batch.column("v").to_pylist()])
                grid = (np.floor(x @ axes[:, :LEADING] / epsilon) + 128).astype(np.uint8)
                yield batch.append_column("grid", pa.array([g.tobytes() for g in grid], pa.binary()))

    return cell


BLOCKS = "block long, nodes binary, copies binary, vectors binary, low binary, high binary"


def _blocks(axes: np.ndarray) -> Callable:
    """Sorted vectors of a task as blocks with their bounding boxes; the number of a block keeps the order."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId() << 20, 0, []

        def block(rows: list[dict]) -> pa.RecordBatch:
            x = np.stack([np.frombuffer(r["v"]) for r in rows])
            p = x @ axes
            return arrow_rows(BLOCKS, [(task + number, np.array([r["node"] for r in rows]).tobytes(), np.array([r["n"] for r in rows]).tobytes(),
                                        x.tobytes(), p.min(0).tobytes(), p.max(0).tobytes())])

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held, number = held[BLOCK:], number + 1
        if held:
            yield block(held)

    return cut


def far(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, epsilon: float) -> bool:
    """Whether two boxes are provably more than epsilon apart."""
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    return float(gap @ gap) > epsilon * epsilon * (1 + 1e-9)


def _boxes(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.min([np.frombuffer(r["low"]) for r in rows], 0), np.max([np.frombuffer(r["high"]) for r in rows], 0)


def close_tiles(tiles: DataFrame, n: int, epsilon: float) -> DataFrame:
    """Pairs (a, b), a <= b, of the tiles 0..n-1 (columns tile, low, high) that may hold linked vectors, by recursion over
    intervals of FAN ** level tiles. Each level keeps only pairs whose boxes are close and looks at their parts."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [[np.frombuffer(x) for x in batch.column(c).to_pylist()] for c in ("la", "ha", "lb", "hb")]
            yield batch.select(["a", "b"]).filter(pa.array([not far(*x, epsilon) for x in zip(*boxes)], pa.bool_()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *(x.tobytes() for x in _boxes(c))) for p, c in zip(batch.column("part").to_pylist(), batch.column("boxes").to_pylist())]
            if rows:
                yield arrow_rows("part long, low binary, high binary", rows)

    levels = 0
    while FAN ** levels < n:
        levels += 1
    boxes = [tiles.select(F.col("tile").alias("part"), "low", "high")]
    for _ in range(levels - 1):
        boxes.append(cut_lineage(boxes[-1].groupBy(F.floor(F.col("part") / FAN).alias("part"))
                                 .agg(F.collect_list(F.struct("low", "high")).alias("boxes")).mapInArrow(merge, "part long, low binary, high binary")))
    spark = tiles.sparkSession
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        part = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = (pairs.select((F.col("a") * FAN).alias("a"), (F.col("b") * FAN).alias("b"))
                 .withColumn("i", F.explode(part)).withColumn("j", F.explode(part))
                 .select((F.col("a") + F.col("i")).alias("a"), (F.col("b") + F.col("j")).alias("b")).filter("a <= b"))
        own = boxes[level]
        pairs = (pairs.join(own.select(F.col("part").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha")), "a")
                 .join(own.select(F.col("part").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb")), "b")
                 .mapInArrow(near, "a long, b long"))
        pairs = cut_lineage(pairs)
    return pairs


class _Side:
    def __init__(self, rows: list[dict], axes: np.ndarray):
        rows = sorted(rows, key=lambda r: r["block"])
        self.nodes = np.concatenate([np.frombuffer(r["nodes"], np.int64) for r in rows])
        self.copies = np.concatenate([np.frombuffer(r["copies"], np.int64) for r in rows])
        self.x = np.concatenate([np.frombuffer(r["vectors"]).reshape(-1, len(axes)) for r in rows])
        self.p, self.single = self.x @ axes, self.x.astype(np.float32)
        self.cuts = np.cumsum([0, *(len(r["nodes"]) // 8 for r in rows)])
        self.boxes: dict[tuple[int, int], tuple] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            self.boxes[lo, hi] = self.p[lo:hi].min(0), self.p[lo:hi].max(0)
        return self.boxes[lo, hi]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Lowest member of the component of each of n nodes under the edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joined(a: _Side, b: _Side, same: bool, least: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two intervals: counts for each side (weighted by the copies of the other) and component labels
    over a's nodes followed by b's."""
    counts = np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
    label = np.arange(len(a.nodes) + len(b.nodes))
    if same:
        label[len(a.nodes):] -= len(a.nodes)

    def join(al: int, ah: int, bl: int, bh: int) -> None:
        nonlocal label
        if al >= ah or bl >= bh or same and bh <= al or far(*a.box(al, ah), *b.box(bl, bh), epsilon):
            return
        if ah - al > LEAF or bh - bl > LEAF:
            halves = lambda lo, hi: [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)] if hi - lo > LEAF else [(lo, hi)]
            for x in halves(al, ah):
                for y in halves(bl, bh):
                    join(*x, *y)
            return
        i, j = np.nonzero(a.single[al:ah] @ b.single[bl:bh].T >= least - 1e-4)
        i, j = i + al, j + bl
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            sure = np.concatenate([np.einsum("ij,ij->i", a.x[i[k:k + 50_000]], b.x[j[k:k + 50_000]]) >= least for k in range(0, len(i), 50_000)])
            i, j = i[sure], j[sure]
            np.add.at(counts[0], i, b.copies[j])
            np.add.at(counts[1], j, a.copies[i])
            got = spanning(np.concatenate((np.arange(len(label)), i)), np.concatenate((label, j + (0 if same else len(a.nodes)))), len(label))
            label = got

    for al, ah in zip(a.cuts[:-1], a.cuts[1:]):
        for bl, bh in zip(b.cuts[:-1], b.cuts[1:]):
            join(int(al), int(ah), int(bl), int(bh))
    return *counts, label


FOUND = "node long, links long, other long"


def _tile_links(axes: np.ndarray, least: float, epsilon: float) -> Callable:
    """Per pair of tiles rows (node, links, null) with counts and (node, null, other) with edges of a spanning forest."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, a = None, None
        for row in (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows)):
            same = row["tile"] == row["other"]
            if row["tile"] != held:
                held, a = row["tile"], _Side(row["blocks"], axes)
            b = a if same else _Side(row["others"], axes)
            ca, cb, label = joined(a, b, same, least, epsilon)
            names = np.concatenate((a.nodes, b.nodes))
            rows = [(int(n), int(c), None) for side, counts in ((a, ca), (b, cb)) for n, c in zip(side.nodes[counts > 0], counts[counts > 0])]
            upto = len(a.nodes) if same else len(names)
            other = np.flatnonzero(label[:upto] != np.arange(upto))
            rows += [(int(names[k]), None, int(names[label[k]])) for k in other]
            for lo in range(0, len(rows), 20_000):
                yield arrow_rows(FOUND, rows[lo:lo + 20_000])

    return links


def tile_pairs(tiled: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """(tile, blocks, other, others): the blocks of both tiles of each pair (a, b), each pair once.

    The tiles are written once, in files of some SPAN tiles, and every task reads two files: what travels and is written grows with the
    vectors, though the pairs grow with their square. Half of the pairs are turned round, so that tasks have about equal shares.
    """
    turned = (F.col("a") + F.col("b")) % 2 == 1
    sought = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("tile"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other"))
    files = max(1, -(-total // max(SPAN, -(-total // 1000))))
    blocks = tiled.groupBy("tile").agg(F.collect_list(F.struct("block", "nodes", "copies", "vectors")).alias("blocks"))
    sides = cut_lineage(blocks.join(sought.groupBy("tile").agg(F.collect_list("other").alias("sought")), "tile", "left")
                        .repartitionByRange(files, "tile").coalesce(files))
    others = sides.select(F.col("tile").alias("other"), F.col("blocks").alias("others"))
    return sides.join(others, F.array_contains("sought", F.col("other"))).select("tile", "blocks", "other", "others")


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    few = classes.select("v").orderBy(F.xxhash64("node")).limit(SAMPLE).collect()
    if not few:
        return np.eye(width)
    x = np.stack([np.frombuffer(r[0]) for r in few])
    _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(width))
    return np.ascontiguousarray(axes[:, ::-1])


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    epsilon = float(np.sqrt(2 - 2 * least))
    width = max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)
    named = cut_lineage(vectors.select("vec_id", "embedding").mapInArrow(
        _classes(width), T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("node long, v binary").fields])))
    classes = cut_lineage(named.filter("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")))
    axes = principal_axes(classes, width)
    size = classes.count()
    celled = classes.mapInArrow(_cells(axes, epsilon), "node long, v binary, n long, grid binary")
    tasks = max(1, min(-(-size // BLOCK), 4 * partitions(vectors.sparkSession)))
    # the class number splits a cell that holds more than a block
    placed = celled.repartitionByRange(tasks, "grid", "node").sortWithinPartitions("grid", "node").mapInArrow(_blocks(axes), BLOCKS)
    placed = cut_lineage(placed)
    numbers = placed.select("block").groupBy(F.shiftright("block", 20).alias("task")).agg(F.max("block").alias("last")).collect()
    # a task's first rank; there are at most four times spark.sql.shuffle.partitions tasks
    ranks, total = {}, 0
    for task, last in sorted(map(tuple, numbers)):
        ranks[task], total = total, total + (last & 0xFFFFF) + 1
    starts = vectors.sparkSession.createDataFrame(list(ranks.items()) or [(0, 0)], "task long, rank long")
    tiled = (placed.withColumn("task", F.shiftright("block", 20)).join(starts, "task")
             .withColumn("tile", F.floor((F.col("rank") + F.col("block").bitwiseAND(0xFFFFF)) / TILE)).drop("task", "rank"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *(x.tobytes() for x in _boxes(c))) for p, c in zip(batch.column("tile").to_pylist(), batch.column("boxes").to_pylist())]
            if rows:
                yield arrow_rows("tile long, low binary, high binary", rows)

    tiles = cut_lineage(tiled.groupBy("tile").agg(F.collect_list(F.struct("low", "high")).alias("boxes")).mapInArrow(merge, "tile long, low binary, high binary"))
    pairs = close_tiles(tiles, -(-total // TILE), epsilon)
    found = cut_lineage(tile_pairs(tiled, pairs, -(-total // TILE)).mapInArrow(_tile_links(axes, least, epsilon), FOUND))

    links = cut_lineage(found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links")))
    component = grow_components(classes.select("node"), found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    info = cut_lineage(classes.select("node", "n").join(component, "node").join(links, "node", "left")
                       .select("node", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = cut_lineage(named.select("vec_id", "node").join(info, "node", "left"))
    low = cut_lineage(rows.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("low")))
    out = rows.join(low, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
