"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A component x becomes the integer weight floor(SCALE * x); dimensions are the terms, rows with a weight of zero in a dimension do not stand
in its list. A task turns a tile of candidates into one posting list per term (a list that holds more than half of the tile is kept
as a dense row) and works the queries off one at a time: each of the query's terms scatters its weighted list into a dense array of
scores, one cell per candidate. The k best of the array are taken by partition selection, ties by the smaller id, and merged with the
query's best of earlier tiles. Every candidate is scored; nothing is pruned.

Tasks form a grid: a tile of candidates goes to every column, a tile of queries to every row of the grid. A column holds about COLUMN queries at most, so a
task keeps these (weights and k best each) and reads its tiles one after another; memory does not grow with the tables. Each cell
sends k rows per query, combined by a window per query over at most as many rows as the grid has.

A vector that is null or holds a null or non-finite component takes no part; an empty one scores 0. Shorter vectors are
continued with zeros. Weights are held within ``LIMIT`` (components beyond 2^20 at the scale of 256), so that scores of up to 64 terms fit
a long. A row is a vector of its own, also when its id is repeated: a query leaves out its own row only and finds its twins; repeated
queries give one list each. A null id sorts behind all others and asks nothing. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import arrow_rows, arrow_schema, cut_lineage, partitions

SCALE = 256
LIMIT = 1 << 28
#: Candidates of a tile, and queries of one.
TILE = 8192
#: Queries that a task keeps.
COLUMN = 65_536

TILES = "kind int, tile long, width int, ids binary, rows binary, weights binary"
LAST = np.iinfo(np.int64).max


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer weights, a row per vector (shorter ones continued with zeros), and which vectors take part."""
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    values, parent = column.flatten(), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    x = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # null: NaN
    good = np.array(column.is_valid())
    good[parent[~np.isfinite(x)]] = False
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(length.max(initial=0))), np.int64)
    place = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(invalid="ignore", over="ignore"):
        out[parent, place] = np.clip(np.floor(np.where(np.isfinite(x), x, 0) * scale), -LIMIT, LIMIT).astype(np.int64)
    return out, good


def _tiles(kind: int, scale: int) -> Callable:
    """Rows (row, id, vector) as tiles of up to TILE rows, sorted by id (null last), then row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def tile(parts: list) -> pa.RecordBatch:
            width = max(w.shape[1] for *_, w in parts)
            ids, rows = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            weights = np.concatenate([np.pad(w, ((0, 0), (0, width - w.shape[1]))) for *_, w in parts]).astype(np.int32)
            order = np.lexsort((rows, ids))
            return arrow_rows(TILES, [(kind, number, width, ids[order].tobytes(), rows[order].tobytes(), weights[order].tobytes())])

        for batch in batches:
            weights, good = quantised(batch.column(2), scale)
            ids = pc.fill_null(batch.column(1), LAST).to_numpy(zero_copy_only=False)[good]
            rows, weights = batch.column(0).to_numpy(zero_copy_only=False)[good], weights[good]
            while len(ids):
                n = TILE - size
                held.append((ids[:n], rows[:n], weights[:n]))
                size, ids, rows, weights = size + len(held[-1][0]), ids[n:], rows[n:], weights[n:]
                if size == TILE:
                    yield tile(held)
                    number, held, size = number + 1, [], 0
        if held:
            yield tile(held)

    return pack


class Postings:
    """The lists of a tile: per term either (places, weights) or a dense row of weights."""

    def __init__(self, weights: np.ndarray) -> None:
        self.n = len(weights)
        self.top = int(np.abs(weights).max(initial=0))
        self.lists = []
        for column in weights.T:
            places = np.flatnonzero(column)
            self.lists.append((None, np.ascontiguousarray(column)) if 2 * len(places) > self.n else (places, column[places]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Dense scores of all rows of the tile for one sparse query."""
        terms = np.flatnonzero(query[:len(self.lists)])
        narrow = self.top * int(np.abs(query[terms]).sum()) < 2**31
        out = np.zeros(self.n, np.int32 if narrow else np.int64)
        for t in terms:
            places, weights = self.lists[t]
            part = weights * out.dtype.type(query[t]) if narrow else weights.astype(np.int64) * int(query[t])
            if places is None:
                out += part
            else:
                out[places] += part
        return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the lower place, unordered."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])


FOUND = "query_id long, query_row long, vec_id long, row long, score long"


def _searched(k: int) -> Callable:
    """Queries of a cell (kind 0, first) against its tiles of candidates (kind 1), one tile at a time."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, found = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            n = [len(near[0]) for near in found]
            if sum(n):
                scores, ids, rows = (np.concatenate(x) for x in zip(*found))
                asked = (np.repeat(np.array([q[i] for q in queries], np.int64), n) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*map(pa.array, asked), pa.array(ids, mask=ids == LAST), pa.array(rows), pa.array(scores)],
                                                 schema=arrow_schema(FOUND))

        for batch in batches:
            for at in range(batch.num_rows):
                r = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if r["cell"] != cell:
                    yield from flush()
                    cell, queries, found = r["cell"], [], []
                ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                weights = np.frombuffer(r["weights"], np.int32).reshape(len(ids), r["width"])
                if r["kind"] == 0:
                    queries += zip(ids, rows, weights)
                    found += [(np.zeros(0, np.int64),) * 3 for _ in ids]
                    continue
                lists = Postings(weights)
                place = {int(x): i for i, x in enumerate(rows)}
                for i, (_, query_row, query) in enumerate(queries):
                    scores = lists.scores(query)
                    near = best(scores, k + 1)  # one more: the query's own row may be among them
                    own = place.get(int(query_row))
                    if own is not None:
                        near = near[near != own]
                    merged = [np.concatenate([a, b]) for a, b in zip(found[i], (scores[near].astype(np.int64), ids[near], rows[near]))]
                    order = np.lexsort((merged[2], merged[1], -merged[0]))[:k]
                    found[i] = tuple(m[order] for m in merged)
        yield from flush()

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row that ``is_query`` selects its k rows of highest score: (query_id, query_row, rank, vec_id, score)."""
    spark = vectors.sparkSession
    rows = cut_lineage(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"),
                                      (F.coalesce(is_query, F.lit(False)) & F.col(key).isNotNull()).alias("asks")))
    schema = TILES.replace(" int", " integer")
    pack = lambda df, kind: df.select("row", "id", "vector").mapInArrow(_tiles(kind, scale), schema)
    tiles = cut_lineage(pack(rows.filter("asks"), 0).union(pack(rows, 1)))
    counted = {r.kind: (r.n, r.tiles) for r in tiles.groupBy("kind").agg(F.sum(F.length("ids") / 8).cast("long").alias("n"), F.count("*").alias("tiles")).collect()}
    (asked, q_tiles), (_, c_tiles) = counted.get(0, (0, 0)), counted.get(1, (0, 0))
    columns = max(1, -(-asked // COLUMN))
    height = max(1, min(c_tiles, 4 * partitions(spark) // columns))
    numbered = tiles.withColumn("spread", F.pmod(F.xxhash64("tile"), F.lit(height if c_tiles else 1)))
    lines = F.sequence(F.lit(0), F.lit(height - 1))
    cells = (numbered.filter("kind = 0").withColumn("column", F.pmod(F.xxhash64("tile"), F.lit(columns))).withColumn("line", F.explode(lines))
             .unionByName(numbered.filter("kind = 1").withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))
                          .withColumn("line", F.col("spread").cast("int"))))
    found = (cells.withColumn("cell", F.col("line") * F.lit(columns) + F.col("column")).drop("spread", "line", "column")
             .repartition(height * columns, "cell").sortWithinPartitions("cell", "kind", "tile").mapInArrow(_searched(k), FOUND))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "query_row", "rank", "vec_id", "score"))
