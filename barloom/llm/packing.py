"""Best-fit packing of tokenized documents into sequences of at most LIMIT tokens: best fit over all pieces of the table.

1. Each task tokenizes its documents and cuts those over the limit into full pieces and a rest. A piece gets its number among the
   task's pieces of the same length.
2. Pieces are counted by length: at most LIMIT lengths, whatever the table. Best fit, longest first, needs no more than these counts,
   because pieces of one length and sequences with one room are interchangeable: ``plan`` lays out runs of equal sequences.
3. A piece's rank among all of its length (its number and the counts of the tasks before) gives its sequence and offset by the plan.

No sequence is closed for its rank or task, nothing goes to one task, and no piece but its length travels to the driver. The plan is
the same as best fit, longest first, over one list of all lengths. It has a bounded number of runs: a length splits at most one run
of equal sequences, into three; every other run it meets is filled as a whole, which more than halves its room. So there are at most
3 * LIMIT * (1 + log2(LIMIT)), some 74,000, in practice a few thousand.

Sequences are numbered from 0. Null text counts as empty: one piece with the end token alone. Null and repeated doc_ids are packed row
by row like others.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import arrow_rows, arrow_schema, cut_lineage

LIMIT = 2048
#: bits of a rank behind the length
RANK = 40
CACHE = 800_000
_tokenizers: dict[str, object] = {}


def word_tokenizer(path: str) -> Callable[[list[str]], list[bytes]]:
    """Token ids of texts as little-endian 32-bit bytes, for a tokenizer that drops white space and so works word by word.

    Words repeat, so a task keeps the ids of up to CACHE words and asks the library only for new ones.
    """
    import os

    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    library, known = _tokenizers[path]

    def encode(texts: list[str]) -> list[bytes]:
        # separators that str.split knows and the tokenizer does not count as white space stay inside a text
        split = [t.split() if not any(c in t for c in "\x1c\x1d\x1e\x1f") else [t] for t in texts]
        fresh = list({w for words in split for w in words if w not in known})
        for w, e in zip(fresh, library.encode_batch_fast(fresh, add_special_tokens=False)):
            known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > CACHE:  # the words met first, among them the frequent ones, stay
            for w in fresh:
                del known[w]
        return out

    return encode


Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[Run]:
    """Best fit, longest first, each into the fullest sequence it fits, for so many pieces of each length.

    Runs (length, first rank, end rank, pieces per sequence, first sequence, offset in it), ordered by length and rank.
    """
    rooms: list[tuple[int, int, int]] = []  # room, first sequence, number of sequences
    runs, opened = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect_left(rooms, (size, -1, -1))
            if k < len(rooms):
                room, first, n = rooms.pop(k)
            else:
                room, first, n = limit, opened, -(-left // (limit // size))
                opened += n
            # a sequence that took one piece is the fullest again until it is too full
            per = room // size
            for take, each in ((min(n, left // per), per), (1, left % per)):
                if take and each and n and left:
                    runs.append((size, rank, rank + take * each, each, first, limit - room))
                    if room > each * size:
                        insort(rooms, (room - each * size, first, take))
                    rank, left, first, n = rank + take * each, left - take * each, first + take, n - take
            if n:
                insort(rooms, (room, first, n))
    return sorted(runs)


def best_fit(sizes: list[int], limit: int = LIMIT) -> list[list[int]]:
    """Bins (lists of item numbers) of one list of sizes, by the plan."""
    ranks: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        ranks.setdefault(size, []).append(i)
    bins: dict[int, list[int]] = {}
    for size, low, high, each, first, _ in plan(Counter(sizes), limit):
        for k in range(high - low):
            bins.setdefault(first + k // each, []).append(ranks[size][low + k])
    return [bins[b] for b in sorted(bins)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenized(path: str, limit: int) -> Callable:
    """Task function: pieces with their number among the task's pieces of the same length."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_tokenizer(path)
        task = TaskContext.get().partitionId()
        done: list[tuple] = []
        counts: Counter[int] = Counter()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                part = [t or "" for t in texts[lo:lo + 256]]
                for doc, ids in zip(batch.column("doc_id")[lo:lo + 256].to_pylist(), encode(part)):
                    ids += b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(ids), 4 * limit)):
                        piece = ids[start:start + 4 * limit]
                        n = len(piece) // 4
                        done.append((doc, k, start // 4, n, zlib.crc32(piece), task, counts[n]))
                        counts[n] += 1
                if len(done) > 20_000:
                    yield arrow_rows(PIECES, done)
                    done = []
        if done:
            yield arrow_rows(PIECES, done)

    return cut


def placed(runs: list[Run]) -> Callable:
    """Task function: pieces with column rank to their sequences and offsets."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, _, each, first, at = np.array(runs, np.int64).reshape(-1, 6).T
        keys = (size << RANK) + low
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(keys, (length << RANK) + rank, "right") - 1
            nth = rank - low[run]
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                       pa.array(first[run] + nth // each[run]), pa.array(at[run] + nth % each[run] * length)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(PLACED))

    return place


def packed(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenized(path, limit), PIECES))
    counts = cut_lineage(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    runs = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)  # at most limit rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row per task
    ranked = pieces.join(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(placed(runs), PLACED)
