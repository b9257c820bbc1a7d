"""Repeated passages: bytes covered by a 200-byte string that starts more than once, found by a sparse suffix sort.

Each text is its UTF-8 bytes (null: empty); matches never cross texts. A full suffix array of all texts would move some two
hundred bytes per byte, so only anchor suffixes are sorted: the anchor of a window of SPAN bytes is its KEY-byte string
with the smallest hash (the leftmost of equals). It depends on the window's content alone, so equal windows have equal
anchors at equal places, and consecutive windows mostly share theirs (about one anchor in 90 bytes).

1. Every task sorts the anchor suffixes of its texts, cut to KEY bytes, collapses equal ones, front-codes the run (length of
   the common prefix with the entry before, and the rest) and sends it in key ranges. A key seen twice in a run is known
   to repeat: its places stay out of the run, only the key travels on.
2. Each range merges its runs by a loser tree. Entries carry their common prefix with the last winner; a longer one wins
   unseen, and bytes are compared only behind it. Neighbours that share all KEY bytes name the candidate anchors.
3. An exact check follows. Windows of one anchor form a block. Blocks of equal content are counted; in those seen twice every
   window repeats. Where an anchor string has several different blocks, one block of each kind is sent to the
   anchor's place, its windows are counted one by one (128-bit hashes, salted by window where an anchor has more than
   CROWD kinds of blocks), and repeated windows are joined to spans.

No step holds more than one text, one run or one key range in a task. Equal texts are named by a 128-bit hash; their spans are
computed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import arrow_rows, arrow_schema, cut_lineage, partitions
from barloom.llm.near import finish

SPAN = 200
KEY = 24
CROWD = 20_000
SAMPLE_TEXTS = 400
R1, R2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
PLACE = np.uint64((1 << 20) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and those of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers[base] = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))))
                              for b in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[base]
    return up[:n], down[:n]


def prefix_hash(text: np.ndarray, base: int) -> np.ndarray:
    up, _ = powers(base, len(text))
    return np.concatenate(([np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up)))


def string_hash(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings [start, end); equal strings have equal hashes wherever they stand."""
    _, down = powers(base, len(prefix))
    return finish((prefix[end] - prefix[start]) * down[start])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(place, first window, end of windows, block hash) of each anchor of a text, None for a text under SPAN bytes.

    The windows starting in [first, end) have the anchor in common; the block is all bytes they cover.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if n < SPAN:
        return None
    prefix = prefix_hash(data, R1)
    starts = np.arange(n - KEY + 1)
    rank = string_hash(prefix, R1, starts, starts + KEY) >> np.uint64(20)
    if n <= int(PLACE):
        low = (rank << np.uint64(20)) | starts.astype(np.uint64)
    else:  # places need more bits: the same order as numbers without gaps
        order = np.argsort(rank, kind="stable")
        low = np.empty(len(rank), np.uint64)
        low[order] = np.arange(len(rank), dtype=np.uint64)
    width, step = SPAN - KEY + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[:step - width], low[width - step:])
    place = (low & PLACE).astype(np.int64) if n <= int(PLACE) else order[low.astype(np.int64)]
    cut = np.flatnonzero(np.diff(place)) + 1
    first, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(place)]))
    place = place[first]
    block = string_hash(prefix, R1, first, end - 1 + SPAN)
    return place, first, end, finish(block + (place - first).astype(np.uint64) * np.uint64(R2))


def name_of(text: bytes) -> tuple[int, int]:
    """128-bit name of a text as two signed numbers."""
    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(text), np.int64))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _gathered(texts: list[bytes]) -> tuple | None:
    """Anchors of several texts: KEY-byte strings as a matrix, and columns (text, place, first, end, block)."""
    keys, columns = [], []
    for i, text in enumerate(texts):
        if (found := anchors(text)) is not None:
            data = np.frombuffer(text, np.uint8)
            keys.append(data[found[0][:, None] + np.arange(KEY)])
            columns.append((np.full(len(found[0]), i), *found))
    if not keys:
        return None
    return np.concatenate(keys), [np.concatenate(c) for c in zip(*columns)]


RUN = "range int, keys long, lcp binary, rest binary, repeated binary, refs binary, names binary"
FOUND = "anchor long, block long, d1 long, d2 long, first int, end int, copies int"
#: block of an anchor: number of the text in the run, first window, number of windows, copies of the text (2: more than one), hash
REF = np.dtype([("text", "<u2"), ("first", "<u4"), ("windows", "<u1"), ("copies", "<u1"), ("block", "<i8")])


def sorted_runs(bounds: list[bytes]) -> Callable:
    """Task function: one sorted, front-coded run per batch of texts, cut at the range bounds. Places of keys that
    repeat inside the run come as rows of their own (keys 0), to any range."""
    edges = np.array(bounds, f"S{KEY}")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for batch in batches:
            counts: dict[bytes, int] = {}
            for text in batch.column("text").to_pylist():
                text = encoded(text)
                counts[text] = counts.get(text, 0) + 1
            texts = list(counts)
            assert len(texts) < 1 << 16, "Arrow batches hold 10,000 rows by default"
            got = _gathered(texts)
            if got is None:
                continue
            keys, (text, _, first, end, block) = got
            copies = np.array(list(counts.values()))
            names = np.array([name_of(t) for t in texts], np.int64)
            words = np.ascontiguousarray(keys).view(">u8")
            order = np.lexsort(words.T[::-1])
            keys = keys[order]
            refs = np.empty(len(order), REF)
            for field, values in zip(REF.names, (text, first, end - first, np.minimum(copies[text], 2), block.view(np.int64))):
                refs[field] = values[order]
            differ = keys[1:] != keys[:-1]
            new = np.concatenate(([True], differ.any(axis=1)))
            starts = np.flatnonzero(new)
            amount = np.add.reduceat(refs["copies"].astype(np.int64), starts)
            again = amount > 1
            heads = keys[starts]
            group = np.cumsum(new) - 1
            lcp = np.concatenate(([0], (heads[1:] != heads[:-1]).argmax(axis=1)))
            at = np.searchsorted(edges, np.ascontiguousarray(heads).view(f"S{KEY}").ravel(), side="right") if len(edges) else np.zeros(len(heads), int)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(heads)]))
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                common = lcp[lo:hi].astype(np.uint8)
                common[0] = 0
                rest = heads[lo:hi][np.arange(KEY) >= common[:, None]]
                alone = refs[starts[lo:hi][~again[lo:hi]]]
                used, alone["text"] = np.unique(alone["text"], return_inverse=True)
                rows.append((int(at[lo]), int(hi - lo), common.tobytes(), pack.compress(rest.tobytes()), again[lo:hi].tobytes(), pack.compress(alone.tobytes()), names[used].tobytes()))
            local = again[group]
            if local.any():
                some, ids = refs[local], np.fromiter((xxhash.xxh3_64_intdigest(k.tobytes()) for k in heads[again]), np.uint64, int(again.sum()))
                hashed = ids.view(np.int64)[(np.cumsum(again) - 1)[group[local]]]
                for lo in range(0, len(some), 20_000):
                    part = some[lo:lo + 20_000].copy()
                    used, part["text"] = np.unique(part["text"], return_inverse=True)
                    salt = xxhash.xxh32_intdigest(names[used].tobytes()) % (len(edges) + 1)
                    rows.append((salt, 0, b"", b"", hashed[lo:lo + 20_000].tobytes(), pack.compress(part.tobytes()), names[used].tobytes()))
            for row in rows:
                yield arrow_rows(RUN, [row])

    return build


def merged(runs: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merge of front-coded runs (entries, common prefixes, rests) by a loser tree.

    Yields (common prefix with the entry before, run, number in the run, key). ``common[s]`` is the prefix that the
    head of run s shares with the last winner it met; -1 marks an exhausted run.
    """
    k = len(runs)
    heads: list[bytes] = [b""] * k
    number, offset, common = [-1] * k, [0] * k, [0] * k

    def advance(s: int) -> None:
        number[s] += 1
        size, lcps, rest = runs[s]
        if number[s] == size:
            common[s] = -1
            return
        shared = lcps[number[s]]
        heads[s] = heads[s][:shared] + rest[offset[s]:offset[s] + KEY - shared]
        offset[s] += KEY - shared
        common[s] = shared

    def first_wins(s: int, t: int) -> bool:
        """Of two heads with equal common prefix: compares behind it; the loser keeps what it shares with the winner."""
        h, a, b = common[s], heads[s], heads[t]
        if h < 0:
            return True
        while h < KEY and a[h] == b[h]:
            h += 1
        wins = h == KEY or a[h] < b[h]
        common[t if wins else s] = h
        return wins

    for s in range(k):
        advance(s)
    best, losers = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        s, t = best[2 * node], best[2 * node + 1]
        wins = common[s] > common[t] or common[s] == common[t] and first_wins(s, t)
        best[node], losers[node] = (s, t) if wins else (t, s)
    s = best[1] if k > 1 else 0
    while common[s] >= 0:
        yield common[s], s, number[s], heads[s]
        advance(s)
        node = (k + s) >> 1
        while node:
            t = losers[node]
            if common[t] > common[s] or common[t] == common[s] and not first_wins(s, t):
                losers[node], s = s, t
            node >>= 1


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: merges the runs of each range and gives the places of repeated keys."""
    ranges: dict[int, list[dict]] = {}
    unpack = zstandard.ZstdDecompressor()

    def rows(ids: np.ndarray, refs: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        name = names[refs["text"]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (
            ids, refs["block"], name[:, 0], name[:, 1], refs["first"].astype(np.int32), (refs["first"] + refs["windows"]).astype(np.int32),
            refs["copies"].astype(np.int32))], schema=arrow_schema(FOUND))

    for batch in batches:
        for row in batch.to_pylist():
            row["refs"] = unpack.decompress(row["refs"])
            if row["keys"]:
                row["rest"] = unpack.decompress(row["rest"])
                ranges.setdefault(row["range"], []).append(row)
            else:
                yield rows(np.frombuffer(row["repeated"], np.int64), np.frombuffer(row["refs"], REF), np.frombuffer(row["names"], np.int64).reshape(-1, 2))
    for runs in ranges.values():
        single = [np.cumsum(~np.frombuffer(r["repeated"], bool)) - 1 for r in runs]
        keep: list[list[tuple[int, int]]] = [[] for _ in runs]
        group: list[tuple[int, int]] = []
        held, ident, last = False, 0, b""

        def close() -> None:
            if len(group) > 1 or held:
                ident = xxhash.xxh3_64_intdigest(last)
                for s, i in group:
                    if not runs[s]["repeated"][i]:
                        keep[s].append((i, ident))

        for shared, s, i, key in merged([(r["keys"], r["lcp"], r["rest"]) for r in runs]):
            if shared < KEY:
                close()
                group, held, last = [], False, key
            group.append((s, i))
            held = held or bool(runs[s]["repeated"][i])
        close()
        for s, found in enumerate(keep):
            if found:
                at = single[s][[i for i, _ in found]]
                yield rows(np.array([x for _, x in found], np.uint64).view(np.int64), np.frombuffer(runs[s]["refs"], REF)[at],
                           np.frombuffer(runs[s]["names"], np.int64).reshape(-1, 2))


def range_bounds(docs: DataFrame, n: int) -> list[bytes]:
    """n - 1 keys that cut the anchors of SAMPLE_TEXTS texts (lowest hash of doc_id) into even parts."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _gathered([encoded(t) for t in batch.column("text").to_pylist()])
            if got is not None:
                some = np.unique(np.ascontiguousarray(got[0]).view(f"V{KEY}").ravel())
                take = some[np.linspace(0, len(some) - 1, min(len(some), 16 * n)).astype(int)]
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in take], pa.binary())], names=["key"])

    few = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id")).limit(SAMPLE_TEXTS).select("text")
    got = sorted({bytes(r[0]) for r in few.mapInArrow(keys, "key binary").collect()})
    return sorted({got[len(got) * i // n] for i in range(1, n)}) if got else []


def candidate_anchors(docs: DataFrame) -> DataFrame:
    """Places of anchors whose KEY bytes start more than once (columns FOUND)."""
    n = partitions(docs.sparkSession)
    runs = docs.select("text").mapInArrow(sorted_runs(range_bounds(docs, n)), RUN)
    return runs.repartition(n, "range").mapInArrow(_candidates, FOUND)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3)
    for batch in batches:
        texts = [encoded(t) for t in batch.column("text").to_pylist()]
        names = [name_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([
            pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
            pa.array([pack.compress(t) for t in texts], pa.binary())], names=["d1", "d2", "z"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each text once, compressed: (d1, d2, z). Copies are combined before the exchange."""
    return docs.select("text").mapInArrow(_texts, "d1 long, d2 long, z binary").groupBy("d1", "d2").agg(F.first("z").alias("z"))


WINDOWS = "slot long, d1 long, d2 long, at int, copies int, block binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted blocks of each text. An anchor with few kinds of blocks gathers them; otherwise each window goes to
    the place of its own hash."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text = unpack.decompress(row["z"])
            prefixes = None
            for b in row["wanted"]:
                first, end = b["first"], b["end"]
                if b["kinds"] <= CROWD:
                    rows.append((b["anchor"], row["d1"], row["d2"], first, b["copies"], text[first:end - 1 + SPAN]))
                    continue
                if prefixes is None:
                    prefixes = [(base, prefix_hash(np.frombuffer(text, np.uint8), base)) for base in (R1, R2)]
                starts = np.arange(first, end)
                one, two = (string_hash(p, base, starts, starts + SPAN) for base, p in prefixes)
                for slot, other, at in zip(one.view(np.int64).tolist(), two, starts.tolist()):
                    rows.append((slot, row["d1"], row["d2"], at, b["copies"], other.tobytes()))
            if len(rows) > 5_000:
                yield arrow_rows(WINDOWS, rows)
                rows = []
        if rows:
            yield arrow_rows(WINDOWS, rows)


SPANS = "d1 long, d2 long, start int, end int"


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the windows of a task's blocks and gives the spans of those that occur more than once."""
    names, starts, hashes, weights, singles = [], [], [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            block = row["block"]
            if len(block) == 8:
                one, two = np.array([row["slot"]], np.int64).view(np.uint64), np.frombuffer(block, np.uint64)
            else:
                data, at = np.frombuffer(block, np.uint8), np.arange(len(block) - SPAN + 1)
                one, two = (string_hash(prefix_hash(data, base), base, at, at + SPAN) for base in (R1, R2))
            names.append((row["d1"], row["d2"]))
            starts.append(row["at"])
            weights.append(np.full(len(one), row["copies"]))
            hashes.append((one, two))
    if not names:
        return
    sizes = np.array([len(w) for w in weights])
    one, two = (np.concatenate([h[i] for h in hashes]) for i in (0, 1))
    weight = np.concatenate(weights)
    order = np.lexsort((two, one))
    new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    total = np.add.reduceat(weight[order], np.flatnonzero(new))
    hit = np.empty(len(order), bool)
    hit[order] = (total > 1)[np.cumsum(new) - 1]
    out, offset = [], 0
    for name, start, size in zip(names, starts, sizes):
        mark = hit[offset:offset + size]
        offset += size
        if mark.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
            out += [(*name, start + int(a), start + int(b) - 1 + SPAN) for a, b in zip(edge[::2], edge[1::2])]
    for lo in range(0, len(out), 10_000):
        yield arrow_rows(SPANS, out[lo:lo + 10_000])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeated spans."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text, kept, spans, last = unpack.decompress(row["z"]), [], 0, 0
            at, removed = -1, 0
            for start, end in sorted((s["start"], s["end"]) for s in row["spans"]):
                if start > at:
                    kept.append(text[last:start])
                    spans += 1
                    removed += end - start
                elif end > at:
                    removed += end - at
                at = last = max(at, end)
            kept.append(text[last:])
            left = b"".join(kept)
            rows.append((row["d1"], row["d2"], removed, spans, hashlib.sha256(left).hexdigest(), pack.compress(left)))
        if rows:
            yield arrow_rows(CUT, rows)


CUT = "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string, kept_z binary"


def cut_texts(docs: DataFrame) -> DataFrame:
    """Each distinct text with a repeated passage: its name (d1, d2), figures and what is left of it, compressed."""
    found = cut_lineage(candidate_anchors(docs))
    same = found.groupBy("anchor", "block").agg(F.sum("copies").alias("copies"), F.min(F.struct("d1", "d2", "first", "end")).alias("one"))
    same = cut_lineage(same)
    twice = cut_lineage(same.filter("copies > 1").select("anchor", "block"))
    sure = (found.join(twice, ["anchor", "block"], "left_semi")
            .select("d1", "d2", F.col("first").alias("start"), (F.col("end") - 1 + SPAN).alias("end")))
    several = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = same.join(cut_lineage(several), "anchor").select("one.*", "anchor", "kinds", F.least("copies", F.lit(2)).cast("int").alias("copies"))
    wanted = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("anchor", "kinds", "copies", "first", "end")).alias("wanted"))
    texts = distinct_texts(docs)
    blocks = texts.join(wanted, ["d1", "d2"]).mapInArrow(_blocks, WINDOWS)
    open_ = blocks.repartition(partitions(docs.sparkSession), "slot").mapInArrow(_repeated_windows, SPANS)
    spans = cut_lineage(sure.union(open_).groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    return texts.join(spans, ["d1", "d2"]).mapInArrow(_cut, CUT)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [encoded(t) for t in batch.column("text").to_pylist()]
        names = [name_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
            names=["doc_id", "d1", "d2", "n_bytes", "sha"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select("doc_id", "text").mapInArrow(_named, T.StructType([
        docs.schema["doc_id"], *T._parse_datatype_string("d1 long, d2 long, n_bytes long, sha string").fields]))
    cut = cut_lineage(cut_texts(docs).drop("kept_z"))
    zero = F.lit(0).cast("long")
    return rows.join(cut, ["d1", "d2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def _row_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [name_of(encoded(t)) for t in batch.column("_s_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_s_row"), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64())],
                                         names=["_s_row", "d1", "d2"])


def _left_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        left = [None if z is None else unpack.decompress(z).decode("utf-8", "ignore") for z in batch.column("kept_z").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_s_row"), pa.array(left, pa.string())], names=["_s_row", "_s_left"])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; a character cut in two goes whole. Texts without
    repeats, and nulls, stay as they are."""
    row = docs.select(F.struct(*docs.columns).alias("_s_row"), F.col(text).alias("_s_text"))
    kind = T.StructType([row.schema["_s_row"], *T._parse_datatype_string("d1 long, d2 long").fields])
    cut = cut_lineage(cut_texts(docs).select("d1", "d2", "kept_z"))
    joined = row.mapInArrow(_row_names, kind).join(cut, ["d1", "d2"], "left").select("_s_row", "kept_z")
    left = joined.mapInArrow(_left_texts, T.StructType([row.schema["_s_row"], T.StructField("_s_left", T.StringType())]))
    return left.select(*[F.coalesce("_s_left", f"_s_row.{c}").alias(c) if c == text else F.col(f"_s_row.{c}") for c in docs.columns])
