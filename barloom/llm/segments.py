"""Sampled segmentations of texts into the pieces of a SentencePiece model, without replacement, and decoding.

A text's lattice holds every way to cut it into pieces (a character without a piece is written as byte pieces). A segmentation
has probability proportional to exp(theta * sum of piece weights); the weight is the model's score, or minus the logarithm
of the merge rank for a BPE model, whose scores are ranks. Giving each segmentation's log probability an independent
Gumbel noise and taking the k largest is sampling k without replacement (Gumbel top-k).

The noise is never drawn for all segmentations: the largest noise of a set of segmentations has a Gumbel distribution
located at the set's log mass, which the lattice's forward sums give exactly. So the best-first search (perturbed A*, the set's
perturbed maximum is an exact bound) starts with the set of all, draws the segmentation that attains its maximum, and puts the
sets that leave this path, unit by unit, back with maxima drawn below it. Each further sample is the best set on the queue.
Pieces never cross from one unit (white space, then other characters) to the next, so the lattice is built per distinct
unit and all samples of a batch are drawn together. All noise is a hash of the row's key, the sample and the place: a
replayed task draws the same.

A sample's inclusion score is the log probability that it is among the k: log(1 - exp(-exp(log_prob - threshold))), where the
threshold is the perturbed maximum left on the queue (0 if nothing is left, as then all segmentations were drawn). Texts with fewer
than k segmentations give fewer rows; an empty or null text gives one row without pieces. A null row key counts as the text's hash.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import arrow_rows
from barloom.llm.near import finish

SPACE = "▁"
THETA = 0.5
UNKNOWN = -12.0
BATCH_CHARS = 4_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1
_models: dict[str, "Pieces"] = {}


class Pieces:
    """Vocabulary of a model: hashes of its pieces by length, weights and the bytes each stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = np.array([model.get_score(i) for i in range(n)])
        ranked = bool((scores[plain] == np.round(scores[plain])).all())
        self.weight = np.where(np.isin(np.arange(n), plain), -np.log(2 - scores.clip(max=0)) if ranked else scores, UNKNOWN)
        self.raw = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i)
                    else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(len(pieces[i]) for i in plain)
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in range(1, self.longest + 1):
            some = [i for i in plain if len(pieces[i]) == length]
            points = np.frombuffer("".join(pieces[i] for i in some).encode("utf-32-le"), "<u4").reshape(-1, length)
            h = np.zeros(len(some), np.uint64)
            for c in points.T:
                h = (h + c + np.uint64(1)) * STEP
            order = np.argsort(h)
            maybe = np.zeros(1 << 20, bool)
            maybe[(h >> np.uint64(44)).astype(np.int64)] = True
            self.hashes[length] = h[order], np.array(some, np.int64)[order], maybe
        known = sorted({c for i in plain for c in pieces[i]} - {SPACE})
        inner = "".join(map(re.escape, known))
        self.units = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|.", re.S)

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edge labels; a label under 0 is a character without a piece."""
        lost = np.flatnonzero(edges < 0)
        if not len(lost):
            return edges
        spelled = [[self.byte_id[b] for b in chr(-1 - e).encode("utf-8", "surrogatepass")] for e in edges[lost].tolist()]
        sizes = np.ones(len(edges), np.int64)
        sizes[lost] = [len(x) for x in spelled]
        out = np.repeat(edges, sizes)
        out[np.repeat(edges < 0, sizes)] = [i for x in spelled for i in x]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def pieces_of(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class Lattice:
    """Lattices of many units as flat arrays. Edges are sorted by their end node; ``steps`` holds the end node plus the
    running share of the paths that enter it by the edge, so that one binary search draws an edge."""

    def __init__(self, model: Pieces, units: list[str], theta: float):
        lengths = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(points)
        self.first = np.cumsum(lengths + 1) - lengths - 1  # node before the unit's first character
        self.last = self.first + lengths
        unit = np.repeat(np.arange(len(units)), lengths)
        node = np.arange(n) + unit
        left = (self.last[unit] - node)
        place = node - self.first[unit]
        starts, ends, labels, weights, places = [], [], [], [], []
        h = np.zeros(n, np.uint64)
        for length in range(1, model.longest + 1):
            h = h[:n - length + 1]
            h = (h + points[length - 1:] + np.uint64(1)) * STEP
            at = np.flatnonzero(left[:len(h)] >= length)
            if not len(at):
                break
            table, ids, maybe = model.hashes[length]
            if length > 1:
                at = at[maybe[(h[at] >> np.uint64(44)).astype(np.int64)]]
            if len(table):
                k = np.searchsorted(table, h[at])
                k[k == len(table)] = 0
                hit = table[k] == h[at]
                label, found = ids[k[hit]], at[hit]
                weight = model.weight[label]
            else:
                label, found, weight = np.empty(0, np.int64), at[:0], np.empty(0)
            if length == 1:
                lost = at[~hit]
                size = 1 + (points[lost] > 0x7F).astype(int) + (points[lost] > 0x7FF) + (points[lost] > 0xFFFF)
                label, found = np.concatenate((label, -1 - points[lost].astype(np.int64))), np.concatenate((found, lost))
                weight = np.concatenate((weight, UNKNOWN * size))
            starts.append(node[found])
            ends.append(node[found] + length)
            labels.append(label)
            weights.append(theta * weight)
            places.append(place[found] + length)
        start, end, label, weight, place = map(np.concatenate, (starts, ends, labels, weights, places))
        order = np.argsort((place << 36) + (end << 5) + end - start)  # no two edges alike: the order is the lattice's own
        start, end, label, weight, place = (x[order] for x in (start, end, label, weight, place))
        alpha = np.zeros(n + len(units))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            value = alpha[start[lo:hi]] + weight[lo:hi]
            group = np.concatenate(([0], np.flatnonzero(np.diff(end[lo:hi])) + 1))
            top = np.maximum.reduceat(value, group)
            sizes = np.diff(np.concatenate((group, [hi - lo])))
            alpha[end[lo:hi][group]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, sizes)), group))
        self.log_share = alpha[start] + weight - alpha[end]
        order = np.argsort((end << 5) + end - start)
        self.start, self.end, self.label, self.log_share = (x[order] for x in (start, end, label, self.log_share))
        total = np.cumsum(np.exp(self.log_share))
        group = np.concatenate(([0], np.flatnonzero(np.diff(self.end)) + 1))
        sizes = np.diff(np.concatenate((group, [len(self.end)])))
        before = np.concatenate(([0.0], total))[group]
        self.steps = self.end + np.minimum(total - np.repeat(before, sizes), 1.0)
        self.steps[group + sizes - 1] = self.end[group] + 1.0

    def draw(self, units: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each unit by ancestral sampling from its end: edges of all units in text order, edges per unit and
        log probability per unit. ``key`` seeds each unit's draws."""
        order = np.argsort(units)  # equal units together: their edges stay in the cache
        units, key = units[order], key[order]
        at, todo, step = self.last[units], np.arange(len(units)), 1
        taken, counts, log_p = [], np.zeros(len(units), np.int64), np.zeros(len(units))
        while len(todo):
            u = (finish(key[todo] + np.uint64(step * int(STEP) % 2 ** 64)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = np.searchsorted(self.steps, at[todo] + u * (1 - 1e-9), side="right")
            taken.append((todo, counts[todo], edge))
            counts[todo] += 1
            log_p[todo] += self.log_share[edge]
            at[todo] = self.start[edge]
            todo = todo[at[todo] > self.first[units[todo]]]
            step += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        counts, log_p = counts[back], log_p[back]
        ends = np.cumsum(counts)
        out, ends_of = np.empty(int(ends[-1]) if len(ends) else 0, np.int64), ends[order]
        for who, number, edge in taken:
            out[ends_of[who] - 1 - number] = edge
        return out, counts, log_p

    def draw_other(self, unit: int, excluded: list[tuple[int, ...]], noise: Callable[[int], float]) -> tuple[int, ...]:
        """A segmentation of a unit apart from the excluded ones (edges from the end), by its share of the others."""
        at, path = int(self.last[unit]), []
        while at > self.first[unit]:
            lo, hi = np.searchsorted(self.end, [at, at + 1])
            shares = np.exp(self.log_share[lo:hi])
            for x in excluded:
                if len(x) > len(path):
                    shares[x[len(path)] - lo] -= np.exp(self.log_share[list(x[len(path):])].sum())
            shares = np.maximum(shares, 0).cumsum()
            edge = int(lo + min(np.searchsorted(shares, noise(len(path)) * shares[-1], side="right"), hi - lo - 1))
            path.append(edge)
            excluded = [x for x in excluded if len(x) >= len(path) and x[len(path) - 1] == edge]
            at = int(self.start[edge])
        return tuple(path)


def below(location: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel noise at a location, given that it is at most ``top``."""
    with np.errstate(divide="ignore", over="ignore"):
        shift = np.exp(np.minimum(location - top, 700.0)) - np.log(u)
        return np.where(np.isneginf(location), -np.inf, np.minimum(location - np.log(shift), top))


def finish_one(x: int) -> int:
    """``finish`` of one number, without arrays."""
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
    x = ((x ^ (x >> 29)) * 0x9E3779B97F4A7C15) & MASK
    return x ^ (x >> 32)


class _Index(dict):
    """Numbers units in the order of their first use."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class _Text:
    """Search state of one text: samples as (edges, edges per unit, log probability per unit) and the queue of sets."""

    def __init__(self, key: int, units: np.ndarray):
        self.key, self.units, self.samples, self.scores, self.queue = key, units, [], [], []

    def seed(self, sample: int, what: int) -> int:
        return finish_one((self.key + sample * 4 + what) & MASK)

    def noise(self, sample: int, what: int, place: int) -> float:
        return ((finish_one((self.seed(sample, what) + (place + 1) * int(STEP)) & MASK) >> 11) + 0.5) * 2.0 ** -53

    def noises(self, sample: int, what: int, since: int, to: int) -> np.ndarray:
        places = np.arange(since + 1, to + 1, dtype=np.uint64)
        return ((finish(np.uint64(self.seed(sample, what)) + places * STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53

    def add(self, edges: np.ndarray, counts: np.ndarray, log_p: np.ndarray, score: float, since: int, k: int) -> None:
        """A new sample that shares its units before ``since`` with earlier ones; queues the sets that leave it later."""
        number = len(self.samples)
        self.samples.append((edges, counts, log_p))
        self.scores.append(score)
        before = np.concatenate(([0.0], np.cumsum(log_p)))[:-1]
        with np.errstate(divide="ignore"):
            location = (before + np.log(-np.expm1(np.minimum(log_p, 0.0))))[since:]
        top = below(location, score, self.noises(number, 1, since, len(log_p)))
        best = np.argpartition(-top, min(k, len(top) - 1))[:k + 1] if len(top) else []
        for i in best:
            if np.isfinite(top[i]):
                heapq.heappush(self.queue, (-float(top[i]), number, int(since + i), ()))

    def path(self, number: int, unit: int) -> tuple[int, ...]:
        edges, counts, _ = self.samples[number]
        lo = int(counts[:unit].sum())
        return tuple(edges[lo:lo + int(counts[unit])][::-1].tolist())


def sample_batch(model: Pieces, keys: list[int], texts: list[str], k: int, theta: float) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text its samples: (piece ids, log probability, perturbed score, log inclusion probability), best first."""
    index = _Index()
    states = []
    for key, text in zip(keys, texts):
        cut = model.units.findall(SPACE + text.replace(" ", SPACE)) if text else []
        states.append(_Text(key, np.array(list(map(index.__getitem__, cut)), np.int64)))
    lattice = Lattice(model, list(index), theta) if index else None
    live = [s for s in states if len(s.units)]

    def draw(jobs: list[tuple[_Text, int]], sample: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """New draws of each text's units from a place on, all texts together."""
        units = np.concatenate([s.units[i:] for s, i in jobs])
        base = np.repeat(np.array([s.seed(sample, 0) for s, _ in jobs], np.uint64), [len(s.units) - i for s, i in jobs])
        seeds = finish(base + np.concatenate([np.arange(i, len(s.units), dtype=np.uint64) for s, i in jobs]) * STEP)
        edges, counts, log_p = lattice.draw(units, seeds)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out, at = [], 0
        for s, i in jobs:
            to = at + len(s.units) - i
            out.append((edges[ends[at]:ends[to]], counts[at:to], log_p[at:to]))
            at = to
        return out

    if live:
        for s, got in zip(live, draw([(s, 0) for s in live], 0)):
            s.add(*got, float(-np.log(-np.log(s.noise(0, 2, 0)))), 0, k)
    for number in range(1, k):
        jobs = []
        for s in live:
            if s.queue:
                score, base, unit, shut = heapq.heappop(s.queue)
                shut = shut or (s.path(base, unit),)
                other = lattice.draw_other(int(s.units[unit]), list(shut), lambda j, s=s: s.noise(number, 3, j))
                jobs.append((s, -score, base, unit, shut, other))
        if not jobs:
            break
        rest = draw([(j[0], j[3] + 1) for j in jobs], number)
        for (s, score, base, unit, shut, other), (edges, counts, log_p) in zip(jobs, rest):
            old_edges, old_counts, old_log = s.samples[base]
            own = float(lattice.log_share[list(other)].sum())
            s.add(np.concatenate((old_edges[:int(old_counts[:unit].sum())], np.array(other[::-1], np.int64), edges)),
                  np.concatenate((old_counts[:unit], [len(other)], counts)), np.concatenate((old_log[:unit], [own], log_p)), score, unit + 1, k)
            shut = (*shut, other)
            left = 1.0 - sum(float(np.exp(lattice.log_share[list(x)].sum())) for x in shut)
            if left > 1e-12:
                location = np.array([old_log[:unit].sum() + np.log(left)])
                top = float(below(location, score, np.array([s.noise(number, 2, unit + 1)]))[0])
                heapq.heappush(s.queue, (-top, base, unit, shut))
    out = []
    for s in states:
        if not len(s.units):
            out.append([(np.empty(0, np.int64), 0.0, 0.0, 0.0)])
            continue
        limit, rows = -s.queue[0][0] if s.queue else -np.inf, []
        for (edges, _, log_p), score in zip(s.samples, s.scores):
            total = float(log_p.sum())
            x = np.exp(min(total - limit, 50.0)) if s.queue else np.inf
            inside = 0.0 if not s.queue else total - limit if x < 1e-9 else float(np.log(-np.expm1(-x)))
            rows.append((model.ids(lattice.label[edges]), total, score, inside))
        out.append(rows)
    return out


def _batches(texts: list[str]) -> Iterator[slice]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _samples(path: str, k: int, theta: float, fields: str, row: Callable) -> Callable:
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in _batches(texts):
                own, some = ids[part], texts[part]
                keys = [xxhash.xxh3_64_intdigest(str(i) if i is not None else t.encode("utf-8", "surrogatepass")) for i, t in zip(own, some)]
                found = sample_batch(model, keys, some, k, theta)
                rows = [(i, n, *row(model, t, *s)) for i, t, samples in zip(own, some, found) for n, s in enumerate(samples)]
                for lo in range(0, len(rows), 5_000):
                    yield arrow_rows(fields, rows[lo:lo + 5_000])

    return sample


SEGMENTS = "doc_id long, sample int, ids array<int>, log_prob double, score double, log_inclusion double"
FIGURES = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, score double, log_inclusion double, decodes boolean"


def sample_segmentations(docs: DataFrame, path: str, k: int = 2, theta: float = THETA) -> DataFrame:
    """Per row of ``docs`` up to k rows: doc_id, sample (0 is the first drawn), ids, log_prob, score, log_inclusion. No exchange."""
    def row(model: Pieces, text: str, ids: np.ndarray, *numbers: float) -> tuple:
        return (ids, *numbers)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_samples(path, k, theta, SEGMENTS, row), SEGMENTS)


def segmentation_figures(docs: DataFrame, path: str, k: int = 2, theta: float = THETA) -> DataFrame:
    """The same samples as figures: pieces, checksum of the ids (little-endian 32-bit), and whether decoding gives the text."""
    def row(model: Pieces, text: str, ids: np.ndarray, *numbers: float) -> tuple:
        return (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *numbers, model.decode(ids) == text)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_samples(path, k, theta, FIGURES, row), FIGURES)


def decode_pieces(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with a column text: the ids decoded (null ids: null)."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("_i_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_i_row"), pa.array(texts, pa.string())], names=["_i_row", "text"])

    own = rows.select(F.struct(*rows.columns).alias("_i_row"), F.col(ids).alias("_i_ids"))
    done = own.mapInArrow(decode, T.StructType([own.schema["_i_row"], T.StructField("text", T.StringType())]))
    return done.select(*[F.col(f"_i_row.{c}") for c in rows.columns if c != "text"], "text")
