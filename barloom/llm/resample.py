"""Target-distribution importance resampling: hashed n-gram features, log-ratio gains, Gumbel top-k.

A text's words are maximal runs of ASCII digits and letters (lower-cased) and of all characters beyond ASCII. Its features are all runs of 1 to
``n`` consecutive words; a feature's bucket is the CRC-32 of its words joined by one space, modulo ``buckets``. With S features in all, s of
them in the bucket, and T and t in the target texts, a bucket gains floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), and a text
weighs the sum over its features. Adding Gumbel noise from the hash of its id and taking the highest scores draws texts without replacement in
proportion to exp(weight / 1000).

Texts pass through Arrow kernels a batch at a time: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode``. N-grams
are pairs of an (n-1)-gram's number and the index of the word n - 1 places on, so strings are never joined: only distinct pairs get a CRC,
continued from that of their (n-1)-gram. Each text keeps its distinct buckets with counts (written once). Counts of all texts are summed
per task, then over tasks: at most ``buckets`` rows. A second pass takes the gains at the buckets and reduces them segment by segment.
All rows are then ranked by one range exchange of a few numbers each; nothing is gathered but the counts of buckets.

Null and empty texts have no features and weight 0. Very long texts are whole (one text is always in one batch). Rows that repeat
an id are texts of their own with equal noise; ties go to the smaller id (null last, its noise is that of an empty id), then to the row.
Without target texts or without documents all works the same (T or S is 0). Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import cut_lineage, in_order

BETWEEN = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
#: Bytes of text worked on at a time (a longer text alone).
SLICE = 4 << 20

FEATURES = "row long, id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes of text each, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start, base = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def bucket_counts(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Words and features of each text; text number, bucket and count of each distinct pair, in the order of texts."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
    filled = pc.not_equal(pc.binary_length(flat), 0)
    flat, parent = flat.filter(filled), parent.filter(filled).to_numpy(zero_copy_only=False)
    encoded = flat.dictionary_encode()
    index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = encoded.dictionary.cast(pa.binary() if encoded.dictionary.type == pa.string() else pa.large_binary()).to_pylist()
    gram, crc = index, np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    n_words = np.bincount(parent, minlength=len(texts))
    texts_of, buckets_of = [parent], [(crc % buckets)[gram]]
    for k in range(1, n):
        inside = parent[k:] == parent[:-k]
        # a gram that ends inside the text is followed by the word k places after its start
        pair = gram[:len(inside)] * len(names) + index[k:]
        distinct, at = np.unique(pair[inside], return_inverse=True)
        crc = np.fromiter((zlib.crc32(b" " + names[p % len(names)], int(crc[p // len(names)])) for p in distinct.tolist()), np.int64, len(distinct))
        gram = np.zeros(len(inside), np.int64)
        gram[inside] = at
        texts_of.append(parent[:len(inside)][inside])
        buckets_of.append((crc % buckets)[at])
        if not len(distinct):
            break
    of = np.concatenate(texts_of).astype(np.int64)
    pairs, counts = np.unique(of * buckets + np.concatenate(buckets_of), return_counts=True)
    return n_words, np.bincount(of, minlength=len(texts)), pairs // buckets, pairs % buckets, counts


def _features(n: int, buckets: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            for start, stop in slices(texts, SLICE):
                words, features, of, bucket, counts = bucket_counts(texts.slice(start, stop - start), n, buckets)
                offsets = pa.array(np.searchsorted(of, np.arange(len(words) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (bucket, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(start, stop - start) for i in (0, 1)]
                                                 + [pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists],
                                                 names=[f.split()[0] for f in FEATURES.split(", ")])

    return count


def features(texts: DataFrame, id_column: str, n: int, buckets: int, text: str = "text") -> DataFrame:
    """Distinct buckets with counts of each text, written."""
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return cut_lineage(rows.mapInArrow(_features(n, buckets), FEATURES))


def _summed(buckets: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return add


def bucket_totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all texts; at most ``buckets`` numbers reach the driver."""
    sums = counted.select("buckets", "counts").mapInArrow(_summed(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, per bucket."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + buckets) / ((x + 1.0) * (t + buckets)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(gain: np.ndarray) -> Callable:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            taken = pc.take(pa.array(gain), lists.flatten()).to_numpy() * batch.column("counts").flatten().to_numpy()
            ends = np.cumsum(length)
            sums = np.concatenate([[0], np.cumsum(taken)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "n_words", "n_features")), pa.array(sums[ends] - sums[ends - length], pa.int64())],
                                             names=["row", "id", "n_words", "n_features", "weight"])

    return weigh


def resampled(documents: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, n: int = 1, buckets: int = 10_000, seed: int = 2024,
              id_column: str = "doc_id", target_id: str | None = None) -> DataFrame:
    """All documents as (id, n_words, n_features, weight, score, rank): ``share`` percent of those with ``least_words`` are drawn, the others have no rank."""
    counted = features(documents, id_column, n, buckets)
    wanted = features(target.withColumn("_none", F.lit(None).cast("long")), target_id or "_none", n, buckets)
    gain = gains(bucket_totals(counted, buckets), bucket_totals(wanted, buckets))
    weighed = counted.mapInArrow(_weighed(gain), "row long, id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("long_enough", F.col("n_words") >= least_words)
    placed = in_order(scored, F.desc("long_enough"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    drawn = share * placed.agg(F.count_if("long_enough")).first()[0] // 100
    return placed.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
