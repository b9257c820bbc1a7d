"""Near duplicates by MinHash bands, verified by odd sketches and then on full sets.

A document's set holds its distinct 5-word shingles as 64-bit values (ASCII letters lower-cased, words cut at white space;
fewer words: the whole sequence as one shingle; no words: empty, linked with nothing). Two documents are linked when
100 * intersection >= 75 * union of the full sets.

1. Texts with equal sets form one class, named by a 64-bit hash of the set; everything below works on classes, so a large group
   of copies is one row.
2. A class has BANDS x ROWS MinHash values. A pair at similarity 0.75 shares none of the bands with a chance of
   (1 - 0.75^5)^48 = 2e-6. The values are also folded into an odd sketch: each value flips one of BITS parity bits, so
   the XOR of two sketches counts, by its population count, the values in which the two differ.
3. Buckets (equal band) are worked off without listing their pairs: every class is compared with its closest leader, links are
   grown to components, and only buckets which then still hold several components go on: everything outside a bucket's
   largest component against the bucket, first each class with the closest of PARTNERS members of each component, then with
   all members. The last step leaves no pair of different components in a common bucket uncompared.
4. Each comparison first looks at the sketches in the JVM. A pair estimated below 0.5, six standard deviations under the
   threshold, is dropped. A second odd sketch folds the whole set: its XOR has at most as many bits as the sets have
   shingles that only one of them holds, so a count above a seventh of both sizes proves a similarity under 0.75 (no loss).
   The rest is decided on the full sets.

Two different sets meet in a class name with a chance of 2^-64 per pair. Rows repeating a doc_id are treated as rows of one
document each; a null doc_id takes part, but never names a component (a component without any id has component_id null, and
its rows are kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barloom.llm.common import cut_lineage, grow_components

SHINGLE = 5
BANDS, ROWS = 48, 5
BITS = 1024
#: members of a component that stand for it in a bucket in the first of the last two steps
PARTNERS = 4
#: classes that a task may hold as a hash table (a long each, some 200 MB in all); beyond that an exchange finds them
HELD = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xD6E8FEB86659FD93)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def finish(x: np.ndarray) -> np.ndarray:
    """Spread of 64-bit values: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * FINISH
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return finish(np.arange(1, n + 1, dtype=np.uint64) * MIX + np.uint64(seed)) | np.uint64(1)


SEEDS = odd_numbers(BANDS * ROWS, 7)
FOLDS = odd_numbers(BANDS * ROWS, 99)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(SHINGLE, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = out * MIX + hashed[k:n - size + 1 + k]
    return np.unique(finish(out))


def name_of(values: np.ndarray) -> int:
    """Class of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def minima(values: np.ndarray) -> np.ndarray:
    """MinHash values, one for each of SEEDS."""
    low = np.full(len(SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 512):
        low = np.minimum(low, (values[i:i + 512, None] * SEEDS).min(axis=0))
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash values as signed 64-bit words."""
    at = finish(low * FOLDS + FOLDS) % np.uint64(BITS)
    bits = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def parity(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set; the bits of an XOR never outnumber the symmetric difference."""
    bits = np.bincount((values % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = finish(key * MIX + column)
    return key.view(np.int64)


def bits_apart(similarity: float) -> int:
    """Population count of the XOR expected at a similarity."""
    apart = 2 * len(SEEDS) * (1 - similarity)
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** apart))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(1)
    for batch in batches:
        nodes, sizes, keys, sketches, packed = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            values = shingles(text)
            sizes.append(len(values))
            if len(values):
                low = minima(values)
                nodes.append(name_of(values))
                keys.append(band_keys(low))
                sketches.append(np.concatenate((odd_sketch(low), parity(values))))
                packed.append(pack.compress(text.encode("utf-8", "surrogatepass")))
            else:
                for column in (nodes, keys, sketches, packed):
                    column.append(None)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
            pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
            names=["doc_id", "node", "n_shingles", "bands", "sketch", "z"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    known: dict = {"a": (None, None), "b": (None, None)}  # the last set of each side: after a join by class equal ones are neighbours

    def members(side: str, node: int, z) -> np.ndarray:
        if known[side][0] != node:
            known[side] = node, shingles(unpack.decompress(z).decode("utf-8", "surrogatepass"))
        return known[side][1]

    for batch in batches:
        good = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in "abxy")):
            x, y = members("a", a, x), members("b", b, y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, class, set size, bands, sketch and compressed text of every document."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketched, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(
            "node long, n_shingles long, bands array<long>, sketch array<long>, z binary").fields]))


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the classes in ``wanted`` (column node). Up to HELD classes every task holds them, so only their rows travel later."""
    small = wanted.limit(HELD + 1).count() <= HELD
    return rows.join(F.broadcast(wanted) if small else wanted, "node", "left_semi")


def promising(a: str, b: str) -> Column:
    """Whether the sketches (columns ``sketch_<side>``, sizes ``n_<side>``) leave a link possible."""
    return (7 * apart(a, b, BITS // 64) <= F.col(f"n_{a}") + F.col(f"n_{b}")) & (apart(a, b, 0) <= bits_apart(0.5))


def apart(a: str, b: str, lo: int) -> Column:
    """Population count of the XOR of the MinHash sketches (lo = 0) or whole-set sketches (lo = BITS // 64)."""
    return sum((F.bit_count(F.col(f"sketch_{a}")[i].bitwiseXOR(F.col(f"sketch_{b}")[i])) for i in range(lo, lo + BITS // 64)), F.lit(0))


def sketched(rows: DataFrame, sketches: DataFrame, side: str) -> DataFrame:
    """Rows with the sketch and size of the class in column ``side``."""
    return rows.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("n_shingles").alias(f"n_{side}"),
                                     F.col("bands").alias(f"bands_{side}")), side)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked on the full sets. Compressed texts travel, half as large as their sets of 64-bit values."""
    x, y = texts.select(F.col("node").alias("a"), F.col("z").alias("x")), texts.select(F.col("node").alias("b"), F.col("z").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_linked, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, node (class, null without words), n_shingles, component_id, kept."""
    rows = cut_lineage(sketch_documents(docs))
    classes = cut_lineage(rows.filter("node is not null").select("node", "n_shingles", "bands", "sketch").dropDuplicates(["node"]))
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "leader")
    members = cut_lineage(keyed.join(cut_lineage(shared), "key"))
    wanted = cut_lineage(members.select("node").distinct())
    sketches = cut_lineage(only(classes, wanted))
    texts = cut_lineage(only(rows.select("node", "z"), wanted).groupBy("node").agg(F.first("z").alias("z")))

    leaders = members.select(F.col("node").alias("a"), F.col("leader").alias("b")).filter("a <> b").distinct()
    links = cut_lineage(confirm(cut_lineage(_promising_pairs(leaders, sketches)), texts))
    found = cut_lineage(grow_components(wanted, links))

    for step in ("closest", "all"):
        mixed = _mixed_buckets(members, found)
        if mixed.isEmpty():
            break
        pairs = _remaining_pairs(mixed, sketches, step == "closest")
        links = cut_lineage(links.union(confirm(cut_lineage(pairs), texts)))
        found = cut_lineage(grow_components(wanted, links))

    named = rows.select("doc_id", "node", "n_shingles").join(found, "node", "left").withColumn(
        "group", F.coalesce("component", "node"))
    named = cut_lineage(named.select("doc_id", "node", "n_shingles", "group"))
    low = cut_lineage(named.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("low")))
    out = named.join(low, "group", "left").withColumn(
        "component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("low")))
    return out.select("doc_id", "node", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, node, component) of buckets that hold several components, with the bucket's lowest and highest
    component (low, high) and one class of each."""
    now = members.select("key", "band", "node").join(found, "node")
    ends = now.groupBy("key").agg(F.min(F.struct("component", "node")).alias("low"), F.max(F.struct("component", "node")).alias("high"))
    ends = cut_lineage(ends.filter("low.component <> high.component"))
    return cut_lineage(now.join(ends, "key"))


def _promising_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of each class's pairs the promising one with the closest sketch."""
    close = sketched(sketched(pairs, sketches, "a"), sketches, "b").filter(promising("a", "b"))
    return close.groupBy("a").agg(F.min_by("b", apart("a", "b", 0)).alias("b"))


def _remaining_pairs(mixed: DataFrame, sketches: DataFrame, closest: bool) -> DataFrame:
    """The promising pairs of different components in a bucket. The bucket's largest component is only the other side of a
    pair, never both, so a large component costs its size times the few classes outside it. The sketches travel with the members and
    are compared inside the join: pairs they rule out are never rows."""
    sizes = mixed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    rows = mixed.select("key", "band", "node", "component").join(cut_lineage(largest), "key")
    few = rows.filter("component <> main").select("key", "band", F.col("node").alias("p"), F.col("component").alias("pc"))
    many = rows.select("key", F.col("node").alias("q"), F.col("component").alias("qc"), "main")
    if closest:
        nth = F.row_number().over(Window.partitionBy("key", "qc").orderBy(F.xxhash64("q"), "q"))
        many = many.withColumn("nth", nth).filter(F.col("nth") <= PARTNERS).drop("nth")
    few, many = cut_lineage(sketched(few, sketches, "p")), cut_lineage(sketched(many, sketches, "q"))
    other = (F.col("pc") != F.col("qc")) & ((F.col("qc") == F.col("main")) | (F.col("p") < F.col("q")))
    # a pair counts in the first band that both share, once
    first = F.array_position(F.zip_with("bands_p", "bands_q", lambda x, y: x == y), True) == F.col("band") + 1
    found = few.join(many.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & other & promising("p", "q") & (F.lit(closest) | first))
    if closest:
        return found.groupBy(F.col("p").alias("a")).agg(F.min_by("q", apart("p", "q", 0)).alias("b"))
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [name_of(v) if len(v := shingles(t)) else None for t in batch.column("_d_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_d_row"), batch.column("_d_id"), pa.array(names, pa.int64())], names=["_d_row", "_d_id", "_d_node"])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``; documents without words stay."""
    lost = near_components(docs).filter("not kept").select(F.col("doc_id").alias("_l_id"), F.col("node").alias("_l_node")).distinct()
    row = F.struct(*docs.columns)
    named = docs.select(row.alias("_d_row"), F.col("doc_id").alias("_d_id"), F.col("text").alias("_d_text"))
    kind = named.schema
    named = named.mapInArrow(_with_class, T.StructType([kind["_d_row"], kind["_d_id"], T.StructField("_d_node", T.LongType())]))
    return named.join(cut_lineage(lost), F.col("_d_id").eqNullSafe(F.col("_l_id")) & (F.col("_d_node") == F.col("_l_node")),
                      "left_anti").select("_d_row.*")
