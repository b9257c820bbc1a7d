"""Importance resampling, prefix trie and exact top-k search against brute force, with edge inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import resample, search, trie
from barloom.llm.common import in_order

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_in_order_numbers_rows_over_partitions(spark):
    rows = [(i * 7 % 50, i) for i in range(50)] + [(None, 99), (3, 99)]
    got = in_order(spark.createDataFrame(rows, "k long, v long").repartition(5), F.asc_nulls_first("k"), "v", value=F.col("v")).orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.v) for r in got] == want and [r.place for r in got] == list(range(52))
    assert [r.before for r in got] == [sum(v for _, v in want[:i]) for i in range(52)]


def resample_brute(docs, target, n, buckets, share, least, seed=2024):
    def cut(t):
        return WORD.findall((t or "").translate(LOWER))

    def hashed(ws):
        return [zlib.crc32(" ".join(ws[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(hashed(cut(x)))
    for x in target:
        t.update(hashed(cut(x)))
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)}
    out = []
    for i, x in docs:
        ws = cut(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in hashed(ws))
        out.append([i, len(ws), len(hashed(ws)), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:share * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("n, buckets, share", [(1, 10_000, 30), (3, 50, 55)])
def test_resampled(spark, documents, corpus, monkeypatch, n, buckets, share):
    monkeypatch.setattr(resample, "SLICE", 3000)
    target = [(1, "A5 b17, c300 D4é"), (2, None), (3, ""), (None, corpus[0][1])]
    got = resample.resampled(documents.withColumn("weight", F.lit("clash")), spark.createDataFrame(target, "item_id long, text string"), share, 20, n, buckets)
    assert Counter(map(tuple, got.collect())) == resample_brute([(r[0], r[1]) for r in corpus], [t for _, t in target], n, buckets, share, 20)


def test_resampled_empty_tables(spark, empty, documents):
    assert resample.resampled(empty, documents).count() == 0
    got = resample.resampled(documents, empty)
    assert got.count() == documents.count() and got.filter("n_features = 0 and weight <> 0").count() == 0


def test_very_long_text_is_whole(spark):
    long = "word Other " * 500_000
    got = resample.resampled(spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string"), spark.createDataFrame([("x",)], "text string"), n=2).collect()
    assert {r.id: r.n_features for r in got} == {1: 1_999_999, 2: 1}


def rebuilt_brute(rows, group=5, most=9):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: z[:2])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % most for c in own}
    return {c: own.get(c - c % group, [])[:h[c]] + own[c][h[c]:] for c in own}


def trie_brute(convs):
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    return Counter((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in members[p] if len(convs[c]) == len(p)).encode()).hexdigest()) for p in members)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talk():
    r = np.random.default_rng(5)
    rows = []
    for c in range(120):
        for t in range(r.integers(1, 12)):
            rows.append((c, t, "user" if t % 2 == 0 else None, None if r.random() < .1 else f"é{r.integers(0, 2 + t % 3)}"))
    rows += [(200 + i, None if t == 0 else t, "user", f"long {t}") for i in range(3) for t in range(300)]  # over several tasks, copies
    rows += [(300, 1, "a", "x"), (None, 1, "a", "x"), (301, None, None, None)]
    return rows


@pytest.mark.parametrize("width", [1 << 27, 1 << 15])
def test_prefix_trie_of_rebuilt_conversations(spark, talk, monkeypatch, width):
    """Also with a sketch too narrow to prove much."""
    monkeypatch.setattr(trie, "WIDEST", width)
    monkeypatch.setattr(trie, "NARROWEST", min(width, trie.NARROWEST))
    monkeypatch.setattr(trie, "PIECE", 3)
    turns = trie.turn_digests(spark.createDataFrame(talk, TURNS).withColumn("depth", F.lit("clash")).repartition(6))
    got = trie.prefix_trie(*trie.shared_starts(turns)).collect()
    assert Counter(map(tuple, got)) == trie_brute(rebuilt_brute(talk))


def test_prefix_trie_without_rebuilding(spark):
    rows = [(c, t, "u", "same") for c in range(40) for t in range(30)] + [(50 + c, 0, "u", f"t{c}") for c in range(20)] + [(90, t, "v", f"{t}") for t in range(2000)]
    convs = {c: [(r, x) for k, _, r, x in rows if k == c] for c in {r[0] for r in rows}}
    convs[99] = []
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = trie.prefix_trie(trie.turn_digests(spark.createDataFrame(rows, TURNS).repartition(4)), ids).collect()
    assert Counter(map(tuple, got)) == trie_brute(convs)


def test_prefix_trie_of_one_and_of_none(spark):
    one = spark.createDataFrame([(7, 1, "u", "x"), (7, 1, "u", "x")], TURNS)
    assert Counter(map(tuple, trie.prefix_trie(trie.turn_digests(one)).collect())) == trie_brute({7: [("u", "x")] * 2})
    assert trie.prefix_trie(*trie.shared_starts(trie.turn_digests(one.limit(0)))).count() == 0


def test_borders_compose_over_several_tasks():
    from collections import namedtuple

    row = namedtuple("row", "part opens conv depth hi lo relative")
    turns = list(range(11, 18))

    def chain(start, xs):
        for x in xs:
            start = (start * trie.BASE + x) % trie.PRIME
        return start

    def end(d):
        return d >> 64, trie.signed(d & trie.LOW)

    parts = [row(0, False, 5, 2, *end(chain(1, turns[:2])), False), row(3, True, 5, 3, *end(chain(0, turns[2:5])), True), row(4, True, 6, 1, *end(chain(1, [9])), False)]
    carry, continued = trie.borders(parts)
    assert carry == {3: (2, chain(1, turns[:2])), 4: (5, chain(1, turns[:5]))} and continued == {0: 5, 3: 5}


def search_brute(rows, k, scale=256):
    able = [(n, i, [math.floor(scale * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, q, w in able:
        if q is None or q % 5:
            continue
        near = sorted((-sum(a * b for a, b in zip(w, z)), i is None, i or 0, m) for m, i, z in able if m != n)[:k]
        out.update((q, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(near))
    return out


@pytest.mark.parametrize("tile, column", [(8192, 65_536), (7, 10)])
def test_exact_top_k(spark, monkeypatch, tile, column):
    monkeypatch.setattr(search, "TILE", tile)
    monkeypatch.setattr(search, "COLUMN", column)
    r = np.random.default_rng(1)
    rows = [(i, np.where(r.random(12) < .4, 0, r.normal(size=12)).tolist()) for i in range(150)]
    rows += [(300 + i, rows[9][1]) for i in range(20)]  # ties
    rows += [(5, rows[9][1]), (5, rows[5][1]), (None, rows[9][1]), (400, None), (405, [1.0, None]), (410, [float("nan")] * 12), (415, [float("inf")]),
             (420, []), (425, [0.0] * 12), (430, rows[3][1][:4]), (435, [3.9e4] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    got = search.top_k(df, F.col("vec_id") % 5 == 0, k=5).drop("query_row")
    assert Counter(map(tuple, got.collect())) == search_brute(rows, 5)


def test_exact_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search.top_k(df, F.col("vec_id") == 0, k=5).drop("query_row").collect()] == [(0, 1, 1, 256 * 128)]
    assert search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_postings_scatter_narrow_and_wide():
    r = np.random.default_rng(3)
    weights = np.where(r.random((40, 9)) < .6, 0, r.integers(-(1 << 28), 1 << 28, (40, 9))).astype(np.int32)
    query = r.integers(-(1 << 28), 1 << 28, 9)
    assert (search.Postings(weights).scores(query) == weights.astype(np.int64) @ query).all()
    assert (search.Postings(weights % 7).scores(query % 5) == (weights % 7) @ (query % 5)).all()
