"""op4 and op5 against brute force; op6 against a full product."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import near, suffixes, vectors


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k:k + 5]) for k in range(len(w) - 4)])


def components(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def lowest(ids, roots):
    return [min((ids[j] for j in range(len(ids)) if roots[j] == roots[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def near_brute(rows):
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    low = lowest([r[0] for r in rows], components(len(rows), links))
    low = [x if s else r[0] for x, s, r in zip(low, sets, rows)]
    return Counter((r[0], len(s), x, r[0] == x) for r, s, x in zip(rows, sets, low))


def test_near_components(documents, corpus):
    got = near.near_components(documents).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == near_brute(corpus)


def test_near_chain_and_hot_group(spark):
    """A chain of texts, each linked with the next only, and many near copies of one text in the same buckets."""
    import random

    r = random.Random(1)
    w = [f"w{i}" for i in range(200)]
    rows, now = [], list(w)
    for i in range(12):
        rows.append((i, " ".join(now)))
        now = now[8:] + [f"n{i}_{k}" for k in range(8)]
    for i in range(100, 220):
        v = list(reversed(w))
        for _ in range(r.randint(0, 14)):
            v[r.randint(0, 199)] = f"y{i}_{r.randint(0, 5)}"
        rows.append((i, " ".join(v)))
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == near_brute(rows)


def test_drop_near_duplicates_keeps_one_of_each(documents, corpus):
    got = near.drop_near_duplicates(documents.withColumn("node", F.lit("clash")).withColumn("component", F.lit(1)))
    assert got.columns == [*documents.columns, "node", "component"]
    kept = Counter(i for i, _, _, k in near_brute(corpus).elements() if k or False)
    lost = Counter(i for i, _, _, k in near_brute(corpus).elements() if not k)
    found = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert all(found[i] == kept[i] for i in kept if i is not None) and all(found[i] == 0 for i in lost if i is not None and i not in kept)


def test_empty_tables(empty, spark):
    assert near.near_components(empty).count() == 0 and near.drop_near_duplicates(empty).count() == 0
    assert suffixes.repeated_passages(empty).count() == 0 and suffixes.remove_repeats(empty).columns == empty.columns
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def cut_brute(rows):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for r, t in zip(rows, texts):
        mark = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p:p + 200]] > 1:
                mark[p:p + 200] = b"\1" * 200
        left = bytes(c for c, m in zip(t, mark) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (not k or not mark[k - 1]))
        out.append((r[0], len(t), sum(mark), spans, hashlib.sha256(left).hexdigest(), left))
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeated_passages(documents, corpus, monkeypatch, crowd):
    """Also with every anchor treated as crowded, which sends single windows."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    got = suffixes.repeated_passages(documents).collect()
    assert Counter(map(tuple, got)) == Counter(x[:5] for x in cut_brute(corpus))


def test_remove_repeats(documents, corpus):
    got = suffixes.remove_repeats(documents.withColumn("d1", F.lit("clash")))
    assert got.columns == [*documents.columns, "d1"]
    want = Counter((i, None if r[1] is None else left.decode("utf-8", "ignore")) for r, (i, *_, left) in zip(corpus, cut_brute(corpus)))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_loser_tree_merges_any_runs():
    import random

    r = random.Random(3)
    for n in (1, 2, 3, 5, 8):
        runs, everything = [], []
        for _ in range(n):
            keys = sorted({bytes(r.choice(b"\0ab\xff") for _ in range(suffixes.KEY)) if r.random() < .5 else b"a" * (suffixes.KEY - 2) + bytes([r.randint(0, 255), r.randint(0, 2)])
                           for _ in range(r.randint(1, 40))})
            lcp, rest, last = [], b"", b""
            for k in keys:
                c = next((i for i in range(suffixes.KEY) if last[i:i + 1] != k[i:i + 1]), suffixes.KEY)
                lcp.append(c)
                rest += k[c:]
                last = k
            runs.append((len(keys), bytes(lcp), rest))
            everything += keys
        got = list(suffixes.merged(runs))
        assert [k for *_, k in got] == sorted(everything)
        for (_, _, _, a), (shared, _, _, b) in zip(got, got[1:]):
            assert shared == next((i for i in range(suffixes.KEY) if a[i] != b[i]), suffixes.KEY)


def vector_rows():
    r = np.random.default_rng(2)
    centre = r.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + .25 * r.normal(size=8)).tolist()) for i in range(90)]
    rows += [(i, r.normal(size=8).tolist()) for i in range(90, 140)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (7, [2 * x for x in rows[7][1]]), (202, None), (203, []), (204, [0.0] * 8),
             (205, [1.0, None]), (206, [float("nan")] * 8), (207, [float("inf")] + [0.0] * 7), (208, rows[9][1][:3]), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(spark, monkeypatch, block):
    rows = vector_rows()
    if block == 16:
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "TILE", 2)
        monkeypatch.setattr(vectors, "FAN", 2)
    x, good = vectors.unit_rows(__import__("pyarrow").array([v for _, v in rows]), 8)
    near_ = (x @ x.T >= .9) & good[:, None] & good[None, :] & ~np.eye(len(rows), dtype=bool)
    low = lowest([i for i, _ in rows], components(len(rows), list(zip(*np.nonzero(near_)))))
    want = Counter((i, int(n), l if g else i, i == (l if g else i)) for (i, _), n, l, g in zip(rows, near_.sum(1), low, good))
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert Counter(map(tuple, got.collect())) == want


def test_tile_pairs_travel_with_the_tiles(spark):
    """Each pair comes once with the blocks of both its tiles, and no tile is exchanged for its pairs."""
    blocks = spark.createDataFrame([(i, bytes(8), bytes(8), bytes([i]), i // 2) for i in range(40)], "block long, nodes binary, copies binary, vectors binary, tile long")
    pairs = [(a, b) for a in range(20) for b in range(a, 20) if (a * b) % 3 != 1]
    got = vectors.tile_pairs(blocks, spark.createDataFrame(pairs, "a long, b long"), 20)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert sorted((min(r.tile, r.other), max(r.tile, r.other)) for r in rows) == pairs
    for r in rows:
        for tile, side in ((r.tile, r.blocks), (r.other, r.others)):
            assert sorted(x.vectors[0] for x in side) == [2 * tile, 2 * tile + 1]


def test_far_boxes_are_skipped():
    a, b = np.zeros(3), np.ones(3)
    assert vectors.far(a, a + .1, b, b + .1, .5) and not vectors.far(a, b, b, b + 1, .01)
