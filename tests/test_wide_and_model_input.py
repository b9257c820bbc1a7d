"""Wide matrices in blocks, raw file layouts, model samples, rank keys, eigenpairs and exported trees."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import features, graph, ranking, scoring, wide, windows
from barloom.sources import readers, writers
from tests.conftest import days


def test_numbered_keys_and_blocks(spark, frame):
    names = [f"k{i:03d}" for i in range(23)]
    dates = days(4)
    rows = [(d, n, float(i * 10 + j)) for j, d in enumerate(dates) for i, n in enumerate(names) if (i + j) % 3]
    rows.append((dates[0], None, 1.0))
    df = frame("date date, symbol string, v double", rows).repartition(5)
    keys = wide.numbered_keys(df, "symbol", 7)
    assert sorted(map(tuple, keys.collect())) == [(n, i, i // 7, i % 7) for i, n in enumerate(names)]
    blocks = wide.to_blocks(df, "v", keys)
    assert {(r.block, len(r["values"])) for r in blocks.collect()} == {(0, 7), (1, 7), (2, 7), (3, 2)} and blocks.count() == 16
    back = {(str(r.date), r.symbol): r.v for r in wide.from_blocks(blocks, keys, "v").collect()}
    want = {(d, n): None for d in dates for n in names} | {(d, n): v for d, n, v in rows if n}
    assert back == want
    assert wide.to_blocks(df.limit(0), "v", wide.numbered_keys(df.limit(0), "symbol")).count() == 0


def test_wide_csv_blocks(spark, frame, tmp_path):
    rows = [(d, s, v) for d in days(3) for s, v in (("A,B", 1.5), ('q"x', -2.0), ("C", None), ("D", 1e-7))]
    df = frame("date date, symbol string, v double", rows)
    writers.write_wide(df, f"{tmp_path}/w", "v", width=3)
    got = {(str(r.date), r.symbol): r.value for r in readers.read_wide_panel(spark, f"{tmp_path}/w").collect()}
    assert got == {(d, s): v for d, s, v in rows}


def test_ticker_files(spark, frame, tmp_path):
    rows = [("BRK-B", d, 1.0, 2.0, 0.5, 1.5, 9.0) for d in days(2)] + [("A", days(1)[0], 1.0, 2.0, 0.5, None, 9.0)]
    writers.write_bars(frame("symbol string, date date, open double, high double, low double, close double, volume double", rows), f"{tmp_path}/bars")
    assert sorted(p.name for p in (tmp_path / "bars").glob("*.parquet")) == ["A.parquet", "BRK-B.parquet"]
    assert sorted((r.symbol, str(r.date), r.close) for r in readers.read_bars(spark, f"{tmp_path}/bars").collect()) == sorted((r[0], r[1], r[5]) for r in rows)


def test_model_samples(spark):
    n, past, ahead = 9, 4, 2
    rows = [("s", d, "train" if i < 7 else "test", float(i), i % 2, [float(i), None if i == 3 else -float(i)], 5, i) for i, d in enumerate(days(n))]
    df = spark.createDataFrame(rows, "symbol string, date string, split string, fwd_ret double, trend int, features array<double>, month_code int, day_code int")
    got = windows.model_samples(df.repartition(3), past, ahead).orderBy("split", "sample").collect()
    assert [(r.split, r.sample, r.as_of) for r in got] == [("train", 0, days(n)[3]), ("train", 1, days(n)[4])]
    r = got[1]
    assert r.x_fwd_ret == [1.0, 2.0, 3.0, 4.0] and r.y_fwd_ret == [5.0, 6.0] and r.x_trend == [1, 0, 1, 0] and r.y_day_code == [5, 6]
    assert r.x_features == [[1.0, -1.0], [2.0, -2.0], [3.0, None], [4.0, -4.0]] and r.y_features == [[5.0, -5.0], [6.0, -6.0]]
    for side, size in (("x", past), ("y", ahead)):
        assert np.allclose(np.array(r[f"{side}_fwd_ret_low"]) + np.array(r[f"{side}_fwd_ret_high"]), r[f"{side}_fwd_ret"])


def test_order_key_keeps_the_order_of_doubles(spark):
    r = random.Random(3)
    xs = [0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 0.3, 2.0 ** 0.5]
    xs += [math.nextafter(x, math.inf) for x in xs if math.isfinite(x)] + [math.nextafter(x, -math.inf) for x in xs if math.isfinite(x)]
    xs += [2.0 ** e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0 ** e, 0) for e in range(-1000, 1024, 7)]
    xs += [r.uniform(-1, 1) * 10 ** r.randint(-30, 30) for _ in range(500)]
    xs = sorted({x + 0.0 for x in xs})
    keys = [row.k for row in spark.createDataFrame([(x,) for x in xs], "x double").select("x", ranking.order_key(F.col("x")).alias("k")).orderBy("x").collect()]
    assert all(a < b for a, b in zip(keys, keys[1:])) and -(1 << 63) <= keys[0]


def test_crowded_cells_of_any_values(spark):
    """Values that share 16, 32 and nearly 48 bits, among others: no cell above the bound, average ranks as sorted."""
    xs = [1.0 + i * 2.0 ** -52 for i in range(300)] + [1.0 + i * 2.0 ** -25 for i in range(300)] + [float(i) for i in range(-20, 20)]
    df = spark.createDataFrame([("d", x) for x in xs for _ in range(1 + int(x == 7.0))], "date string, v double")
    values = df.groupBy("date", "v").agg(F.count("*").alias("n"))
    cells = ranking.cut_crowded(values, ["date"], "v", cell=50).groupBy("_cell").agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = sorted((r.low, r.high, r._cell, r.k) for r in cells.collect())
    assert max(k for *_, k in found) <= 300 and all(a[1] < b[0] and a[2] < b[2] for a, b in zip(found, found[1:]))
    assert sum(k > 50 for *_, k in found) <= 1  # only what shares 48 bits may exceed it


@pytest.mark.parametrize("nodes, k", [(40, 4), (3, 4)])
def test_spectral_vectors_to_a_residual(spark, nodes, k):
    rng = np.random.default_rng(4)
    w = np.triu(np.abs(rng.normal(size=(nodes, nodes))), 1)
    names = spark.createDataFrame([(i,) for i in range(nodes)], "symbol bigint")
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(nodes) for j in range(i + 1, nodes)], "src bigint, dst bigint, weight double")
    laplacian = graph.normalised_laplacian(edges, names)
    d = 1 / np.sqrt((w + w.T).sum(0))
    want = np.linalg.eigvalsh(np.eye(nodes) - d[:, None] * (w + w.T) * d[None, :])
    pairs = graph.spectral_vectors(laplacian, k, widest=24)
    out = pairs.orderBy("symbol").collect()
    v, k = np.array([r.vector for r in out]), min(k, nodes)
    assert np.allclose(out[0]["values"], want[np.argsort(-np.abs(want))][:k], atol=1e-9) and np.abs(v.T @ v - np.eye(k)).max() < 1e-8
    assert graph.eigen_residuals(laplacian, pairs).agg(F.max(F.abs("residual"))).first()[0] < 1e-5


def test_exported_trees_score_like_the_model(spark):
    r = np.random.default_rng(6)
    rows = [(i, "2020-01-01", ("train", "val", "test")[i % 3], float(x[0] > 0) + 0.5 * float(x[1] > 1), *[None if i % 11 == 0 else float(v) for v in x])
            for i, x in enumerate(r.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "symbol int, date string, split string, fwd_ret double, a double, b double, c double")
    model = scoring.fit_boosted_trees(df, ["a", "b", "c"], max_iter=5, max_depth=3)
    trees = scoring.tree_rows(model, ["a", "b", "c"])
    assert spark.createDataFrame(trees, scoring.TREE_ROWS).where("feature is null and prediction is null").count() == 0
    got = {x.symbol: x.s for x in df.where("split = 'test'").select("symbol", scoring.tree_score(trees).alias("s")).collect()}
    want = {x.symbol: x.score for x in scoring.boosted_tree_scores(df, ["a", "b", "c"], max_iter=5, max_depth=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_feature_matrix_wide(spark, frame):
    rows = [(s, d, float(i)) for s in ("b", "a") for i, d in enumerate(days(3))]
    df = frame("symbol string, date date, f double", rows)
    got = features.feature_matrix_wide(df, "f", wide.numbered_keys(df, "symbol")).orderBy("date").collect()
    assert [r["values"] for r in got] == [[float(i)] * 2 for i in range(3)]


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_csv_line_breaks_over_splits(spark, tmp_path, split):
    """Records with line breaks in quotes, cut into file splits anywhere."""
    r = random.Random(split)
    cells = ["plain", "a,b", 'say "x"', "two\nlines", "\n", 'q""\n"\n,', "", "é\n\n日", "tail\n" * 8, "cr\rin"]
    rows = [(i, r.choice(cells), r.choice(cells)) for i in range(120)]
    quote = lambda x: '"' + x.replace('"', '""') + '"' if x and (any(c in x for c in ',"\n\r') or r.random() < .3) else x
    for k in (0, 1):
        body = "".join(f"{i},{quote(a)},{quote(b)}\n" for i, a, b in rows[k::2])
        (tmp_path / f"f{k}.csv").write_bytes(("id,a,b\n" + body).encode())
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = readers.read_csv_folder(spark, f"{tmp_path}/*.csv", "id int, a string, b string", ["id", "b", "a"]).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((x.id, x.a, x.b) for x in got) == [(i, a or None, b or None) for i, a, b in rows]
