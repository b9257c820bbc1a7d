import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.operators import align, embedding, graph, scoring, targets, windows
from barloom.sources import readers, writers
from tests.conftest import days


def test_split_sizes(spark):
    df = spark.createDataFrame([("A", d) for d in days(1000)], "symbol string, date string").withColumn("date", F.to_date("date"))
    for tagged in (targets.split_by_position(df), targets.split_by_round(df)):
        assert {r.split: r["count"] for r in tagged.groupBy("split").count().collect()} == {"train": 750, "val": 125, "test": 125}


def test_targets(frame):
    df = frame("symbol string, date date, fwd_ret double", [("A", d, v) for d, v in zip(days(3), [0.1, 0.0, -0.2])])
    out = targets.model_targets(df)
    assert dict(out.dtypes)["target"] == "float" and [r.trend for r in out.orderBy("date").collect()] == [1, 0, 0]
    with pytest.raises(PySparkException):
        targets.model_targets(df.withColumn("fwd_ret", F.lit(None).cast("double"))).collect()


def test_windows_and_wavelet(frame):
    d = days(12)
    df = frame("symbol string, date date, split string, x double",
               [("A", d[i], "train" if i < 7 else "test", float(i)) for i in range(12)])
    out = windows.sliding_windows(df, ["x"], past=4, ahead=2).orderBy("split", "sample").collect()
    assert [(r.split, r.sample, r.x_x[0], r.y_x) for r in out] == [("train", 0, 0.0, [4.0, 5.0]), ("train", 1, 1.0, [5.0, 6.0])]
    for length in (2, 4, 20):
        low, high = (np.array(windows.wavelet_matrix(length, high=h)) for h in (False, True))
        assert np.abs(low + high - np.eye(length)).max() < 1e-8
    split = windows.wavelet_split(windows.sliding_windows(df, ["x"], past=4, ahead=2), "x_x", 4).collect()
    for r in split:
        assert np.allclose(np.array(r.x_x_low) + np.array(r.x_x_high), r.x_x)


@pytest.mark.parametrize("block", [2, 512])
def test_correlations(spark, block):
    rng = np.random.default_rng(42)
    base = rng.normal(size=(100, 1))
    x = np.hstack([base + rng.normal(size=(100, 1)) * s for s in (0.1, 0.5, 1, 2)] + [np.full((100, 1), 3.0)])
    rows = [(f"S{j}", d, float(x[i, j])) for i, d in enumerate(days(100)) for j in range(5)]
    df = spark.createDataFrame(rows, "symbol string, date string, r double").withColumn("date", F.to_date("date"))
    got = {(r.src, r.dst): r.weight for r in graph.correlation_matrix(df, "r", block).collect()}
    want = np.corrcoef(x[:, :4], rowvar=False)
    assert len(got) == 10 and all(got[f"S{i}", "S4"] is None for i in range(4))
    assert all(abs(got[f"S{i}", f"S{j}"] - want[i, j]) < 1e-12 for i in range(4) for j in range(i + 1, 4))
    counts = [graph.correlation_edges(df, "r", t, block).count() for t in (0.0, 0.5, 0.999)]
    assert counts == [sum(abs(want[i, j]) > t for i in range(4) for j in range(i + 1, 4)) for t in (0.0, 0.5, 0.999)]


def test_spectral_vectors(spark):
    rng = np.random.default_rng(2)
    w = np.triu(np.abs(rng.normal(size=(8, 8))), 1)
    nodes = spark.createDataFrame([(i,) for i in range(8)], "symbol bigint")
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(8) for j in range(i + 1, 8)],
                                  "src bigint, dst bigint, weight double")
    lap = graph.normalised_laplacian(edges, nodes)
    full = w + w.T
    d = 1 / np.sqrt(full.sum(0))
    want = np.eye(8) - d[:, None] * full * d[None, :]
    dense = np.zeros((8, 8))
    for r in lap.collect():
        dense[r.src, r.dst] = r.value
    assert np.abs(dense - want).max() < 1e-12
    out = graph.spectral_vectors(lap, 3, rounds=12).orderBy("symbol").collect()
    v, x = np.array([r.vector for r in out]), np.array(out[0]["values"])
    ref = np.linalg.eigvalsh(want)
    assert np.abs(v.T @ v - np.eye(3)).max() < 1e-8
    assert abs(x[0] - ref[np.argmax(np.abs(ref))]) < 0.02, (x, ref)


def test_structural_embedding(spark):
    ring = [(i, (i + 1) % 12, 1.0) for i in range(12)]
    edges = spark.createDataFrame(ring + [(20, 21 + i, 1.0) for i in range(5)], "src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([(i,) for i in [*range(12), *range(20, 26), 99]], "symbol bigint")
    out = {r.symbol: np.array(r.embedding) for r in embedding.structural_embedding(
        edges, nodes, dims=8, walks=3, length=6).collect()}
    assert len(out) == 19 and all(len(v) == 8 for v in out.values())
    assert not out[99].any() and all(out[i].any() for i in out if i != 99)


def test_cooccurrence_and_factors_against_numpy(spark):
    paths = [[1, 2, 3, 1], [2, 2, 4], [5], [4, 3, 2, 1, 5, 4, 4]]
    counts = np.zeros((6, 6))
    for path in paths:
        for i, x in enumerate(path):
            for y in path[i + 1:i + 3]:
                counts[x, y] += 1
                counts[y, x] += 1
    margin = counts.sum(axis=1)
    with np.errstate(invalid="ignore"):
        ref = np.nan_to_num(np.log1p(counts * counts.sum() / np.outer(margin, margin)))
    matrix = embedding.cooccurrence(spark.createDataFrame([(p,) for p in paths], "path array<bigint>"), 2)
    got = np.zeros((6, 6))
    for r in matrix.collect():
        got[r.src, r.dst] += r.value
    assert np.allclose(got, ref)
    for dims in (3, 8):
        out = {r.symbol: np.array(r.embedding) for r in embedding.factorised(matrix, dims, 5).collect()}
        e = np.array([out[i] for i in range(1, 6)])
        values = np.sort(np.abs(np.linalg.eigvalsh(ref[1:, 1:])))[::-1]
        want = np.pad(values, (0, max(0, dims - 5)))[:dims]
        assert np.allclose((e * e).sum(axis=0), want, atol=1e-2)
        assert np.allclose(e.T @ e, np.diag(want), atol=1e-2)


def test_nodes_alike_are_near(spark):
    """Two equal trees without a link between them: a node's twin is nearer than the average of all nodes."""
    tree = [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (2, 6), (6, 7), (7, 8), (3, 9)]
    edges = spark.createDataFrame([(a + s, b + s, 1.0) for a, b in tree for s in (0, 100)], "src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([(i + s,) for i in range(10) for s in (0, 100)], "symbol bigint")
    out = {r.symbol: np.array(r.embedding) for r in embedding.structural_embedding(edges, nodes, dims=8, walks=10, length=20).collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in out.items()}
    mean = np.mean(list(unit.values()), axis=0)
    assert all(unit[i] @ unit[i + 100] > unit[i] @ mean for i in range(10))


def test_score_windows_modes(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(9)], "sample int, x double")
    plain = scoring.score_windows(df, lambda f: f.assign(x=f.x * 2), "sample int, x double")
    assert plain.agg(F.sum("x")).first()[0] == 72
    across = scoring.score_windows(df, lambda f: f.assign(x=f.x - f.x.mean()), "sample int, x double", "sample")
    assert abs(across.agg(F.sum("x")).first()[0]) < 1e-9
    large = spark.range(150_000).selectExpr("1 as sample", "cast(id as double) as x")
    assert scoring.score_windows(large, lambda f: f.assign(x=float(len(f))).head(1), "sample int, x double", "sample").first().x == 150_000


def test_read_bars(spark, tmp_path):
    for t in ("AAPL", "BRK-B"):
        pd.DataFrame({"Date": pd.to_datetime(days(3)), "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": [1.0, np.nan, 3.0],
                      "Volume": 7}).to_parquet(tmp_path / f"{t}.parquet")
    out = readers.read_bars(spark, str(tmp_path))
    assert {r.symbol for r in out.collect()} == {"AAPL", "BRK-B"} and out.where(F.col("close").isNull()).count() == 2


def _plain_session(spark):
    """A session without the settings of ``barloom.session``."""
    other = spark.newSession()
    for name in ("spark.sql.legacy.parquet.nanosAsLong", "spark.sql.legacy.javaCharsets"):
        other.conf.set(name, "false")
    return other


def test_read_bars_in_any_session(spark, tmp_path):
    import datetime as dt

    frame = pd.DataFrame({"Date": pd.to_datetime(days(3)).astype("datetime64[ns]"), "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": 3.0, "Volume": 7})
    frame.to_parquet(tmp_path / "AAPL.parquet", version="2.6", coerce_timestamps=None)
    other = _plain_session(spark)
    rows = readers.read_bars(other, str(tmp_path)).orderBy("date").collect()
    assert [(r.symbol, r.date, r.volume) for r in rows] == [("AAPL", dt.date(2020, 1, i), 7.0) for i in (1, 2, 3)]
    assert other.conf.get("spark.sql.legacy.parquet.nanosAsLong") == "false"


def test_sectioned_prices_in_any_session(spark, tmp_path):
    import datetime as dt

    other = _plain_session(spark)
    bars = other.createDataFrame([("平安", dt.date(2020, 1, 1), 1.5, 2.0, 1.0, 1.75), ("B", dt.date(2020, 1, 2), 3.0, 4.0, 2.0, None)],
                                 "symbol string, date date, open double, high double, low double, close double")
    writers.write_sectioned_ohlc(bars, str(tmp_path / "s"))
    part, = (tmp_path / "s").glob("part-*")
    assert "收盘价" in part.read_bytes().decode("gbk")
    back = {(r.symbol, str(r.date)): (r.open, r.close) for r in readers.read_sectioned_ohlc(other, str(tmp_path / "s")).collect()}
    assert back == {("平安", "2020-01-01"): (1.5, 1.75), ("平安", "2020-01-02"): (None, None), ("B", "2020-01-01"): (None, None), ("B", "2020-01-02"): (3.0, None)}


def test_wide_and_positional(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("Date,BRK.B,A\n2020-01-01,1.5,\n2020-01-02,nan,2\n")
    wide = readers.read_wide_panel(spark, str(tmp_path / "wide.csv"))
    assert {(r.symbol, str(r.date)): r.value for r in wide.collect()} == {
        ("BRK.B", "2020-01-01"): 1.5, ("A", "2020-01-01"): None, ("BRK.B", "2020-01-02"): None, ("A", "2020-01-02"): 2.0}
    (tmp_path / "m.csv").write_text('1,2\n3,4\n"[ 0.1 0.2]",6\n')
    (tmp_path / "t.txt").write_text("X\n\nA\n")
    tickers = readers.read_ticker_list(spark, str(tmp_path / "t.txt"))
    dates = align.calendar_positions(spark.createDataFrame([(d,) for d in days(3)], "date string"))
    out = {(r.date, r.symbol): r.pred for r in readers.read_positional_matrix(
        spark, str(tmp_path / "m.csv"), dates, tickers, as_text=True).collect()}
    assert out["2020-01-01", "X"] == "1" and out["2020-01-03", "X"] == "[ 0.1 0.2]" and out["2020-01-02", "A"] == "4"
    with pytest.raises(PySparkException):
        readers.read_positional_matrix(spark, str(tmp_path / "m.csv"), dates.limit(2), tickers).collect()


def test_sectioned_prices(spark, tmp_path):
    lines = [",,日期,Date,2020-01-01,2020-01-02"]
    for k, word in enumerate(("开盘价", "最高价", "最低价", "收盘价")):
        lines += [f"{word},x,n,000001.SZ,{k}.5,--", f",x,n,600000.SH,{k},{k + 10}", ",note,,,,", ",note,,,,"]
    (tmp_path / "p.csv").write_bytes("\n".join(lines).encode("gbk"))
    out = {(str(r.date), r.symbol): (r.open, r.high, r.low, r.close) for r in readers.read_sectioned_ohlc(
        spark, str(tmp_path / "p.csv")).collect()}
    assert out == {("2020-01-01", "000001.SZ"): (0.5, 1.5, 2.5, 3.5), ("2020-01-02", "000001.SZ"): (None,) * 4,
                   ("2020-01-01", "600000.SH"): (0.0, 1.0, 2.0, 3.0), ("2020-01-02", "600000.SH"): (10.0, 11.0, 12.0, 13.0)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, x double")
    writers.write_panel(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.write_results({"t": df}, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "t")).count() == 2
    writers.write_split_table(spark.createDataFrame([(7, 9)], "train_end int, val_end int"), str(tmp_path / "s"))
    assert tuple(readers.read_split_table(spark, str(tmp_path / "s")).first()) == (7, 9)


def test_correlations_do_not_depend_on_the_grid(spark):
    rows = [(f"S{s:03d}", d, float((s * 37 + d * d * (s % 7 + 1)) % 101)) for s in range(60) for d in range(25)] + [("flat", d, 1.0) for d in range(25)]
    panel = spark.createDataFrame(rows, "symbol string, date int, x double")
    wide = np.array([[r[2] for r in rows if r[0] == f"S{s:03d}"] for s in range(60)])
    want = np.corrcoef(wide)
    for block in (None, 7):
        got = {(r.src, r.dst): r.weight for r in graph.correlations(panel, "x", block=block).collect()}
        assert len(got) == 61 * 60 // 2 and got["S059", "flat"] is None
        assert all(abs(got[f"S{i:03d}", f"S{j:03d}"] - want[i, j]) < 1e-9 for i in range(60) for j in range(i + 1, 60))
    edges = graph.correlation_edges(panel, "x", 0.3).count()
    assert edges == sum(abs(want[i, j]) > 0.3 for i in range(60) for j in range(i + 1, 60))


def test_features_written_by_folder(spark, tmp_path):
    import datetime as dt

    table = spark.createDataFrame([(dt.date(2020, 1, d), s, d + 0.5, None) for d in (1, 2) for s in (1, 2)], "date date, symbol bigint, A double, B double")
    table.write.parquet(str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide"))
    for _ in range(2):  # written anew the second time
        writers.write_features(stored, str(tmp_path / "out"), ["A", "B"])
    assert {p.name for p in (tmp_path / "out").glob("feature=*")} == {"feature=A", "feature=B"}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("feature = 'A'").agg(F.sum("value")).first()[0] == 8.0 and back.where("feature = 'B' and value is null").count() == 4


@pytest.mark.parametrize("entries", [40, 1_000_000])
def test_matrix_entries_lie_still(spark, monkeypatch, entries):
    """A round's product exchanges vectors and partial sums, not the entries, and is right over any number of blocks."""
    monkeypatch.setattr(graph, "BLOCK_ENTRIES", entries)
    rng = np.random.default_rng(8)
    full = np.triu(rng.normal(size=(30, 30)) * (rng.random((30, 30)) < 0.5))
    full = full + np.triu(full, 1).T
    matrix = spark.createDataFrame([(f"s{i}", f"s{j}", float(full[i, j])) for i, j in zip(*np.nonzero(full))] + [("s0", "s1", None)],
                                   "src string, dst string, value double")
    x = rng.normal(size=(30, 2))
    vectors = spark.createDataFrame([(f"s{i}", [float(v) for v in x[i]]) for i in range(30)], "symbol string, _x array<double>")
    packed, blocks = graph._blocked(matrix)
    assert blocks == (1 if entries == 1_000_000 else blocks) and (blocks > 1) == (entries == 40)
    product = graph._product(packed, blocks, vectors, 2)
    got = {r.symbol: r._p for r in product.collect()}
    assert np.allclose([got.get(f"s{i}", [0, 0]) for i in range(30)], full @ x)
    plan = product._jdf.queryExecution().executedPlan().toString()
    entry_side = plan.split("FileScan")[0].rsplit("CoGroups", 1)[1]
    assert "Exchange" not in entry_side, plan


def test_blocks_are_sorted_once(spark, monkeypatch):
    """Entries lie by row, and by column in ``turned``, so that a round sorts and looks up none; pieces of a block fit together."""
    monkeypatch.setattr(graph, "CHUNK", 7)
    matrix = spark.createDataFrame([(i, j, float(i + j)) for i in range(12) for j in range(12) if (i * j) % 5 < 2], "src long, dst long, value double")
    packed, _ = graph._blocked(matrix)
    pieces = packed.orderBy("piece").collect()
    rows, columns, turned = ([x for p in pieces for x in p[c]] for c in ("rows", "columns", "turned"))
    assert len(pieces) > 3 and rows == sorted(rows) and [p.names for p in pieces[1:]] == [[]] * (len(pieces) - 1)
    assert [columns[t] for t in turned] == sorted(j for i, j in zip(rows, columns) if i != j)
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(1, 12)], "symbol long, _x array<double>")  # one node has no vector
    got = {r.symbol: r._p[0] for r in graph._product(packed, 1, vectors, 1).collect()}
    assert got == {i: sum((i + j) * j for j in range(12) if (i * j) % 5 < 2) for i in range(1, 12)}


def test_walkers_carry_few_nodes(spark, monkeypatch):
    """Walks of any length are whole though a walker's row holds the last few nodes only."""
    seen, kept = {}, embedding.cut_lineage
    monkeypatch.setattr(embedding, "cut_lineage", lambda df: seen.setdefault("carried", []).append(
        df.agg(F.max(F.size("path"))).first()[0]) or kept(df) if "path" in df.columns else kept(df))
    monkeypatch.setattr(embedding, "cooccurrence", lambda walks: seen.update(sizes={len(r.path) for r in walks.collect()}) or spark.createDataFrame(
        [(0, 1, 1.0), (1, 0, 1.0)], "src bigint, dst bigint, value double"))
    ring = spark.createDataFrame([(i, (i + 1) % 12, 1.0) for i in range(12)], "src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(12)], "symbol bigint")
    embedding.structural_embedding(ring, nodes, dims=2, walks=2, length=13)
    assert seen["sizes"] == {13} and max(seen["carried"]) <= 6
