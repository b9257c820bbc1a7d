"""Inputs the bench tables never hold: crowded values, shared prefixes, missing cells, other column orders, wide lines."""
import math

from pyspark.sql import functions as F

from barloom.operators import evaluate, graph, portfolio, ranking, reports, windows
from barloom.sources import readers, writers


def test_crowded_values_are_cut_again(spark):
    """A million values in [0.5, 0.504]: no cell above the bound, ranks as sorted."""
    n = 1_000_000
    values = spark.range(n).select(F.lit("d").alias("date"), (0.5 + 0.004 * F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("v"), F.lit(1).alias("n"))
    celled = ranking.cut_crowded(values.withColumn("_cell", F.array(ranking._cell(F.col("v")))), ["date"], "v")
    assert celled.groupBy("_cell").count().agg(F.max("count")).first()[0] <= ranking.CELL
    small = spark.range(3000).select(F.lit("d").alias("date"), (0.5 + F.col("id") * 1e-6).alias("v"))
    ranked = ranking.value_ranks(small, ["date"], "v").orderBy("v").collect()
    assert [r.below for r in ranked] == list(range(3000)) and {r.total for r in ranked} == {3000}


def test_ranks_with_tiny_cells(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELL", 3)
    rows = [("a", v) for v in [0.5, 0.5, 0.5001, 0.50011, 0.50012, 0.50013, 0.5003, -2.0, 0.0, 1e300, -1e-300, 0.50010001, 0.50010002]] + [("b", 1.0)]
    got = ranking.average_rank(spark.createDataFrame(rows, "date string, v double"), "v", "r").collect()
    a = sorted(v for d, v in rows if d == "a")
    assert all(math.isclose(r.r, (a.index(r.v) + 1 + a.index(r.v) + a.count(r.v)) / 2) for r in got if r.date == "a")


def test_ties_that_share_a_prefix(spark):
    rows = [("a", f"600{i:04d}.SH", 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "date string, symbol string, v double")
    cut = ranking._with_tie_cells(df, ["date", "v"], "symbol", F.lit(True), limit=100)
    assert cut.groupBy("_part").count().agg(F.max("count")).first()[0] <= 100
    got = ranking.descending_row_number(df, "v", "rn", "total").collect()
    assert all(r.rn == int(r.symbol[3:7]) + 1 and r.total == 900 for r in got)


def test_windows_keep_samples_with_missing_cells(spark, frame):
    days = [f"2020-01-{i + 1:02d}" for i in range(20)]
    rows = [("s", d, None if i == 7 else float(i), None if i == 3 else float(-i), "train") for i, d in enumerate(days)]
    got = windows.sliding_windows(frame("symbol string, date date, a double, b double, split string", rows), ["a", "b"], 4, 2).orderBy("sample").collect()
    assert len(got) == 15 and all(len(r.x_a) == len(r.x_b) == 4 and len(r.y_a) == len(r.y_b) == 2 for r in got)
    assert got[4].x_a == [4.0, 5.0, 6.0, 0.0] and got[0].x_b == [0.0, -1.0, -2.0, 0.0]


def test_days_without_a_pair_stay_undefined(frame):
    rows = [("2020-01-01", 1.0, 2.0), ("2020-01-01", 2.0, 3.0), ("2020-01-02", None, 1.0), ("2020-01-02", 1.0, None)]
    df = frame("date date, pred double, label double", rows)
    got = {str(r.date): r.IC for r in evaluate.ic_spearman_by_day(df).collect()}
    assert got == {"2020-01-01": 1.0, "2020-01-02": None}
    assert evaluate.ic_summary(evaluate.ic_spearman_by_day(df)).first().n_undefined == 1
    assert {str(r.date): r.IC for r in evaluate.ic_by_day(df).collect()} == got


def test_csv_columns_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,date,close,volume\n1,2020-01-01,1.5,100\n")
    (tmp_path / "b.csv").write_text('volume,note,close,symbol,date\n200,"x, ""y""",2.5,2,2020-01-02\n,,,3,2020-01-03\n')
    (tmp_path / "c.csv").write_text("symbol,date,close\n4,2020-01-04,4.5\n")
    got = readers.read_csv_folder(spark, f"{tmp_path}/*.csv", "symbol bigint, date date, close double, volume double", ["symbol", "close", "volume"])
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, 100.0), (2, 2.5, 200.0), (3, None, None), (4, 4.5, None)]


def test_wide_quoted_matrix(spark, frame, tmp_path):
    n = 10_000
    line = ",".join(f'"[{i}.5, {-i}.25]"' for i in range(n))
    (tmp_path / "m.csv").write_text(f"{line}\n{line}\n")
    dates = frame("date date, pos int", [("2020-01-01", 0), ("2020-01-02", 1)])
    tickers = spark.range(n).select(F.col("id").alias("symbol"), F.col("id").cast("int").alias("pos"))
    got = readers.read_positional_matrix(spark, f"{tmp_path}/m.csv", dates, tickers, "cell", as_text=True)
    assert got.count() == 2 * n and got.where("symbol = 77").first().cell == "[77.5, -77.25]"


def test_matrix_round_trip(spark, frame, tmp_path):
    from barloom.operators.align import calendar_positions

    rows = [("2020-01-02", "b", 2.0), ("2020-01-01", "a", 1.0), ("2020-01-01", "b", -3.5)]
    df = frame("date date, symbol string, v double", rows)
    writers.write_matrix(df, f"{tmp_path}/m", "v")
    back = readers.read_positional_matrix(spark, f"{tmp_path}/m", calendar_positions(df), spark.createDataFrame([("a", 0), ("b", 1)], "symbol string, pos int"), "v")
    assert {(str(r.date), r.symbol, r.v) for r in back.collect()} == {*rows, ("2020-01-02", "a", None)}


def test_flat_series_have_no_correlation(frame):
    rows = [(f"2020-01-0{i + 1}", s, v) for s, vs in (("a", (1, 2, 3)), ("b", (2, 4, 6)), ("c", (5, 5, 5))) for i, v in enumerate(vs)]
    got = {(r.src, r.dst): r.weight for r in graph.correlation_matrix(frame("date date, symbol string, v double", [(d, s, float(v)) for d, s, v in rows]), "v").collect()}
    assert math.isclose(got["a", "b"], 1.0) and got["a", "c"] is None and got["b", "c"] is None


def test_ticker_numbers_over_dates(frame):
    rows = [("2020-01-02", "x", 9.0), ("2020-01-01", "b", 1.0), ("2020-01-01", "a", 2.0), ("2020-01-02", "a", 5.0), ("2020-01-03", "c", 1.0)]
    held = frame("date date, ticker string, predicted_score double", rows)
    assert {r.ticker: r.seat for r in reports.held_tickers(held).collect()} == {"a": 1, "b": 2, "x": 3, "c": 4}
    assert portfolio.positions(frame("date date, symbol string, score double", rows), 1).count() == 3
