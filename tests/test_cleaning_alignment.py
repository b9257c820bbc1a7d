import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.functions.strings import format_symbol
from barloom.operators import align, clean
from tests.conftest import days

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def bars(frame, series):
    rows = []
    for symbol, values in series.items():
        for d, v in zip(days(len(values)), values):
            rows.append((symbol, d, v, v, v, v, v))
    return frame(BAR, rows)


def values(df, symbol, column="close"):
    return [r[0] for r in df.where(F.col("symbol") == symbol).orderBy("date").select(column).collect()]


def test_fill_stops_after_five_rows(frame):
    five = [1.0] + [None] * 5 + [2.0]
    six = [1.0] + [None] * 6 + [2.0]
    out = clean.ffill_limit(bars(frame, {"A": five, "B": six}))
    assert values(out, "A") == [1.0] * 6 + [2.0]
    assert values(out, "B") == [1.0] * 6 + [None, 2.0]


def test_sparse_symbol_dropped_gappy_kept(frame):
    dense = [float(i) for i in range(300)]
    sparse = [None if 50 <= i < 80 else float(i) for i in range(300)]
    gappy = [None if i % 33 == 10 else float(i) for i in range(300)]
    table = clean.ffill_limit(bars(frame, {"DENSE": dense, "SPARSE": sparse, "GAPPY": gappy}))
    kept = {r.symbol for r in clean.drop_sparse_symbols(table).select("symbol").distinct().collect()}
    assert kept == {"DENSE", "GAPPY"}


def test_master_calendar_and_missing_symbol(frame):
    d = days(5)
    rows = [("A", x, 1.0) for x in d[:4]] + [("B", d[1], 2.0), ("B", d[4], 3.0), ("C", d[4], 9.0)]
    out = align.align_to_master_calendar(frame("symbol string, date date, close double", rows))
    assert values(out, "A") == [1.0] * 4
    assert values(out, "B") == [None, 2.0, None, None]
    assert values(out, "C") == [None] * 4  # no date of its own in the calendar
    outer = align.align_outer(frame("symbol string, date date, close double", rows))
    assert values(outer, "B") == [None, 2.0, None, None, 3.0]


def test_intersection(frame):
    d = days(3)
    rows = [("A", x, 1.0) for x in d] + [("B", d[1], 2.0)]
    out = align.align_intersection(frame("symbol string, date date, close double", rows))
    assert {str(r.date) for r in out.collect()} == {d[1]}


def test_asof_takes_the_row_even_when_null(frame):
    d = days(6)
    prices = frame("symbol string, date date, close double", [("A", d[1], 5.0), ("A", d[3], None)])
    targets = frame("symbol string, date date", [("A", x) for x in d])
    assert values(align.asof_prices(targets, prices), "A") == [0.0, 5.0, 5.0, 0.0, 0.0, 0.0]


def test_constant_and_empty_columns(frame):
    df = frame("symbol string, a double, b double, c double", [("x", None, 1.0, 1.0), ("y", None, 1.0, None), ("z", None, None, 2.0)])
    assert clean.drop_null_and_constant_columns(df, ["a", "b", "c"]).columns == ["symbol", "c"]


def test_listing_and_pool(frame):
    d = days(4)
    rows = [("000001", x, "Norm", 1.0) for x in d] + [("000002", x, "*ST", 1.0) for x in d] + [("000003", x, "ST", 1.0) for x in d]
    rows += [("000004", x, "Norm", -1.0) for x in d] + [("000005", x, "Norm", 1.0) for x in d]
    df = frame("symbol string, date date, status string, book_value double", rows)
    listing = frame("symbol string, listing_date date", [("000001", d[0])])
    assert len(values(clean.post_listing_filter(df, listing), "000001", "status")) == 3  # strict
    assert values(clean.post_listing_filter(df, listing), "000003", "status") == []
    members = frame("symbol string", [("000001",), ("000002",), ("000004",)])
    pool = clean.stock_pool_filter(df, listing, members, min_rows=3)
    assert {r.symbol for r in pool.collect()} == {"000001"}


def test_clip_and_scale(frame):
    df = frame("symbol string, date date, x double, flat double",
               [("A", d, v, 2.0) for d, v in zip(days(5), [1.0, 2.0, 3.0, 4.0, 100.0])])
    assert values(clean.mad_clip(df, ["x"]), "A", "x") == [1.0, 2.0, 3.0, 4.0, 6.0]
    assert values(clean.zscore_symbol(df, ["flat"]), "A", "flat") == [0.0] * 5


def test_symbol_suffix(frame):
    codes = ["1", "300750", "600519", "830799", "430047", "900901", "1234567"]
    df = frame("code string", [(c,) for c in codes])
    got = [r[0] for r in df.select(format_symbol("code")).collect()]
    assert got == ["000001.SZ", "300750.SZ", "600519.SH", "830799.BJ", "430047.BJ", "900901", "1234567"]


def test_guards(frame):
    d = days(3)
    good = frame("symbol string, date date, x double", [("A", x, 1.0) for x in d])
    assert align.panel_guards(good, "x").first().n_dates == 3
    for rows in ([("A", d[0], None)], [("A", d[0], 1.0)] * 2, [("A", d[0], 1.0), ("B", d[0], 1.0)]):
        with pytest.raises(PySparkException):
            align.panel_guards(frame("symbol string, date date, x double", rows), "x").collect()


def test_guards_of_a_wide_universe(frame):
    d = days(3)
    schema = "symbol string, date date, x double"
    row = align.panel_guards(frame(schema, [(s, d[0], 1.0) for s in "ABC"]), "x", wide=True).first()
    assert (row.n_dates, row.n_symbols, row.n_rows) == (1, 3, 3)
    for rows in ([(x, d[0], 1.0) for x in d], [("A", d[0], None), ("B", d[0], 1.0)], [("A", d[0], 1.0)] * 2):
        with pytest.raises(PySparkException):
            align.panel_guards(frame(schema, rows), "x", wide=True).collect()


def test_scoring_calendar(frame):
    labels = frame("symbol string, date date", [("A", x) for x in days(20, "2024-01-01")])
    fits = align.scoring_calendar(labels, 5, 0, "2024-03-04", "2024-03-10")
    assert [str(r.date) for r in fits.orderBy("date").collect()] == days(5, "2024-03-04")
    tail = align.scoring_calendar(labels, 4, 10, "2024-03-04", "2024-03-10")
    assert [str(r.date) for r in tail.orderBy("date").collect()] == days(20, "2024-01-01")[-4:]
    with pytest.raises(PySparkException):
        align.scoring_calendar(labels, 11, 10, "2024-03-04", "2024-03-05").collect()
