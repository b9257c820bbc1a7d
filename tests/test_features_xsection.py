import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features, ranking, xsection
from barloom.operators.ewm import Ewm, ewm
from tests.conftest import days


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(42)
    parts = []
    for s in ("AAPL", "MSFT", "GOOG"):
        close = 100 * np.cumprod(1 + rng.normal(0, 0.01, 300))
        parts.append(pd.DataFrame({"symbol": s, "date": pd.to_datetime(days(300)).date, "open": close * 0.99,
                                   "high": close * 1.02, "low": close * 0.97, "close": close,
                                   "volume": rng.integers(1, 1000, 300).astype(float)}))
    return pd.concat(parts, ignore_index=True)


def test_all_features(spark, walk):
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 69
    out = features.compute_features(spark.createDataFrame(walk)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    ref = walk.sort_values(["symbol", "date"]).reset_index(drop=True)
    g = ref.groupby("symbol")
    close = g["close"]
    want = {
        "SMA_20": close.transform(lambda c: c.rolling(20).mean()),
        "BB_upper_60": close.transform(lambda c: c.rolling(60).mean() + 2 * c.rolling(60).std()),
        "EMA_50": close.transform(lambda c: c.ewm(span=50, adjust=False).mean()),
        "ROC_14": close.transform(lambda c: c.pct_change(14) * 100),
        "VOL_norm_252": g["volume"].transform(lambda v: v / v.rolling(252).mean()),
        "MACD": close.transform(lambda c: c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean())}
    tp = (ref.high + ref.low + ref.close) / 3
    want["CCI_14"] = tp.groupby(ref.symbol).transform(lambda x: (x - x.rolling(14).mean()) / (
        0.015 * x.rolling(14).apply(lambda w: np.mean(np.abs(w - w.mean())), raw=True)))

    def rsi(c):
        d = c.diff()
        up, down = (s.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for s in (d, -d))
        return 100 - 100 / (1 + up / down.where(down >= 1e-8, 1e-8))

    want["RSI_14"] = close.transform(rsi)
    for name, series in want.items():
        assert (out[name].isna() == series.isna()).all(), name
        assert np.nanmax(np.abs(out[name] - series)) < 1e-8, name


def test_ewm_with_gaps_matches_pandas(spark):
    rng = np.random.default_rng(1)
    parts = []
    for s in range(3):
        x = pd.Series(500 + np.cumsum(rng.normal(size=400)))
        x[rng.random(400) < 0.2] = np.nan
        if s == 1:
            x[:40] = np.nan
        if s == 2:
            x[3:] = np.nan
        parts.append(pd.DataFrame({"symbol": s, "date": pd.to_datetime(days(400)).date, "x": x}))
    table = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(table).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    alphas = (1 / 3, 2 / 27, 1 / 60)
    out = ewm(df, *[Ewm(f"e{i}", "x", a, 3) for i, a in enumerate(alphas)]).toPandas().sort_values(["symbol", "date"])
    for i, a in enumerate(alphas):
        ref = table.groupby("symbol").x.transform(lambda v: v.ewm(alpha=a, adjust=False, min_periods=3).mean())
        got = out[f"e{i}"].to_numpy()
        assert (np.isnan(got) == ref.isna()).all() and np.nanmax(np.abs(got - ref)) < 1e-9


def test_features_fold_once_and_walk_short_frames_only(spark, walk):
    """Long extremes and deviations come from short frames, the MACD signal from the fold of the other means; values as pandas gives them."""
    holes = walk.copy()
    holes.loc[np.random.default_rng(3).random(len(holes)) < 0.02, ["high", "low", "close"]] = np.nan
    df = spark.createDataFrame(holes)
    df = df.select("symbol", "date", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    made = features.compute_features(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    assert "RowFrame, -59, currentrow" not in plan and "RowFrame, -4, currentrow" in plan
    out = made.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    g = holes.sort_values(["symbol", "date"]).reset_index(drop=True).groupby("symbol")
    want = {"DC_upper_60": g["high"].transform(lambda x: x.rolling(60).max()), "DC_lower_20": g["low"].transform(lambda x: x.rolling(20).min())}
    for w in features.BB_WINDOWS:
        want[f"BB_width_{w}"] = g["close"].transform(lambda x, w=w: 4 * x.rolling(w).std())
    want["MACD_signal"] = g["close"].transform(lambda c: (c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean())
                                               .ewm(span=9, adjust=False).mean())
    for name, series in want.items():
        assert (out[name].isna() == series.isna()).all(), name
        assert np.nanmax(np.abs(out[name] - series)) < 1e-8, name
    odd = features.bollinger(df, (3, 7)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)  # 7 is no multiple of 3
    assert np.nanmax(np.abs(odd["BB_width_7"] - g["close"].transform(lambda x: 4 * x.rolling(7).std()))) < 1e-8


def test_zscore_mean_sd_and_slicing(spark):
    rng = np.random.default_rng(0)
    rows = [(f"S{j}", d, float(rng.normal())) for d in days(20) for j in range(10)] + [("S0", days(21)[-1], 4.0)]
    df = spark.createDataFrame(rows, "symbol string, date string, x double").withColumn("date", F.to_date("date"))
    z = xsection.cs_zscore(df, ["x"])
    for r in z.groupBy("date").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("*").alias("n")).collect():
        assert abs(r.m) < 1e-12 and (r.n == 1 or abs(r.s - 1) < 1e-12)
    cut = F.col("date") < "2020-01-10"
    a = xsection.cs_zscore(df.where(cut), ["x"]).orderBy("date", "symbol").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in z.where(cut).orderBy("date", "symbol").collect()]


def test_ranks_medians_and_hot_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=300), [0.0] * 150, 1000 + rng.random(50), [-1e9, 1e9]])
    table = pd.DataFrame({"symbol": np.arange(len(x)), "x": x, "date": pd.to_datetime("2020-01-01").date()})
    df = spark.createDataFrame(table)
    got = ranking.average_rank(df, "x", "r").toPandas().sort_values("symbol")
    assert (got.r.to_numpy() == table.x.rank().to_numpy()).all()
    assert ranking.exact_median(df, "x", "m").first().m == table.x.median()
    for cell in (1 << 20, 16):  # the second forces the split of equal values
        monkeypatch.setattr(ranking, "TIE_CELL", cell)
        rn = ranking.descending_row_number(df, "x", "rn", "n").toPandas().sort_values("rn")
        want = table.sort_values(["x", "symbol"], ascending=[False, True]).symbol.to_numpy()
        assert (rn.symbol.to_numpy() == want).all() and (rn.rn.to_numpy() == np.arange(1, len(x) + 1)).all()


def test_top_k(spark):
    scores = [0.1, 0.2, 0.5, 0.0, -0.1, 0.9, 0.3, 0.0, 0.7, -0.5]
    df = spark.createDataFrame([(f"T{i:02d}", "2020-01-01", s) for i, s in enumerate(scores)] + [("T99", "2020-01-01", None)],
                               "symbol string, date string, score double")
    assert {r.symbol for r in xsection.top_k(df, 3).collect()} == {"T05", "T08", "T02"}
    ties = spark.createDataFrame([(s, "2020-01-01", 1.0) for s in "CAB"], "symbol string, date string, score double")
    assert {r.symbol for r in xsection.top_k(ties, 2).collect()} == {"A", "B"}


def test_layers_leave_the_remainder(spark):
    df = spark.createDataFrame([(i, "2020-01-01", float(i)) for i in range(13)], "symbol int, date string, factor double")
    out = xsection.factor_layers(df, layers=5).toPandas()
    assert len(out) == 10 and set(out.weight) == {0.5} and set(out[out.layer == 0].symbol) == {12, 11}


def test_neutralised_factor_is_orthogonal(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "2020-01-01", float(rng.normal()), float(20 + rng.normal()), int(i % 4) if i else 9) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol int, date string, f double, log_cap double, industry int")
    out = xsection.neutralise_cap_industry(df, ["f"], standardise=False).toPandas().sort_values("symbol")
    x = np.column_stack([out.log_cap] + [(out.industry == k).astype(float) for k in sorted(out.industry.unique())])
    y = np.array([r[2] for r in rows])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(out.f.to_numpy() - want).max() < 1e-10 and abs(out.f.iloc[0]) < 1e-12


def test_cap_is_one_sided_by_default(spark):
    rows = [(i, "2020-01-01", float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10] * 4 + [500, -500])]
    df = spark.createDataFrame(rows, "symbol int, date string, factor double")
    one, two = (xsection.cap_outliers_xs(df, two_sided=t).toPandas().factor for t in (False, True))
    assert one.max() < 500 and one.min() == -500 and two.min() > -500
