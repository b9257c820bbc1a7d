import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import logits as L
from barloom.operators import evaluate, nav, portfolio, reports
from tests.conftest import days


def matrix(spark, pred, label):
    rows = [(f"S{j}", d, float(pred[i][j]), float(label[i][j])) for i, d in enumerate(days(len(pred))) for j in range(len(pred[0]))]
    return spark.createDataFrame(rows, "symbol string, date string, pred double, label double")


def test_perfect_scores_and_constant_day(spark):
    x = np.random.default_rng(0).normal(size=(5, 20))
    by_day = evaluate.ic_by_day(matrix(spark, x, x)).collect()
    assert all(abs(r.IC - 1) < 1e-12 and abs(r.IC_pearson - 1) < 1e-12 for r in by_day)
    flat = x.copy()
    flat[2] = 0.1
    days_ = evaluate.ic_spearman_by_day(matrix(spark, flat, x))
    s = evaluate.ic_summary(days_).first()
    assert s.n_undefined == 1 and s.n_days == 4
    errors = evaluate.mae_rmse(matrix(spark, x, x)).first()
    assert errors.MAE == errors.RMSE == 0


def test_classification(spark):
    df = spark.createDataFrame([(i % 2, i % 2) for i in range(6)], "pred_class int, label_class int")
    assert evaluate.f1_macro(df).first()[0] == 1.0 and evaluate.accuracy(df).first()[0] == 1.0
    one = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "pred_class int, label_class int")
    assert evaluate.f1_macro(one).first()[0] == pytest.approx((0 + 0.5 + 0) / 3)


def test_masked_steps(spark):
    df = spark.createDataFrame([(0, 0.1, 0.2, 1, 1), (0, 0.3, -0.1, 0, 1), (0, 5.0, 0.0, 0, 0), (1, 9.0, 0.0, 0, 1)],
                               "step int, pred double, label double, pred_class int, label_class int")
    rows = {r.step: r for r in evaluate.masked_step_metrics(df).collect()}
    assert rows[0].mae == pytest.approx(0.25) and rows[0].mape == pytest.approx((0.1 / 0.2 - 0.4 / 0.1) / 2)
    assert rows[0].acc == pytest.approx(2 / 3) and (rows[1].mae, rows[1].rmse, rows[1].mape) == (0, 0, 0)


def test_logit_cells(spark):
    df = spark.createDataFrame([("[ 0.16 -0.08]",), ("[1. 2.]",), ("[1.e-05 0.2]",), ("",)], "cell string")
    got = [r[0] for r in df.select(L.parse_logits("cell")).collect()]
    assert got == [[0.16, -0.08], [1.0, 2.0], [1.0, -5.0, 0.2], []]
    assert [r[0] for r in df.select(L.argmax_class(L.parse_logits("cell"))).collect()] == [0, 1, 0, 0]


def test_one_day_cost(spark):
    w = spark.createDataFrame([(s, "2020-01-01", 1 / 3) for s in "ABC"], "symbol string, date string, weight double")
    r = spark.createDataFrame([(s, "2020-01-01", 0.01) for s in "ABC"], "symbol string, date string, ret double")
    assert portfolio.daily_net_return(w, r, w).first().portfolio_return == pytest.approx(0.009)


def test_metrics(spark):
    rng = np.random.default_rng(42)
    p, b = rng.normal(0.001, 0.01, 252), rng.normal(0.0005, 0.008, 252)
    df = spark.createDataFrame([(d, float(x), float(y)) for d, x, y in zip(days(252), p, b)],
                               "date string, portfolio_return double, benchmark_return double")
    m = nav.performance_metrics(df).first()
    cum = np.cumprod(1 + p)
    assert m.total_return == pytest.approx(cum[-1] - 1) and m.annualized_return == pytest.approx(cum[-1] - 1)
    assert m.sharpe_ratio == pytest.approx(p.mean() / p.std(ddof=1) * 252 ** 0.5)
    assert m.max_drawdown == pytest.approx((cum / np.maximum.accumulate(cum) - 1).min())
    shifted = df.withColumn("portfolio_return", F.col("benchmark_return") + 0.0002)
    ab = nav.alpha_beta(shifted).first()
    assert ab.beta == pytest.approx(1) and ab.alpha_annualized == pytest.approx(0.0504)
    curve = nav.equity_curve(df, shifted=True).orderBy("date").toPandas()
    assert curve.portfolio_return_curve[0] == 1.0 and curve.portfolio_return_curve[251] == pytest.approx(cum[-2])
    flat = nav.performance_metrics(df.withColumn("portfolio_return", F.lit(0.01))).first()
    assert flat.sharpe_ratio is None


def test_positions_and_reports(spark):
    x = np.random.default_rng(7).normal(size=(3, 5))
    df = matrix(spark, x, x).withColumnRenamed("pred", "score")
    pos = portfolio.positions(df, 2)
    rows = pos.collect()
    assert len(rows) == 6 and pos.columns == ["date", "ticker", "weight", "predicted_score"]
    assert [r.date for r in rows] == sorted(r.date for r in rows) and {r.weight for r in rows} == {0.5}
    assert reports.latest_holdings(pos).count() == 2
    seen = list(dict.fromkeys(r.ticker for r in rows))
    assert [r.ticker for r in reports.held_tickers(pos).orderBy("seat").collect()] == seen
    heat = reports.heatmap_scores(df, pos, 2).toPandas()
    assert set(heat.ticker) == set(seen[:2]) and heat.scale.iloc[0] == pytest.approx(heat.score.abs().max())
    short = reports.expand_pct(spark.createDataFrame([(0.1, 2.0)], "total_return double, sharpe_ratio double")).first()
    assert short.total_return == pytest.approx(10) and short.top_k is None


def test_zero_price_gives_zero_return(spark):
    df = spark.createDataFrame([("A", d, p) for d, p in zip(days(4), [0.0, 5.0, 0.0, 0.0])], "symbol string, date string, close double")
    assert [r.ret for r in portfolio.price_returns(df).orderBy("date").collect()] == [0.0, 0.0, -1.0, 0.0]


def loop_backtest(close, weights, fee):
    """Day loop over dense weights, the plain definition."""
    dates = list(close.index)
    value = pd.Series(1.0, index=dates)
    last = pd.Series(0.0, index=close.columns)
    costs = {}
    trades = list(weights)
    for i, day in enumerate(trades):
        w = weights[day].reindex(close.columns).fillna(0)
        at = dates.index(day)
        costs[day] = (w - last).abs().sum()
        base = value.iloc[at] * (1 - costs[day] * fee)
        end = dates.index(trades[i + 1]) if i + 1 < len(trades) else len(dates) - 1
        for t in range(at + 1, end + 1):
            value.iloc[t] = base * (1 + np.nansum(w * (close.iloc[t] / close.iloc[at] - 1)))
            last = (w * close.iloc[t] / close.iloc[at]).fillna(0)
    return value, costs


def test_period_backtest_against_day_loop(spark):
    rng = np.random.default_rng(11)
    dates = days(30)
    close = pd.DataFrame(100 * np.cumprod(1 + rng.normal(0, 0.02, (30, 6)), axis=0), index=dates, columns=list("ABCDEF"))
    weights = {dates[i]: pd.Series(0.5, index=list(rng.choice(list("ABCDEF"), 2, replace=False))) for i in (3, 9, 10, 22)}
    value, costs = loop_backtest(close, weights, 0.002)
    w = spark.createDataFrame([(0, d, s, float(x)) for d, v in weights.items() for s, x in v.items()],
                              "layer int, date string, symbol string, weight double")
    p = spark.createDataFrame([(s, d, float(close.loc[d, s])) for d in dates for s in close.columns],
                              "symbol string, date string, close double")
    curve, trades = nav.period_backtest(w, p)
    got = curve.orderBy("date").toPandas()
    assert list(got.date) == dates and np.abs(got.nav.to_numpy() - value.to_numpy()).max() < 1e-12
    for r in trades.collect():
        assert r.turnover == pytest.approx(costs[r.date])
