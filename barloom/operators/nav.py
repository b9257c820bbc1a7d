"""Net asset value series and performance statistics.

A strategy has one row per date here, so windows partition by strategy and many strategies run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.expr import deviation, guarded_intercept, guarded_slope, nan_to_zero, ratio
from barloom.operators.align import calendar_positions
from barloom.operators.sizing import join_per_date
from barloom.operators.xsection import top_k
from barloom.session import cut_lineage

YEAR = 252


def _runs(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date")


def _compound(x: Column, keys: Sequence[str]) -> Column:
    return F.product(1 + x).over(_runs(keys).rowsBetween(Window.unboundedPreceding, 0))


def _spread_ratio(mean: Column, sd: Column) -> Column:
    return ratio(mean, sd) * F.sqrt(F.lit(float(YEAR)))


def alpha_beta(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Regression of portfolio on benchmark returns: beta and alpha times 252."""
    return daily.groupBy(*keys).agg(
        guarded_slope("portfolio_return", "benchmark_return").alias("beta"),
        (guarded_intercept("portfolio_return", "benchmark_return") * YEAR).alias("alpha_annualized"))


def performance_metrics(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per strategy: total and annualised return, Sharpe ratio, maximum drawdown, alpha, beta, day count.

    Drawdown is measured against the running maximum of the curve, the starting value 1 not included.
    """
    r = F.col("portfolio_return")
    curve = daily.withColumn("_cum", _compound(r, keys))
    peak = F.max("_cum").over(_runs(keys).rowsBetween(Window.unboundedPreceding, 0))
    falls = curve.withColumn("_fall", F.col("_cum") / peak - 1)
    n = F.count(r)
    stats = falls.groupBy(*keys).agg(
        (F.product(1 + r) - 1).alias("total_return"), n.alias("n_days"),
        _spread_ratio(F.avg(r), deviation(r)).alias("sharpe_ratio"), F.min("_fall").alias("max_drawdown"),
        guarded_slope("portfolio_return", "benchmark_return").alias("beta"),
        (guarded_intercept("portfolio_return", "benchmark_return") * YEAR).alias("alpha_annualized"))
    yearly = F.pow(1 + F.col("total_return"), YEAR / F.col("n_days")) - 1
    return stats.select(*keys, yearly.alias("annualized_return"), "sharpe_ratio", "max_drawdown", "alpha_annualized",
                        "beta", "total_return", "n_days")


def equity_curve(daily: DataFrame, columns: Sequence[str] = ("portfolio_return", "benchmark_return"),
                 shifted: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Running compounded value per return column; ``shifted`` starts at 1.0 and leaves out the last return."""
    out = daily.withColumns({f"{c}_curve": _compound(F.col(c), keys) for c in columns})
    if shifted:
        out = out.withColumns({f"{c}_curve": F.lag(f"{c}_curve", 1, 1.0).over(_runs(keys)) for c in columns})
    return out.select(*keys, "date", *[f"{c}_curve" for c in columns])


def rebalance_calendar(prices: DataFrame) -> DataFrame:
    """(date, eve): first trading date of each month but the first, and the trading date before it."""
    days = prices.select("date").distinct()
    order = Window.orderBy("date")
    marked = days.select("date", F.lag("date").over(order).alias("eve"))
    first = F.col("eve").isNotNull() & (F.trunc("date", "MM") != F.trunc("eve", "MM"))
    return marked.where(first)


def period_backtest(weights: DataFrame, prices: DataFrame, fee: float = 0.002, strategy: str = "layer",
                    small_dates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Backtest of target weights set on rebalance dates and left to drift in between.

    ``weights``: (strategy, date, symbol, weight), held symbols only. ``prices``: (symbol, date, close).
    Returns (nav, turnover): nav has (strategy, date, nav, period_return) for every price date, 1.0 up to the first
    rebalance; turnover has (strategy, date, turnover) per rebalance.

    The value at a rebalance is the running product of period factors (1 - fee * turnover) * (1 + period return),
    and both parts depend on weights and prices alone, so nothing is sequential. Holdings are expanded to the dates of
    their period by calendar position: all joins are equi-joins.
    """
    s = strategy
    weights = cut_lineage(weights.select(s, "date", "symbol", "weight"))  # read five times below
    pos = cut_lineage(calendar_positions(prices))
    final = pos.agg(F.max("pos")).scalar()
    rebalances = join_per_date(weights.select(s, "date").distinct(), pos, small_dates=small_dates)
    order = Window.partitionBy(s).orderBy("pos")
    periods = rebalances.select(
        s, F.col("pos").alias("start"), F.row_number().over(order).alias("k"),
        F.coalesce(F.lead("pos").over(order), final).alias("end"))

    start = join_per_date(weights.select(s, "date", "symbol", "weight").where(F.col("weight") != 0), pos,
                          small_dates=small_dates)
    quotes = join_per_date(prices.select("symbol", "date", "close"), pos, small_dates=small_dates).select(
        "symbol", "pos", "close")
    held = (start.select(s, "symbol", "weight", F.col("pos").alias("start"))
            .join(periods, [s, "start"])
            .join(quotes.select("symbol", F.col("pos").alias("start"), F.col("close").alias("paid")),
                  ["symbol", "start"], "left"))
    days = F.when(F.col("end") > F.col("start"), F.sequence(F.col("start") + 1, F.col("end")))
    moved = (held.withColumn("pos", F.explode(days))
             .join(quotes, ["symbol", "pos"], "left")
             .withColumn("grown", F.col("weight") * ratio("close", "paid")))
    earned = moved.groupBy(s, "k", "pos").agg(
        F.coalesce(F.sum(F.col("grown") - F.col("weight")), F.lit(0.0)).alias("period_return"))

    drifted = moved.where(F.col("pos") == F.col("end")).select(
        s, (F.col("k") + 1).alias("k"), "symbol", nan_to_zero("grown").alias("change"))
    traded = (held.select(s, "k", "symbol", (-F.col("weight")).alias("change")).unionByName(drifted)
              .groupBy(s, "k", "symbol").agg(F.sum("change").alias("change")))
    costs = traded.groupBy(s, "k").agg(F.sum(F.abs("change")).alias("turnover"))

    grid = periods.withColumn("pos", F.explode(F.when(
        F.col("end") > F.col("start"), F.sequence(F.col("start") + 1, F.col("end")))))
    values = (grid.join(earned, [s, "k", "pos"], "left").join(costs, [s, "k"], "left")
              .withColumns({"period_return": nan_to_zero("period_return"),
                            "_kept": 1 - fee * nan_to_zero("turnover")})
              .withColumn("_factor", F.when(F.col("pos") == F.col("end"),
                                            F.col("_kept") * (1 + F.col("period_return")))))
    path = Window.partitionBy(s).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.product(F.coalesce("_factor", F.lit(1.0))).over(path), F.lit(1.0))
    values = values.select(s, "pos", (grown * F.col("_kept") * (1 + F.col("period_return"))).alias("nav"),
                           "period_return")
    flat = periods.where(F.col("k") == 1).select(
        s, F.explode(F.sequence(F.lit(0), F.col("start"))).alias("pos"), F.lit(1.0).alias("nav"),
        F.lit(0.0).alias("period_return"))
    nav = join_per_date(values.unionByName(flat), pos, "pos", small_dates=small_dates).select(
        s, "date", "nav", "period_return")
    trades = join_per_date(
        periods.join(costs, [s, "k"]).select(s, F.col("start").alias("pos"), "turnover"), pos, "pos",
        small_dates=small_dates).select(s, "date", "turnover")
    return nav, trades


def topk_drift_backtest(scores: DataFrame, prices: DataFrame, k: int = 10, fee: float = 0.0, score: str = "score",
                        strategy: str = "strategy", small_dates: bool = False) -> DataFrame:
    """(strategy, date, nav, turnover, period_return) with every score date a rebalance of the k best at 1/k each.

    Scores without a strategy column form one strategy.
    """
    if strategy not in scores.columns:
        scores = scores.withColumn(strategy, F.lit("scores"))
    weights = top_k(scores, k, score, keys=(strategy, "date")).select(
        strategy, "date", "symbol", F.lit(1.0 / k).alias("weight"))
    nav, trades = period_backtest(weights, prices, fee, strategy, small_dates)
    return nav.join(trades, [strategy, "date"], "left").select(strategy, "date", "nav", "turnover", "period_return")


def nav_metrics(nav: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Total and annualised return, Sharpe ratio and maximum drawdown of a value series."""
    runs = _runs(keys)
    moved = nav.withColumns({
        "_ret": ratio("nav", F.lag("nav").over(runs)) - 1,
        "_fall": ratio("nav", F.max("nav").over(runs.rowsBetween(Window.unboundedPreceding, 0))) - 1})
    stats = moved.groupBy(*keys).agg(
        (ratio(F.max_by("nav", "date"), F.min_by("nav", "date")) - 1).alias("total_return"),
        F.count("nav").alias("n_days"), _spread_ratio(F.avg("_ret"), deviation("_ret")).alias("sharpe_ratio"),
        F.min("_fall").alias("max_drawdown"))
    yearly = F.pow(1 + F.col("total_return"), YEAR / F.col("n_days")) - 1
    return stats.select(*keys, "total_return", yearly.alias("annualized_return"), "sharpe_ratio", "max_drawdown", "n_days")


def best_model_by_sharpe(metrics: DataFrame, model: str = "strategy") -> DataFrame:
    """The model with the higher Sharpe ratio; of equal ones the last by name."""
    return metrics.orderBy(F.col("sharpe_ratio").desc_nulls_last(), F.desc(model)).limit(1)


def benchmark_nav(index: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(date, ret, nav) of an index close series, starting at 1."""
    moved = index.withColumn("ret", nan_to_zero(ratio("close", F.lag("close").over(_runs(keys))) - 1))
    return moved.select(*keys, "date", "ret", _compound(F.col("ret"), keys).alias("nav"))


def combine_nav(spine: DataFrame, nav: DataFrame, models: Sequence[str], strategy: str = "strategy") -> DataFrame:
    """One row per benchmark date: its nav and one nav column per model."""
    wide = nav.groupBy("date").pivot(strategy, list(models)).agg(F.first("nav"))
    return spine.select("date", F.col("nav").alias("benchmark")).join(wide, "date", "left")


def layer_backtest_panel(nav: DataFrame, trades: DataFrame, layers: int, strategy: str = "layer") -> DataFrame:
    """(date, nav_1.., turnover_1..): value and turnover of each layer side by side."""
    names = list(range(layers))
    wide_nav = nav.groupBy("date").pivot(strategy, names).agg(F.first("nav"))
    wide_trades = trades.groupBy("date").pivot(strategy, names).agg(F.first("turnover"))
    return (wide_nav.select("date", *[F.col(f"{i}").alias(f"nav_{i + 1}") for i in names])
            .join(wide_trades.select("date", *[F.col(f"{i}").alias(f"turnover_{i + 1}") for i in names]), "date", "left"))
