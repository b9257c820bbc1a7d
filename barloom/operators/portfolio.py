"""Daily top-K portfolios: weights, returns, turnover and net return without a day loop.

A portfolio is kept sparse: only held symbols have rows. The previous day's weights are the same rows moved one
calendar position ahead, so turnover is one aggregate over the stacked old and new holdings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.expr import nan_to_zero, ratio
from barloom.functions.frames import by_symbol
from barloom.operators.align import asof_prices, calendar_positions
from barloom.operators.sizing import join_per_date
from barloom.operators.xsection import top_k


def equal_weights(scores: DataFrame, k: int, score: str = "score", position: str = "symbol") -> DataFrame:
    """(date, symbol, weight, score) of the k best scores; the weight is 1/k even when fewer are picked."""
    return top_k(scores, k, score, position).select("date", "symbol", F.lit(1.0 / k).alias("weight"), score)


def dense_weights(scores: DataFrame, k: int, score: str = "score", position: str = "symbol") -> DataFrame:
    """equal_weights over the whole universe of score rows, 0 for symbols not picked."""
    picked = equal_weights(scores, k, score, position).select("date", "symbol", "weight")
    return (scores.select("date", "symbol").join(picked, ["date", "symbol"], "left")
            .select("date", "symbol", F.coalesce("weight", F.lit(0.0)).alias("weight")))


def price_returns(prices: DataFrame, column: str = "close", out: str = "ret") -> DataFrame:
    """Change against the previous row; 0 on the first row and after a zero price."""
    before = F.lag(column).over(by_symbol())
    return prices.select("symbol", "date", F.coalesce(
        F.when(before != 0, (F.col(column) - before) / before), F.lit(0.0)).alias(out))


def turnover(weights: DataFrame, calendar: DataFrame, small_dates: bool = False) -> DataFrame:
    """(date, turnover): sum of absolute weight changes against the previous calendar date; cash before the first."""
    pos = calendar_positions(calendar)
    final = pos.agg(F.max("pos")).scalar()
    now = join_per_date(weights.select("date", "symbol", "weight"), pos, small_dates=small_dates)
    moves = now.select("symbol", F.inline(F.array(
        F.struct(F.col("pos"), F.col("weight").alias("change")),
        F.struct((F.col("pos") + 1).alias("pos"), (-F.col("weight")).alias("change")))))
    by_cell = moves.where(F.col("pos") <= final).groupBy("pos", "symbol").agg(F.sum("change").alias("change"))
    by_pos = by_cell.groupBy("pos").agg(F.sum(F.abs("change")).alias("turnover"))
    return pos.join(by_pos, "pos", "left").select("date", nan_to_zero("turnover").alias("turnover"))


def daily_net_return(weights: DataFrame, returns: DataFrame, calendar: DataFrame, fee: float = 0.001,
                     small_dates: bool = False) -> DataFrame:
    """(date, gross, turnover, portfolio_return): the score of a date earns the return of that date, less the cost
    of the weight changes. Symbols without a return earn 0."""
    earned = (weights.select("date", "symbol", "weight")
              .join(returns.select("date", "symbol", "ret"), ["date", "symbol"], "left")
              .groupBy("date").agg(F.sum(F.col("weight") * nan_to_zero("ret")).alias("gross")))
    costs = turnover(weights, calendar, small_dates)
    joined = costs.join(earned, "date", "left").withColumn("gross", nan_to_zero("gross"))
    return joined.select("date", "gross", "turnover", (F.col("gross") - fee * F.col("turnover")).alias("portfolio_return"))


def positions(scores: DataFrame, k: int, score: str = "score", position: str = "symbol") -> DataFrame:
    """(date, ticker, weight, predicted_score). In no order; a writer that wants one sorts (``write_results``)."""
    return equal_weights(scores, k, score, position).select(
        "date", F.col("symbol").alias("ticker"), "weight", F.col(score).alias("predicted_score"))


def backtest_daily(scores: DataFrame, prices: DataFrame, benchmark: DataFrame, k: int = 10, fee: float = 0.001,
                   score: str = "score", small_dates: bool = False) -> DataFrame:
    """(date, portfolio_return, benchmark_return) over the score dates.

    Prices are taken as of each score date; ``benchmark`` holds (date, close) of the index, taken the same way.
    """
    days = scores.select("date").distinct()
    universe = scores.select("symbol", "date")
    returns = price_returns(asof_prices(universe, prices))
    net = daily_net_return(equal_weights(scores, k, score), returns, days, fee, small_dates)
    index = asof_prices(days.select(F.lit("index").alias("symbol"), "date"),
                        benchmark.select(F.lit("index").alias("symbol"), "date", "close"))
    index_returns = price_returns(index).select("date", F.col("ret").alias("benchmark_return"))
    return net.join(index_returns, "date").select("date", "portfolio_return", "benchmark_return")


def benchmark_returns(prices: DataFrame) -> DataFrame:
    """Equal-weighted mean return per date, for panels that come without an index series."""
    before = F.lag("close").over(by_symbol())
    moved = prices.select("date", (ratio("close", before) - 1).alias("ret"))
    return moved.groupBy("date").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("benchmark_return"))
