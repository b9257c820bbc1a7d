"""Result tables behind the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.operators.align import slice_dates
from barloom.operators.nav import equity_curve

# Columns of the summary report, and those shown as percent.
SUMMARY = ("annualized_return", "total_return", "max_drawdown", "alpha_annualized", "sharpe_ratio", "beta", "top_k",
           "n_days")
PERCENT = SUMMARY[:4]


def expand_pct(summary: DataFrame) -> DataFrame:
    """Summary columns in report order, ratios as percent, absent columns NULL."""
    def shown(c: str):
        if c not in summary.columns:
            return F.lit(None).cast("double").alias(c)
        return (F.col(c) * 100 if c in PERCENT else F.col(c)).alias(c)

    return summary.select(*[shown(c) for c in SUMMARY])


def latest_holdings(positions: DataFrame) -> DataFrame:
    """Positions of the last date, best score first, weight as percent."""
    last = positions.agg(F.max("date")).scalar()
    return (positions.where(F.col("date") == last)
            .select("ticker", (F.col("weight") * 100).alias("weight"), "predicted_score")
            .orderBy(F.desc("predicted_score"), "ticker"))


def held_tickers(positions: DataFrame) -> DataFrame:
    """(ticker, seat): distinct tickers numbered by first appearance in date asc, score desc order.

    The first appearance is a mergeable minimum, so positions collapse to one row per ticker. Tickers are numbered inside
    their first date; running counts of the dates, one row each, give the offset of a date.
    """
    first = positions.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(
        F.min(F.struct("date", (-F.col("predicted_score")).alias("neg"), "ticker")).alias("_seen")).withColumn("_day", F.col("_seen.date"))
    running = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    days = first.groupBy("_day").agg(F.count("*").alias("_n"))
    offsets = days.select("_day", (F.sum("_n").over(running) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("_seen"))
    return (first.withColumn("_in", inside).join(offsets, "_day")
            .select("ticker", (F.col("_before") + F.col("_in")).cast("int").alias("seat")))


def first_held(positions: DataFrame, k: int) -> DataFrame:
    """The first k held tickers, by a distributed top-k instead of a full numbering."""
    first = positions.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(
        F.min(F.struct("date", (-F.col("predicted_score")).alias("neg"), "ticker")).alias("_seen"))
    return first.orderBy("_seen").limit(k).select("ticker")


def heatmap_scores(scores: DataFrame, positions: DataFrame, k: int, score: str = "score") -> DataFrame:
    """(ticker, date, score, scale): scores of the first k held tickers; scale is the largest absolute score, 0 -> 1."""
    chosen = first_held(positions, k)
    cells = scores.select(F.col("symbol").alias("ticker"), "date", F.col(score).alias("score")).join(
        F.broadcast(chosen), "ticker", "left_semi")
    top = cells.agg(F.max(F.abs("score"))).scalar()
    return cells.withColumn("scale", F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise(top))


def kpi_row(summary: DataFrame) -> DataFrame:
    """The four headline figures, all but the Sharpe ratio as percent."""
    return expand_pct(summary).select("annualized_return", "sharpe_ratio", "max_drawdown", "alpha_annualized")


def equity_window(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Shifted equity curves over a date range; the curve restarts at 1.0."""
    return equity_curve(slice_dates(daily, start, end), shifted=True)
