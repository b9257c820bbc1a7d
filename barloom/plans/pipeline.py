"""End-to-end plans: bars to model table, scores to report tables.

Each step is lazy. A caller who needs a result twice writes it as Parquet and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators import align, clean, features, nav, portfolio, targets, windows, xsection
from barloom.operators.sizing import join_per_date


def clean_bars(bars: DataFrame, fill: int = 5, sparse: float = 0.05, small_dates: bool = False) -> DataFrame:
    """Master calendar, limited forward fill, sparse symbols dropped."""
    full = align.align_to_master_calendar(bars, small_dates)
    return clean.drop_sparse_symbols(clean.ffill_limit(full, n=fill), limit=sparse)


LABELS = ("fwd_ret", "trend", "split")


def _labelled(bars: DataFrame, tagged: DataFrame, *more: str) -> DataFrame:
    """Bars with the labels of their row, NULL where there is none; every bar stays, since later features look back on it."""
    return bars.join(tagged.select("symbol", "date", *LABELS, *more), ["symbol", "date"], "left")


def _position_labels(bars: DataFrame, small_dates: bool) -> DataFrame:
    return targets.split_by_position(targets.trend_indicator(targets.forward_return(bars, small_dates=small_dates)), small_dates=small_dates)


def labelled_matrix(bars: DataFrame, small_dates: bool = False) -> DataFrame:
    """``features.build_feature_matrix`` of cleaned bars with the return, trend and split of each row (NULL without a label)."""
    return features.build_feature_matrix(_labelled(bars, _position_labels(bars, small_dates)), small_dates=small_dates, keep=LABELS)


def model_table(bars: DataFrame, matrix: DataFrame | None = None, small_dates: bool = False) -> DataFrame:
    """(symbol, date, fwd_ret, trend, split, features): z-scored features with return and trend, tagged train / val / test.

    The split counts the dates of the labels, as the pipeline stores it; the first dates have labels but, for the warm-up, no features.
    ``bars`` are cleaned bars (``clean_bars``), from which both features and labels are made. The z-score reads the feature matrix twice; a
    caller may pass a stored one (``labelled_matrix`` of the same bars). Labels join the bars there, so no row of 69 features travels to be
    joined; a matrix without labels is joined to them here.
    """
    table = labelled_matrix(bars, small_dates) if matrix is None else matrix
    table = table if "split" in table.columns else _labelled(table, _position_labels(bars, small_dates))
    scaled = xsection.cs_zscore(table, features.FEATURES, small_dates).where(F.col("split").isNotNull())
    return windows.stack_features(scaled, features.FEATURES, keep=LABELS)


def model_input(bars: DataFrame, past: int = 20, ahead: int = 2, small_dates: bool = False) -> DataFrame:
    """Samples of the model (``windows.model_samples``) over the returns, indicator, stacked features and calendar codes of all label dates.

    Split lengths are rounded half to even here, as the loader cuts them. What a row needs besides its features joins the narrow bars; the
    features are made where their symbol's bars lie and packed there, so no row of 71 values travels.
    """
    labels = targets.trend_indicator(targets.forward_return(bars, small_dates=small_dates))
    tagged = targets.split_by_round(labels, small_dates=small_dates)
    codes = windows.temporal_codes(labels).select("date", "month_code", "day_code")
    coded = join_per_date(tagged, codes, small_dates=small_dates)
    made = features.compute_features(_labelled(bars, coded, "month_code", "day_code")).where(F.col("split").isNotNull())
    table = windows.stack_features(made, features.FEATURES, keep=[*LABELS, "month_code", "day_code"])
    return windows.model_samples(table, past, ahead, placed=True)


def score_report(scores: DataFrame, prices: DataFrame, benchmark: DataFrame, k: int = 10, fee: float = 0.001,
                 small_dates: bool = False) -> dict[str, DataFrame]:
    """Daily returns, positions and the one-row summary of a top-k portfolio."""
    daily = portfolio.backtest_daily(scores, prices, benchmark, k, fee, small_dates=small_dates)
    return {"daily_returns": daily, "positions": portfolio.positions(scores, k),
            "summary": nav.performance_metrics(daily)}
