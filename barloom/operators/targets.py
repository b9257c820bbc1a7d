"""Labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.expr import nan_to_zero, ratio
from barloom.functions.frames import by_symbol
from barloom.operators.align import calendar_positions, reindex_symbols
from barloom.operators.sizing import join_per_date


def forward_return(bars: DataFrame, out: str = "fwd_ret", small_dates: bool = False) -> DataFrame:
    """Next-date change of close on the union calendar; the last date is dropped, missing changes are 0."""
    dates = bars.select("date").distinct()
    full = reindex_symbols(bars.select("symbol", "date", "close"), dates, small_dates)
    ahead = F.lead("close").over(by_symbol())
    moved = full.withColumns({out: nan_to_zero(ratio(ahead, "close") - 1),
                              "_last": F.lead("date").over(by_symbol()).isNull()})
    return moved.where(~F.col("_last")).select("symbol", "date", out)


def trend_indicator(df: DataFrame, column: str = "fwd_ret", out: str = "trend") -> DataFrame:
    return df.withColumn(out, (F.col(column) > 0).cast("int"))


def model_targets(labels: DataFrame, column: str = "fwd_ret") -> DataFrame:
    """float32 return and 0/1 trend; a missing return is an error."""
    bad = F.col(column).isNull() | F.isnan(column)
    checked = F.when(bad, F.raise_error(F.lit("missing target")).cast("float")).otherwise(F.col(column).cast("float"))
    return trend_indicator(labels, column).select("symbol", "date", checked.alias("target"), "trend")


def split_table(panel: DataFrame, train: float = 0.75, val: float = 0.125) -> DataFrame:
    """One row (train_end, val_end): first positions after the train and the validation part."""
    n = panel.agg(F.count_distinct("date").alias("n"))
    return n.select((F.col("n") * F.lit(train)).cast("int").alias("train_end"),
                    (F.col("n") * F.lit(train + val)).cast("int").alias("val_end"))


def _tagged(panel: DataFrame, first_val, first_test, small_dates: bool) -> DataFrame:
    pos = calendar_positions(panel)
    name = F.when(F.col("pos") < first_val, "train").when(F.col("pos") < first_test, "val").otherwise("test")
    return join_per_date(panel, pos.select("date", name.alias("split")), small_dates=small_dates)


def split_by_position(panel: DataFrame, train: float = 0.75, val: float = 0.125, small_dates: bool = False) -> DataFrame:
    """Tag rows train / val / test by date position, ends truncated to whole positions."""
    ends = split_table(panel, train, val)
    return _tagged(panel, ends.select("train_end").scalar(), ends.select("val_end").scalar(), small_dates)


def split_by_round(panel: DataFrame, train: float = 0.75, test: float = 0.125, small_dates: bool = False) -> DataFrame:
    """Tag rows by date position; train and test lengths round half to even, validation is what lies between."""
    n = panel.agg(F.count_distinct("date").alias("n"))
    first_val = n.select(F.bround(F.col("n") * train).cast("int")).scalar()
    first_test = n.select((F.col("n") - F.bround(F.col("n") * test)).cast("int")).scalar()
    return _tagged(panel, first_val, first_test, small_dates)
