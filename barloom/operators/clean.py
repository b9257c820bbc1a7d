"""Row and column filters, gap filling, outliers and per-symbol scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import frames
from barloom.functions.expr import inf_to_null, nan_to_zero, ratio, varies
from barloom.functions.strings import format_symbol, normalise_ticker

PRICE_FIELDS = ("open", "high", "low", "close", "volume")


def with_columns_by(df: DataFrame, columns: Sequence[str], make) -> DataFrame:
    return df.withColumns({c: make(c) for c in columns})


def rename_select(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def with_formatted_symbol(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.withColumn(column, format_symbol(column))


def with_normalised_ticker(df: DataFrame, column: str = "ticker") -> DataFrame:
    return df.withColumn(column, normalise_ticker(column))


def zero_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_columns_by(df, columns, nan_to_zero)


def null_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_columns_by(df, columns, inf_to_null)


def post_listing_filter(df: DataFrame, listings: DataFrame, status: str = "status") -> DataFrame:
    """Rows after the listing date; symbols without one keep rows whose status is Norm or *ST."""
    joined = df.join(listings.select("symbol", "listing_date"), "symbol", "left")
    keep = (F.when(F.col("listing_date").isNotNull(), F.col("date") > F.col("listing_date"))
            .otherwise(F.col(status).isin("Norm", "*ST")))
    return joined.where(keep).select(*df.columns)


def constituent_semi_join(df: DataFrame, constituents: DataFrame) -> DataFrame:
    """Symbols whose first six characters are listed."""
    prefix = F.substring(F.col("symbol").cast("string"), 1, 6)
    listed = constituents.select(F.col("symbol").cast("string").alias("_member")).distinct()
    return df.withColumn("_member", prefix).join(listed, "_member", "left_semi").select(*df.columns)


def stock_pool_filter(df: DataFrame, listings: DataFrame, constituents: DataFrame, min_rows: int = 365,
                      status: str = "status", book_value: str = "book_value") -> DataFrame:
    """Listed rows of symbols with enough history that never were ST, never had a negative book value, and belong
    to the index. The conditions are one partial aggregate per symbol."""
    listed = post_listing_filter(df, listings, status)
    good = (listed.groupBy("symbol")
            .agg(F.count("*").alias("_n"),
                 F.bool_or(F.coalesce(F.contains(F.col(status), F.lit("ST")), F.lit(False))).alias("_st"),
                 F.bool_or(F.coalesce(F.col(book_value) < 0, F.lit(False))).alias("_negative"))
            .where((F.col("_n") >= min_rows) & ~F.col("_st") & ~F.col("_negative")))
    return listed.join(constituent_semi_join(good.select("symbol"), constituents), "symbol", "left_semi")


def drop_null_and_constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns that are all NULL or hold exactly one distinct value.

    min = max finds both in one mergeable aggregate over the table; only the two-value answer reaches the driver,
    because a column list is part of the plan.
    """
    tests = [(F.count(c) == 0) | (F.min(c) == F.max(c)) for c in columns]
    flags = df.agg(*[t.alias(c) for t, c in zip(tests, columns)]).first()
    return df.drop(*[c for c in columns if flags[c]])


def label_mask_fill(df: DataFrame, label: str = "label", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Suspended rows (label 0) are never picked: prediction -1e9, probability 0."""
    return df.withColumns({pred: F.when(F.col(label) == 0, F.lit(-1e9)).otherwise(F.col(pred)),
                           prob: F.when(F.col(label) == 0, F.lit(0.0)).otherwise(F.col(prob))})


def ffill_limit(df: DataFrame, columns: Sequence[str] = PRICE_FIELDS, n: int = 5) -> DataFrame:
    """Forward fill over at most n calendar rows; apply after alignment."""
    return with_columns_by(df, columns, lambda c: F.last(F.col(c), ignorenulls=True).over(frames.trailing(n + 1)))


def drop_sparse_symbols(df: DataFrame, columns: Sequence[str] = PRICE_FIELDS, limit: float = 0.05) -> DataFrame:
    """Drop symbols whose share of rows with any missing field is above the limit."""
    missing: Column = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    kept = (df.groupBy("symbol").agg(F.avg(missing.cast("int")).alias("_share"))
            .where(F.col("_share") <= limit).select("symbol"))
    return df.join(kept, "symbol", "left_semi")


def ffill(df: DataFrame, columns: Sequence[str] = PRICE_FIELDS) -> DataFrame:
    return with_columns_by(df, columns, frames.forward_fill)


def ffill_bfill(df: DataFrame, columns: Sequence[str] = PRICE_FIELDS) -> DataFrame:
    """After the forward fill only rows before the first known value are open, so the backward fill is that value."""
    return with_columns_by(df, columns, lambda c: F.coalesce(frames.forward_fill(c), frames.first_known(c)))


def mad_clip(df: DataFrame, columns: Sequence[str], n: float = 3.0) -> DataFrame:
    """Clip each column to median +- n * median absolute deviation, per symbol.

    A symbol has one row per date, so the exact percentile of a symbol is bounded by the calendar length.
    """
    medians = df.groupBy("symbol").agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    centred = df.join(medians, "symbol")
    spreads = centred.groupBy("symbol").agg(
        *[F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), F.lit(0.5)).alias(f"_d_{c}") for c in columns])
    joined = centred.join(spreads, "symbol")

    def clipped(c: str) -> Column:
        low = F.col(f"_m_{c}") - n * F.col(f"_d_{c}")
        high = F.col(f"_m_{c}") + n * F.col(f"_d_{c}")
        return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), high), low))

    return with_columns_by(joined, columns, clipped).select(*df.columns)


def zscore_symbol(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per symbol, population deviation, zero deviation scales by 1."""
    stats = df.groupBy("symbol").agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                     *[F.when(varies(c), F.stddev_pop(c)).alias(f"_s_{c}") for c in columns])

    def scaled(c: str) -> Column:
        return (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.col(f"_s_{c}"), F.lit(1.0))

    return with_columns_by(df.join(stats, "symbol"), columns, scaled).select(*df.columns)


def standard_process(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clip, forward fill and scale, per symbol."""
    return zscore_symbol(ffill(mad_clip(df, columns), columns), columns)


def mask_missing_price(df: DataFrame, factor: str = "factor", cap: str = "cap", close: str = "close") -> DataFrame:
    return df.withColumn(factor, F.when(F.col(cap).isNotNull() & F.col(close).isNotNull(), F.col(factor)))


def simple_return(df: DataFrame, column: str = "close", out: str = "ret") -> DataFrame:
    """Change against the previous row of the symbol."""
    before = frames.lagged(column)
    return df.withColumn(out, ratio(F.col(column) - before, before))
