"""Cross-section operators: one date at a time, over all symbols.

Statistics of a date are mergeable aggregates (partial on the map side) joined back by date, so a date with any
number of symbols never sits in one task. Order statistics use ``ranking``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.expr import deviation, inf_to_null, ratio
from barloom.operators.align import reindex_symbols
from barloom.operators.clean import mask_missing_price
from barloom.operators.ranking import average_rank, descending_row_number, exact_median
from barloom.operators.sizing import join_per_date

FLAT = 1e-8
# Fixed value: scales a mean absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def _scaled(df: DataFrame, columns: Sequence[str], scale, small_dates: bool) -> DataFrame:
    stats = df.groupBy("date").agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                   *[deviation(c).alias(f"_s_{c}") for c in columns])
    joined = join_per_date(df, stats, small_dates=small_dates)
    made = {c: scale(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(made).select(*df.columns)


def cs_zscore(df: DataFrame, columns: Sequence[str], small_dates: bool = False) -> DataFrame:
    """(x - mean) / sd per date; a flat or undefined sd scales by 1."""
    return _scaled(df, columns, lambda d, s: d / F.when(s >= FLAT, s).otherwise(1.0), small_dates)


def cs_standardise(df: DataFrame, columns: Sequence[str], small_dates: bool = False) -> DataFrame:
    """(x - mean) / sd per date; NULL when sd is zero or undefined."""
    return _scaled(df, columns, ratio, small_dates)


def log_float_cap(df: DataFrame, close: str = "close", shares: str = "shares", out: str = "log_cap") -> DataFrame:
    return df.withColumn(out, F.ln(F.col(close) * F.col(shares)))


def cap_outliers_xs(df: DataFrame, column: str = "factor", n: float = 3.0, two_sided: bool = False,
                    small_dates: bool = False, small_groups: bool = False) -> DataFrame:
    """Cap values above median + n * 1.4826 * mean absolute deviation, per date.

    The low side stays as it is unless ``two_sided``.
    """
    median = exact_median(df, column, "_median", small_groups=small_groups)
    centred = join_per_date(df, median, how="left", small_dates=small_dates)
    spread = centred.groupBy("date").agg(F.avg(F.abs(F.col(column) - F.col("_median"))).alias("_spread"))
    joined = join_per_date(centred, spread, small_dates=small_dates)
    reach = n * MAD_SCALE * F.col("_spread")
    high, low = F.col("_median") + reach, F.col("_median") - reach
    capped = F.when(F.col(column) > high, high)
    if two_sided:
        capped = capped.when(F.col(column) < low, low)
    return joined.withColumn(column, capped.otherwise(F.col(column))).select(*df.columns)


def neutralise_cap_industry(df: DataFrame, factors: Sequence[str], log_cap: str = "log_cap", industry: str = "industry",
                            standardise: bool = True, small_dates: bool = False) -> DataFrame:
    """Residual of each factor on log capital and industry dummies, per date, then standardised.

    With one industry per symbol the regression is: centre factor and capital inside (date, industry), slope over the
    date, residual. Rows with a missing part drop out of that factor only; a one-member industry has residual 0. All
    factors share two aggregates, each of which combines map-side.
    """
    ready = {f: F.col(f).isNotNull() & F.col(log_cap).isNotNull() & F.col(industry).isNotNull() for f in factors}
    means = df.groupBy("date", industry).agg(
        *[F.avg(F.when(ready[f], F.col(f))).alias(f"_y_{f}") for f in factors],
        *[F.avg(F.when(ready[f], F.col(log_cap))).alias(f"_x_{f}") for f in factors])
    joined = df.join(means, ["date", industry], "left")
    joined = joined.withColumns({
        **{f"_y_{f}": F.when(ready[f], F.col(f) - F.col(f"_y_{f}")) for f in factors},
        **{f"_x_{f}": F.when(ready[f], F.col(log_cap) - F.col(f"_x_{f}")) for f in factors}})
    slopes = joined.groupBy("date").agg(*[
        F.coalesce(ratio(F.sum(F.col(f"_x_{f}") * F.col(f"_y_{f}")), F.sum(F.col(f"_x_{f}") * F.col(f"_x_{f}"))),
                   F.lit(0.0)).alias(f"_b_{f}") for f in factors])
    residual = join_per_date(joined, slopes, small_dates=small_dates).withColumns(
        {f: inf_to_null(F.col(f"_y_{f}") - F.col(f"_b_{f}") * F.col(f"_x_{f}")) for f in factors})
    residual = residual.select(*df.columns)
    return cs_standardise(residual, factors, small_dates) if standardise else residual


def onto_codes(df: DataFrame, codes: DataFrame, small_dates: bool = False) -> DataFrame:
    """The rows of a cross-section table on a code list: every date has one row per code, NULL where there was none, other codes are
    dropped. A code without any row is there on every date too. No join of dates with codes: ``align.reindex_symbols`` expands rows.
    """
    listed = codes.select("symbol").distinct()
    known = df.join(listed, "symbol", "left_semi")
    return reindex_symbols(known.unionByName(listed, allowMissingColumns=True), df.select("date"), small_dates).select(*df.columns)


def neutralise_cap(df: DataFrame, factor: str = "factor", log_cap: str = "log_cap",
                   small_dates: bool = False) -> DataFrame:
    """Residual of the factor on log capital through the origin, per date."""
    both = F.col(factor).isNotNull() & F.col(log_cap).isNotNull()
    slopes = df.groupBy("date").agg(
        ratio(F.sum(F.when(both, F.col(factor) * F.col(log_cap))), F.sum(F.when(both, F.col(log_cap) * F.col(log_cap))))
        .alias("_slope"))
    joined = join_per_date(df, slopes, small_dates=small_dates)
    return joined.withColumn(factor, F.col(factor) - F.col("_slope") * F.col(log_cap)).select(*df.columns)


def factor_preprocess(df: DataFrame, dates: DataFrame, factor: str = "factor", small_dates: bool = False,
                      small_groups: bool = False) -> DataFrame:
    """Mask, cap, neutralise and standardise on the given dates (rebalance eves).

    ``df`` has symbol, date, factor, close and cap; the date filter comes first so nothing else is computed. Lazy: every step reads
    its input again for the statistics, so a caller whose ``df`` is expensive passes a stored one.
    """
    rows = join_per_date(df, dates.select("date"), how="left_semi", small_dates=small_dates)
    rows = cap_outliers_xs(mask_missing_price(rows, factor), factor, small_dates=small_dates, small_groups=small_groups)
    rows = neutralise_cap(rows.withColumn("log_cap", F.ln("cap")), factor, small_dates=small_dates)
    rows = rows.withColumn(factor, inf_to_null(factor))
    return cs_standardise(rows, [factor], small_dates).drop("log_cap")


def with_average_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    return average_rank(df, value, out)


def factor_layers(df: DataFrame, factor: str = "factor", layers: int = 5, tie: str = "symbol", small_groups: bool = False) -> DataFrame:
    """(date, symbol, layer, weight): equal slices of floor(count / layers) by factor descending, rest unassigned."""
    ranked = descending_row_number(df.select("date", "symbol", factor), factor, "_rn", "_count", tie=tie, small_groups=small_groups)
    size = F.floor(F.col("_count") / layers)
    layer = F.floor(ratio(F.col("_rn") - 1, size)).cast("int")
    return (ranked.where(F.col("_rn") <= size * layers)
            .select("date", "symbol", layer.alias("layer"), (1.0 / size).alias("weight")))


def top_k(scores: DataFrame, k: int, score: str = "score", position: str = "symbol",
          keys: Sequence[str] = ("date",)) -> DataFrame:
    """The k largest scores per date, NULLs skipped, ties to the smaller position.

    Spark prunes each input partition to k rows per date before the exchange (window group limit), so the
    exchange carries at most k rows per date and task whatever the universe size.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(position))
    return (scores.where(F.col(score).isNotNull())
            .withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k))
