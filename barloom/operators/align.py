"""Calendars and alignment of symbols to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.expr import nan_to_zero
from barloom.functions.frames import by_symbol, to_date
from barloom.operators.sizing import join_per_date

# Symbols of this form are dates: the table was turned.
DATED = r"^\d{4}-?\d{2}-?\d{2}([ T].*)?$"


def calendar_positions(dates: DataFrame) -> DataFrame:
    """(date, pos): dates numbered from 0. The input holds calendar dates only, so one small sort is enough."""
    return dates.select("date").distinct().select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))


def master_calendar(bars: DataFrame) -> DataFrame:
    """Dates of the symbol with the most rows; the smallest symbol wins a tie."""
    densest = (bars.groupBy("symbol").agg(F.count("*").alias("_n"))
               .orderBy(F.desc("_n"), "symbol").limit(1).select("symbol"))
    return bars.join(densest, "symbol", "left_semi").select("date")


def union_calendar(bars: DataFrame) -> DataFrame:
    """Every date any symbol has."""
    return bars.select("date").distinct()


def reindex_symbols(bars: DataFrame, calendar: DataFrame, small_dates: bool = False) -> DataFrame:
    """One row per symbol and calendar date; missing cells NULL, dates outside the calendar dropped.

    Instead of building symbols x dates and joining, each row is expanded to cover the gap up to the symbol's next
    row. That costs one exchange by symbol, which later symbol windows reuse, and two joins with the calendar.
    """
    values = [c for c in bars.columns if c not in ("symbol", "date")]
    numbered = calendar_positions(calendar)
    final = numbered.agg(F.max("pos")).scalar()
    placed = join_per_date(bars, numbered, "date", "left", small_dates)
    order = Window.partitionBy("symbol").orderBy(F.col("pos").asc_nulls_last(), "date")
    spans = (placed
             .withColumn("_row", F.row_number().over(order))
             .withColumn("_next", F.lead("pos").over(order)))
    first = F.col("_row") == 1
    cover = (F.when(F.col("pos").isNotNull(),
                    F.sequence(F.when(first, F.lit(0)).otherwise(F.col("pos")),
                               F.coalesce(F.col("_next") - 1, final)))
             .when(first, F.sequence(F.lit(0), final))
             .otherwise(F.array().cast("array<int>")))
    cells = spans.select("symbol", *values, F.col("pos").alias("_own"), F.explode(cover).alias("pos"))
    own = F.col("_own") == F.col("pos")
    kept = cells.select("symbol", "pos", *[F.when(own, F.col(v)).alias(v) for v in values])
    return join_per_date(kept, numbered, "pos", "inner", small_dates).select("symbol", "date", *values)


def align_to_master_calendar(bars: DataFrame, small_dates: bool = False) -> DataFrame:
    return reindex_symbols(bars, master_calendar(bars), small_dates)


def align_outer(bars: DataFrame, small_dates: bool = False) -> DataFrame:
    return reindex_symbols(bars, union_calendar(bars), small_dates)


def common_dates(bars: DataFrame) -> DataFrame:
    """Dates on which every symbol has a row ((symbol, date) is unique)."""
    symbols = bars.agg(F.count_distinct("symbol")).scalar()
    return bars.groupBy("date").agg(F.count("*").alias("_n")).where(F.col("_n") == symbols).select("date")


def align_intersection(bars: DataFrame, small_dates: bool = False) -> DataFrame:
    return join_per_date(bars, common_dates(bars), "date", "left_semi", small_dates)


def drop_warmup(panel: DataFrame, n: int = 60, small_dates: bool = False) -> DataFrame:
    """Drop the first n dates of the common calendar."""
    kept = calendar_positions(panel).where(F.col("pos") >= n).select("date")
    return join_per_date(panel, kept, "date", "left_semi", small_dates)


def asof_prices(targets: DataFrame, prices: DataFrame, columns: Sequence[str] = ("close",)) -> DataFrame:
    """Backward as-of join: last price row at or before each target (symbol, date); then NULL -> 0.

    A NULL inside the matched row stays missing and so becomes 0. Both sides are stacked and scanned once in
    symbol order: one exchange, no range join.
    """
    blank = [F.lit(None).cast(prices.schema[c].dataType).alias(c) for c in columns]
    stacked = (prices.select("symbol", "date", F.lit(0).alias("_side"), *columns)
               .unionByName(targets.select("symbol", "date", F.lit(1).alias("_side"), *blank)))
    frame = (Window.partitionBy("symbol").orderBy("date", "_side")
             .rowsBetween(Window.unboundedPreceding, 0))
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*columns)), ignorenulls=True).over(frame)
    return (stacked.withColumn("_seen", seen).where(F.col("_side") == 1)
            .select("symbol", "date", *[nan_to_zero(F.col("_seen")[c]).alias(c) for c in columns]))


def slice_dates(df: DataFrame, start: str, end: str, half_open: bool = False) -> DataFrame:
    """Rows from start to end, both inclusive; ``half_open`` leaves the end out."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    upper = F.col("date") < high if half_open else F.col("date") <= high
    return df.where((F.col("date") >= low) & upper)


def merge_bars_fundamentals(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    return bars.join(fundamentals, ["symbol", "date"], "left")


def attach_cap_and_industry(factors: DataFrame, caps: DataFrame, industries: DataFrame) -> DataFrame:
    """Factor rows with log capital of the date and the industry of the symbol."""
    logs = caps.select("symbol", "date", F.ln("cap").alias("log_cap"))
    return factors.join(logs, ["symbol", "date"], "left").join(industries, "symbol", "left")


def returns_onto_universe(universe: DataFrame, returns: DataFrame, column: str = "ret") -> DataFrame:
    """Returns for every (symbol, date) of the weight universe, 0 where missing."""
    joined = universe.join(returns.select("symbol", "date", column), ["symbol", "date"], "left")
    return joined.withColumn(column, nan_to_zero(column))


def walk_forward_subsets(df: DataFrame, spans: Sequence[dict]) -> DataFrame:
    """Tag rows with every (span, split) whose date range, inclusive, holds them.

    ``spans``: dicts with ``span`` and, for each of train / val / test, a (start, end) pair. The spans are a handful of
    literals, so the tags are an array expression on the row followed by an explode: no join at all.
    """
    tags = []
    for s in spans:
        for split in ("train", "val", "test"):
            low, high = (F.lit(d).cast("date") for d in s[split])
            tag = F.struct(F.lit(s["span"]).alias("span"), F.lit(split).alias("split"))
            tags.append(F.when(F.col("date").between(low, high), tag))
    return (df.withColumn("_tag", F.explode(F.array_compact(F.array(*tags))))
            .select(*df.columns, F.col("_tag.span").alias("span"), F.col("_tag.split").alias("split")))


def business_calendar(spark, start: str, end: str) -> DataFrame:
    """Monday to Friday between two dates, both inclusive."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.where(F.weekday("date") < 5)


def scoring_calendar(labels: DataFrame, n_days: int, val_end: int, start: str, end: str) -> DataFrame:
    """Dates of an n_days score matrix.

    The Monday-Friday range if its length fits, else the last n_days label dates from position val_end on; fewer
    label dates than n_days is an error.
    """
    spark = labels.sparkSession
    weekdays = business_calendar(spark, start, end)
    fits = weekdays.agg(F.count("*") == n_days).scalar()
    dates = calendar_positions(labels).where(F.col("pos") >= val_end)
    counted = dates.select("date", F.row_number().over(Window.orderBy(F.desc("date"))).alias("_back"),
                           F.count("*").over(Window.partitionBy()).alias("_have"))
    enough = F.when(F.col("_have") < n_days, F.raise_error(F.lit("not enough label dates for the score rows")))
    tail = counted.where(enough.isNull() & (F.col("_back") <= n_days)).select("date")
    return weekdays.where(fits).unionByName(tail.where(~fits))


def panel_guards(panel: DataFrame, value: str, transposition: bool = True, wide: bool = False) -> DataFrame:
    """One row of panel counts; raises when dates are not dates, (symbol, date) repeats, values are missing, or the
    panel has fewer dates than symbols (a transposed table). A universe may hold more symbols than the calendar dates: with
    ``wide`` the counts alone prove nothing, and such a panel counts as transposed when its symbols are dates."""
    if panel.schema["date"].dataType.typeName() != "date":
        raise TypeError("column date must be DATE")
    cells = panel.groupBy("symbol", "date").agg(
        F.count("*").alias("_n"), F.count_if(F.col(value).isNull() | F.isnan(value)).alias("_bad"))
    counts = cells.agg(F.count_distinct("date").alias("n_dates"), F.count_distinct("symbol").alias("n_symbols"),
                       F.sum("_n").alias("n_rows"), F.max("_n").alias("_repeat"), F.sum("_bad").alias("n_missing"),
                       F.bool_and(F.col("symbol").cast("string").rlike(DATED)).alias("_dated"))
    problem = (F.when(F.col("_repeat") > 1, "repeated (symbol, date)")
               .when(F.col("n_missing") > 0, "missing values"))
    if transposition:
        turned = F.col("n_dates") < F.col("n_symbols")
        problem = problem.when(turned & F.col("_dated") if wide else turned, "fewer dates than symbols: transposed?")
    guard = F.when(problem.isNotNull(), F.raise_error(problem))
    return counts.select("n_dates", "n_symbols", F.coalesce(guard.cast("bigint"), F.col("n_rows")).alias("n_rows"),
                         "n_missing")
