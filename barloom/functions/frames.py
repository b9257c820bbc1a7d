"""Window frames. A symbol has one row per date, so a symbol frame never exceeds the calendar length."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from barloom.functions.expr import col


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def trailing(k: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(k - 1), 0)


def to_date() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def lagged(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_symbol())


def forward_fill(x: Column | str) -> Column:
    return F.last(col(x), ignorenulls=True).over(to_date())


def first_known(x: Column | str) -> Column:
    """First known value of the symbol, on every row. In the order of the other frames, so it needs no sort of its own."""
    return F.first(col(x), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def backward_fill(x: Column | str) -> Column:
    """Next known value. A running frame over descending dates: a frame reaching to the end would be rebuilt per row."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col(x), ignorenulls=True).over(back)
