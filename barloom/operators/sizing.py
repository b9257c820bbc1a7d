"""Join helpers that keep broadcasts behind a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A table with one row per date below this count is a few MB even with a hundred statistics columns.
MAX_BROADCAST_DATES = 40_000


def dates_fit(df: DataFrame, date: str = "date", limit: int = MAX_BROADCAST_DATES) -> bool:
    """True when the table has at most ``limit`` distinct dates.

    One column-pruned aggregate; run it once on the stored table and hand the answer to the operators as
    ``small_dates``. With ``small_dates=False`` every per-date join is a plain equi-join that adaptive
    execution sizes, splits or converts at run time.
    """
    return df.select(date).distinct().limit(limit + 1).count() <= limit


# Rows of one group that a task sorts without trouble: some ten MB of keys and values.
MAX_GROUP_ROWS = 200_000


def groups_fit(df: DataFrame, by: str = "date", limit: int = MAX_GROUP_ROWS) -> bool:
    """True when no group (date) has more than ``limit`` rows, so that ordering a group inside one task is bounded.

    One aggregate of counts; run it once on the stored table and hand the answer to the operators as ``small_groups``. With
    ``small_groups=False`` groups are cut into cells of bounded size (``ranking``); the results are the same.
    """
    most = df.groupBy(by).count().agg(F.max("count")).first()[0]
    return most is None or most <= limit


def join_per_date(df: DataFrame, per_date: DataFrame, on="date", how: str = "inner",
                  small_dates: bool = False) -> DataFrame:
    """Join a table holding one row per date (or per date and strategy) onto a panel."""
    side = F.broadcast(per_date) if small_dates else per_date
    return df.join(side, on, how)
