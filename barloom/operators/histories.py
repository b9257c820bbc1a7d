"""The histories of many symbols as arrays, and what the features are made of.

Spark gathers the rows of a symbol in date order, as ``ewm`` does; a task then works on the histories of some symbols at once (``by_history``).
An array has a row per symbol and a column per date of its history; a missing value is NaN, as is what lies beyond the end of a shorter history.
The formulas are those of ``features``, whose functions stay the ones for single families.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Rows that a task gathers before it packs them; cells of an array, which are the longest history times the number of histories (one at least).
ROWS, CELLS = 16_384, 65_536


def by_history(df: DataFrame, kept: Sequence[str], made: Sequence[str], make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
               fields: Sequence[str], fill: bool = False) -> DataFrame:
    """Columns ``kept`` of each row and the double columns ``made``, which ``make`` gives from the arrays of ``fields``; with ``fill`` each
    is carried forward along its history, then its first value back.

    Rows are exchanged by symbol unless they lie so already, and leave symbol after symbol in date order. A symbol's history is no longer
    than the calendar.
    """
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    packed = df.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", *rest))).alias("_h"))
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(c, T.DoubleType()) for c in made]])

    def chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        first, longest = 0, 0
        for i, n in enumerate(lengths):
            longest = max(longest, n)
            if i > first and longest * (i + 1 - first) > CELLS:
                yield first, i
                first, longest = i, n
        yield first, len(lengths)

    def worked(symbols: pa.Array, histories: pa.ListArray) -> pa.RecordBatch:
        lengths = np.diff(histories.offsets.to_numpy())
        who = np.repeat(np.arange(len(lengths)), lengths)
        spot = np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = histories.flatten()
        columns = dict(zip([f.name for f in rows.type], rows.flatten())) | {"symbol": symbols.take(pa.array(who))}
        arrays = {c: np.full((len(lengths), lengths.max()), np.nan) for c in fields}
        for c, x in arrays.items():
            x[who, spot] = columns[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            out = make(arrays)
        if fill:
            inside = np.arange(lengths.max()) < lengths[:, None]
            out = {c: filled(np.where(inside, x, np.nan)) for c, x in out.items()}
        return pa.RecordBatch.from_arrays([*[columns[c] for c in kept], *[pa.array(out[c][who, spot], from_pandas=True) for c in made]],
                                          names=[*kept, *made])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                symbols, histories = batch.column("symbol"), batch.column("_h")
                for a, b in chunks(np.diff(histories.offsets.to_numpy())):
                    yield worked(symbols.slice(a, b - a), histories.slice(a, b - a))

    return packed.mapInArrow(walk, schema)


def earlier(x: np.ndarray, k: int = 1, fill: float = np.nan) -> np.ndarray:
    out = np.full_like(x, fill)
    out[:, k:] = x[:, :max(0, x.shape[1] - k)]
    return out


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, np.nan, a / b)


def forward(x: np.ndarray) -> np.ndarray:
    known = np.maximum.accumulate(np.where(np.isnan(x), 0, np.arange(x.shape[1])), axis=1)
    return np.take_along_axis(x, known, 1)


def filled(x: np.ndarray) -> np.ndarray:
    """Carried forward, then the first known value carried back."""
    first = np.take_along_axis(x, np.argmax(~np.isnan(x), axis=1)[:, None], 1)
    carried = forward(x)
    return np.where(np.isnan(carried), first, carried)


def running(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = ~np.isnan(x)
    return np.cumsum(np.where(known, x, 0.0), axis=1), np.cumsum(known, axis=1).astype(float)


def mean(sums: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Mean of k rows, as a difference of running sums; NaN until k values are present."""
    total, count = (s - earlier(s, k, 0.0) for s in sums)
    return np.where(count == k, total, np.nan) / k


def extreme(pick: Callable, short: np.ndarray, b: int, k: int) -> np.ndarray:
    """Highest or lowest of k rows from those of b rows; NaN where one is missing."""
    out = short
    for i in (*range(b, k - b, b), k - b):
        out = pick(out, earlier(short, i)) if i else out
    return out


def deviation(means: np.ndarray, variances: np.ndarray, b: int, k: int) -> np.ndarray:
    """Sample deviation of k rows from the means and variances of the k / b frames of b rows."""
    means, variances = ([earlier(part, at) for at in range(0, k, b)] for part in (means, variances))
    whole = sum(means) / len(means)
    return np.sqrt(b * sum(v + (m - whole) ** 2 for v, m in zip(variances, means)) / (k - 1))


def smoothed(series: Sequence[tuple[np.ndarray, float, int]]) -> list[np.ndarray]:
    """Exponential means of (values, alpha, least number of values): what ``ewm`` gives, all advancing together."""
    x = np.ascontiguousarray(np.stack([s for s, *_ in series]).transpose(2, 0, 1))
    alpha, least = (np.array(v, float)[:, None] for v in zip(*[s[1:] for s in series]))
    y, gap, seen, out = np.full(x.shape[1:], np.nan), np.zeros(x.shape[1:]), np.zeros(x.shape[1:]), np.empty_like(x)
    for i, now in enumerate(x):
        known = ~np.isnan(now)
        old = np.where(gap == 0, 1 - alpha, (1 - alpha) ** (gap + 1)) if gap.any() else 1 - alpha
        y = np.where(known, np.where(np.isnan(y), now, (old * y + alpha * now) / (old + alpha)), y)
        gap = np.where(known | np.isnan(y), 0, gap + 1)
        seen += known
        out[i] = np.where(seen >= least, y, np.nan)
    return list(out.transpose(1, 2, 0))
