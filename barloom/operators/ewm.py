"""Exponentially weighted means as a fold over the history of each symbol.

The recursion needs the previous mean, which no window frame offers in constant work per row. A symbol's history is an
array no longer than the calendar, so it is folded with the SQL ``aggregate`` function: all series, and differences of them,
advance together in one pass, in the JVM, and the exchange by symbol is shared with the windows around it. The fold walks the array
in chunks so that appending results stays cheap for long histories.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 64


@dataclass(frozen=True)
class Ewm:
    """Output column ``out`` = mean of column ``source`` with smoothing ``alpha``; NULL before ``min_periods`` values.

    A gap inside the series decays the old mean by its length, and the mean is carried over missing values. A pair of names as
    ``source`` is the difference of the means of these two outputs, walked in the same pass; it has a value from their first on.
    """

    out: str
    source: str | tuple[str, str]
    alpha: float
    min_periods: int = 1


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def ewm(df: DataFrame, *series: Ewm) -> DataFrame:
    """Add all series at once. Rows of a symbol are taken in date order; (symbol, date) is unique."""
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    plain = [s for s in series if isinstance(s.source, str)]
    gaps = [s for s in series if not isinstance(s.source, str)]
    if any(s.min_periods != 1 for s in gaps):
        raise ValueError("a difference of means has no min_periods")
    sources = list(dict.fromkeys(s.source for s in plain))
    means = list(dict.fromkeys((s.source, s.alpha) for s in plain))
    place = {s.out: means.index((s.source, s.alpha)) for s in plain}

    def blank(kind: str) -> Column:
        return F.lit(None).cast(kind)

    empty = F.struct(*[blank("double").alias(f"y{i}") for i in range(len(means))],
                     *[blank("double").alias(f"d{i}") for i in range(len(gaps))],
                     *[F.lit(0).alias(f"gap{j}") for j in range(len(sources))],
                     *[F.lit(0).alias(f"seen{j}") for j in range(len(sources))])

    def between(state: Column, fresh: list[Column], steady: bool) -> list[Column]:
        fields = []
        for i, s in enumerate(gaps):
            y, x = state[f"d{i}"], fresh[place[s.source[0]]] - fresh[place[s.source[1]]]
            step = ((1 - s.alpha) * y + s.alpha * x) / (1 - s.alpha + s.alpha)
            fields.append((step if steady else F.when(x.isNull(), y).when(y.isNull(), x).otherwise(step)).alias(f"d{i}"))
        return fields

    def any_step(state: Column, row: Column) -> Column:
        fresh = []
        for i, (source, alpha) in enumerate(means):
            y, x = state[f"y{i}"], row[source].cast("double")
            gap = state[f"gap{sources.index(source)}"]
            old = F.when(gap == 0, F.lit(1 - alpha)).otherwise(F.pow(F.lit(1 - alpha), gap + 1))
            fresh.append(F.when(x.isNull(), y).when(y.isNull(), x).otherwise((old * y + alpha * x) / (old + alpha)))
        counts = [F.when(row[source].isNull(), state[f"gap{j}"] + 1).otherwise(0).alias(f"gap{j}") for j, source in enumerate(sources)]
        counts += [(state[f"seen{j}"] + F.when(row[source].isNull(), 0).otherwise(1)).alias(f"seen{j}") for j, source in enumerate(sources)]
        return F.struct(*[y.alias(f"y{i}") for i, y in enumerate(fresh)], *between(state, fresh, False), *counts)

    def steady_step(state: Column, row: Column) -> Column:
        """The same arithmetic where every mean is known and nothing is missing, now or in the row before."""
        fresh = [((1 - alpha) * state[f"y{i}"] + alpha * row[source].cast("double")) / (1 - alpha + alpha)
                 for i, (source, alpha) in enumerate(means)]
        counts = [F.lit(0).alias(f"gap{j}") for j in range(len(sources))] + [(state[f"seen{j}"] + 1).alias(f"seen{j}") for j in range(len(sources))]
        return F.struct(*[y.alias(f"y{i}") for i, y in enumerate(fresh)], *between(state, fresh, True), *counts)

    def advance(state: Column, row: Column) -> Column:
        known = [(state[f"seen{j}"] > 0) & (state[f"gap{j}"] == 0) & row[source].isNotNull() for j, source in enumerate(sources)]
        known += [state[f"d{i}"].isNotNull() for i in range(len(gaps))]
        return F.when(reduce(lambda a, b: a & b, known), steady_step(state, row)).otherwise(any_step(state, row))

    def within(state: Column, chunk: Column) -> Column:
        """States after each row of a chunk, the entering state first."""
        return F.aggregate(chunk, F.array(state),
                           lambda states, row: F.array_append(states, advance(F.element_at(states, -1), row)))

    def across(chunks: Column) -> Column:
        return F.aggregate(chunks, F.array(F.array(empty)), lambda done, chunk: F.array_append(
            done, within(F.element_at(F.element_at(done, -1), -1), chunk)))

    history = df.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", *rest))).alias("_h"))
    starts = F.sequence(F.lit(1), F.size("_h"), F.lit(CHUNK))
    cut = history.withColumn("_c", F.transform(starts, lambda at: F.slice("_h", at, CHUNK)))
    walked = cut.select("symbol", "_h", F.flatten(F.transform(
        across(F.col("_c")), lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))))).alias("_o"))
    rows = walked.select("symbol", F.explode(F.arrays_zip("_h", "_o")).alias("_z"))
    outs = []
    state = F.col("_z._o")
    for s in series:
        if s in gaps:
            outs.append(state[f"d{gaps.index(s)}"].alias(s.out))
            continue
        seen = state[f"seen{sources.index(s.source)}"]
        outs.append(F.when(seen >= s.min_periods, state[f"y{place[s.out]}"]).alias(s.out))
    return rows.select(*[F.col(c) if c == "symbol" else F.col(f"_z._h.{c}") for c in df.columns], *outs)
