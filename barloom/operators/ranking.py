"""Exact ranks and medians inside a group (a date) of any size.

A plain window by date puts one date's whole universe into one task. Here each group is cut into cells by the leading bits of an
order-preserving 64-bit key of the value. One aggregate counts distinct values per 32-bit prefix; its sums per 16-bit prefix tell which
cells stay as they are and which are cut at 32 or, where even those are crowded, at 48 bits. A cell so holds at most CELL
distinct values, or at most the 65,536 that share 48 bits. Counts of the cells give the offset of a cell, and only the inside of a cell is
sorted. The cut depends on the values alone (counts, no sampling), so a replayed task gives the same answer.

Where the caller has checked that no group is large (``small_groups``, see ``sizing.groups_fit``), a window by group does the same
with one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Distinct values a cell may hold before it is cut again.
CELL = 20_000
# Groups of equal values above this size are cut further when rows inside them must be ordered.
TIE_CELL = 1 << 20
# Lengths of the prefixes tried to cut them when the tie-break column is a string.
PREFIXES = (3, 6, 10, 16, 32)


def order_key(value: Column) -> Column:
    """A long that grows with the value: the bits of a double read as sign and magnitude.

    Exponent and fraction are computed exactly (products with powers of two); NaN sorts last.
    """
    x = value.cast("double")
    size = F.abs(x)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int")
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(size >= power * 2, 1).when((size < power) & (guess > -1022), -1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("long")
    bits = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction
    tiny = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")  # below the smallest normal number the bits count its units
    magnitude = F.when(size < 2.0 ** -1022, tiny).when(size == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x < 0, -magnitude).otherwise(magnitude)


def _cell(value: Column) -> Column:
    """Cell number of a value whose cell is not crowded, never decreasing in the value."""
    return F.shiftright(order_key(value), 48)


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group: (by, value, n equal rows, below = smaller rows, total = rows of the group).

    NULL values are left out. Equal values collapse map-side, so a value shared by many rows is one row here.
    """
    by = list(by)
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    values = cut_crowded(values, by, value)
    cells = values.groupBy(*by, "_cell").agg(F.sum("n").alias("_cell_n"))
    ordered = Window.partitionBy(*by).orderBy("_cell")
    offsets = cells.select(
        *by, "_cell",
        (F.sum("_cell_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cell_n")).alias("_offset"),
        F.sum("_cell_n").over(Window.partitionBy(*by)).alias("total"))
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (values.withColumn("_upto", F.sum("n").over(inside))
            .join(offsets, [*by, "_cell"])
            .select(*by, value, "n", (F.col("_offset") + F.col("_upto") - F.col("n")).alias("below"), "total"))


def cut_crowded(values: DataFrame, by: list[str], value: str, cell: int | None = None) -> DataFrame:
    """Set ``_cell``, the smallest key of the cell of each distinct value (ascending with the value).

    ``top`` lists the crowded 16-bit prefixes, each with its crowded 32-bit ones, so it is smaller than the values by a factor of CELL; where
    nothing is crowded adaptive execution finds it empty.
    """
    cell = cell or CELL
    keyed = values.drop("_cell").withColumn("_key", order_key(F.col(value)))
    fine = keyed.groupBy(*by, F.shiftright("_key", 32).alias("_fine")).agg(F.count("*").alias("_k"))
    top = (fine.groupBy(*by, F.shiftright("_fine", 16).alias("_top"))
           .agg(F.sum("_k").alias("_k"), F.collect_list(F.when(F.col("_k") > cell, F.col("_fine"))).alias("_deep"))
           .where(F.col("_k") > cell))

    def floor(bits: int) -> Column:
        return F.shiftleft(F.shiftright("_key", bits), bits)

    cut = (F.when(F.col("_deep").isNull(), floor(48)).when(F.array_contains("_deep", F.shiftright("_key", 32)), floor(16))
           .otherwise(floor(32)))
    return (keyed.withColumn("_top", F.shiftright("_key", 48)).join(top, [*by, "_top"], "left")
            .select(*[c for c in values.columns if c != "_cell"], cut.alias("_cell")))


def average(out: str) -> Column:
    """Average-of-ties rank from a row of ``value_ranks``."""
    return (F.col("below") + (F.col("n") + 1) / 2).alias(out)


def window_average(value: str, out: str, by: Sequence[str] = ("date",)) -> Column:
    """Average-of-ties rank by windows over whole groups."""
    ties = F.count(value).over(Window.partitionBy(*by, value))
    below = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    return F.when(F.col(value).isNotNull(), below + (ties - 1) / 2).alias(out)


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ("date",), small_groups: bool = False) -> DataFrame:
    """Average-of-ties rank of each row in its group; NULL stays NULL."""
    if small_groups:
        return df.select("*", window_average(value, out, by))
    ranks = value_ranks(df, by, value).select(*by, value, average(out))
    return df.join(ranks, [*by, value], "left").select(*df.columns, out)


def exact_median(df: DataFrame, value: str, out: str, by: Sequence[str] = ("date",), small_groups: bool = False) -> DataFrame:
    """Median per group: the values covering the two middle positions."""
    if small_groups:
        return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias(out))
    ranks = value_ranks(df, by, value)
    upto = F.col("below") + F.col("n")
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    covers = sum(((F.col("below") < p) & (p <= upto)).cast("int") for p in (low, high))
    middle = ranks.withColumn("_w", covers).where(F.col("_w") > 0)
    return middle.groupBy(*by).agg((F.sum(F.col(value) * F.col("_w")) / 2).alias(out))


def _with_tie_cells(rows: DataFrame, keys: list[str], tie: str, hot: Column, limit: int | None = None) -> DataFrame:
    """Add ``_part``, an order-preserving cut of the tie-break column inside sets of equal values larger than TIE_CELL.

    Strings are cut by the shortest of a few prefixes of which none holds more than TIE_CELL rows of the set.
    """
    limit = limit or TIE_CELL
    if rows.schema[tie].dataType.typeName() != "string":
        return rows.withColumn("_part", F.when(hot, F.lpad(F.floor(F.col(tie) / limit).cast("string"), 20, "0")).otherwise(F.lit("")))
    cut = rows.where(hot)
    most = cut.select(*keys).distinct()
    for size in PREFIXES:
        worst = (cut.groupBy(*keys, F.substring(tie, 1, size).alias("_p")).agg(F.count("*").alias("_c"))
                 .groupBy(*keys).agg(F.max("_c").alias(f"_c{size}")))
        most = most.join(worst, keys)
    length = F.coalesce(*[F.when(F.col(f"_c{size}") <= limit, size) for size in PREFIXES], F.lit(PREFIXES[-1]))
    sized = rows.join(most.select(*keys, length.alias("_size")), keys, "left")
    return sized.withColumn("_part", F.when(hot, F.expr(f"substring(`{tie}`, 1, _size)")).otherwise(F.lit(""))).drop("_size")


def descending_row_number(df: DataFrame, value: str, out: str, total: str, by: Sequence[str] = ("date",),
                          tie: str = "symbol", small_groups: bool = False) -> DataFrame:
    """Row number by value descending, then tie ascending, plus the group size; rows with NULL value are dropped.

    ``tie`` is a string or a non-negative integer. Sets of equal values larger than TIE_CELL are cut by the tie column.
    """
    by = list(by)
    if small_groups:
        known, group = df.where(F.col(value).isNotNull()), Window.partitionBy(*by)
        return known.select("*", F.row_number().over(group.orderBy(F.desc(value), tie)).cast("bigint").alias(out), F.count("*").over(group).alias(total))
    ranks = value_ranks(df, by, value).select(
        *by, value, F.col("n").alias("_ties"), (F.col("total") - F.col("below") - F.col("n")).alias("_above"),
        F.col("total").alias(total))
    rows = df.join(ranks, [*by, value])
    hot = F.col("_ties") > TIE_CELL
    rows = _with_tie_cells(rows, [*by, value], tie, hot)
    parts = rows.where(hot).groupBy(*by, value, "_part").agg(F.count("*").alias("_part_n"))
    running = Window.partitionBy(*by, value).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = parts.select(*by, value, "_part", (F.sum("_part_n").over(running) - F.col("_part_n")).alias("_before"))
    inside = Window.partitionBy(*by, value, "_part").orderBy(tie)
    return (rows.withColumn("_in", F.row_number().over(inside))
            .join(offsets, [*by, value, "_part"], "left")
            .withColumn(out, F.col("_above") + F.coalesce(F.col("_before"), F.lit(0)) + F.col("_in"))
            .select(*df.columns, out, total))
