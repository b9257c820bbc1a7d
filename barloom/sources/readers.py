"""Readers for the file layouts of the pipeline; all return long, keyed DataFrames with NULL for missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from barloom.functions.expr import null_if_nan

# Block headings of the sectioned price file and the field each one carries.
SECTIONS = {"开盘价": "open", "最高价": "high", "最低价": "low", "收盘价": "close"}
SECTION_TAIL = 2
# One cell behind its comma: quoted text (a doubled quote stands for one) or anything up to the next comma.
CELL = r',((?:"(?:[^"]++|"")*+"|[^,"]++)*+)'


def read_bars(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    """Folder of one Parquet file per ticker; the ticker is the file name.

    Large panels should be rewritten once with ``write_panel``: a hundred thousand small files list slowly. Dataframe libraries store
    nanosecond dates, which Spark takes for whole numbers only in a session set so: the types are looked up in one of their own, and the
    settings of the caller's session stay as they are.
    """
    typing = spark.newSession()
    typing.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    found = typing.read.option("pathGlobFilter", "*.parquet").parquet(path).schema
    raw = spark.read.option("pathGlobFilter", "*.parquet").schema(found).parquet(path)
    date = date if date in raw.columns else "__index_level_0__"
    day = F.col(date)
    if raw.schema[date].dataType.typeName() == "long":
        day = F.timestamp_seconds(F.floor(day / F.lit(1_000_000_000)))
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    return raw.select(symbol.alias("symbol"), day.cast("date").alias("date"), *[
        null_if_nan(F.col(c).cast("double")).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")])


def read_csv_folder(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str]) -> DataFrame:
    """All CSV files of a glob, listed columns by the names in each file's own header.

    Files may order their columns differently and hold more of them; a listed column that a file lacks is NULL there. The
    header of a file is its first record; names and cells meet inside the row, so one scan reads all layouts. Quoted cells may
    hold commas, quotes and line breaks.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = _records(_placed(spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")))
    rows = (_with_heads(lines).withColumn("_names", F.transform(_csv_cells("_head"), _plain)).withColumn("_cells", _csv_cells("line")))

    def cell(name: str) -> Column:
        text = F.try_element_at("_cells", F.nullif(F.array_position("_names", name), F.lit(0)).cast("int"))
        return F.nullif(_plain(text), F.lit("")).try_cast(wanted[name].dataType).alias(name)

    return rows.select(*[cell(c) for c in columns])


def _with_quotes(batches):
    """Lines in file order with the quotes counted along each file split: whether the line's own number is odd (_odd), whether that of the
    split's lines before is (_before), and how many lines so far open a record, if the split begins outside (_open0) or inside (_open1) quotes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    split, inside, opened = None, 0, [0, 0]
    for batch in batches:
        odd = pc.fill_null(pc.count_substring(batch.column("line"), '"'), 0).to_numpy(zero_copy_only=False) % 2
        keys = list(zip(batch.column("_file").to_pylist(), batch.column("_block").to_pylist()))
        borders = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        before, counts = np.zeros(len(keys), np.int64), np.zeros((2, len(keys)), np.int64)
        for start, stop in zip(borders, borders[1:]):
            if stop > start:
                if keys[start] != split:
                    split, inside, opened = keys[start], 0, [0, 0]
                part = odd[start:stop]
                before[start:stop] = (inside + np.cumsum(part) - part) % 2
                for o in (0, 1):
                    counts[o, start:stop] = opened[o] + np.cumsum((before[start:stop] == o) & (part == 1))
                    opened[o] = int(counts[o, stop - 1])
                inside = int(before[stop - 1] + part[-1]) % 2
        for name, values in (("_odd", odd), ("_before", before), ("_open0", counts[0]), ("_open1", counts[1])):
            batch = batch.append_column(name, pa.array(values, pa.int64()))
        yield batch


def _records(lines: DataFrame) -> DataFrame:
    """Lines of ``_placed`` files joined to records: a line break between quotes is part of a cell.

    Whether a line begins inside quotes is the parity of all quotes before it. Each file split counts its own, for both ways it may begin;
    a running sum over the splits of a file (one row each) says which way it did, so borders are found in parallel. Only the lines of
    records with breaks are exchanged to be joined.
    """
    places = "line string, _file string, _block long, _at long"
    marked = lines.select("line", "_file", "_block", "_at").mapInArrow(_with_quotes, f"{places}, _odd long, _before long, _open0 long, _open1 long")
    splits = marked.groupBy("_file", "_block").agg((F.sum("_odd") % 2).alias("_parity"), F.max("_open0").alias("_o0"), F.max("_open1").alias("_o1"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.withColumn("_inside", F.coalesce(F.sum("_parity").over(earlier), F.lit(0)) % 2)
    offset = F.coalesce(F.sum(F.when(F.col("_inside") == 0, F.col("_o0")).otherwise(F.col("_o1"))).over(earlier), F.lit(0))
    placed = marked.join(begun.select("_file", "_block", "_inside", offset.alias("_offset")), ["_file", "_block"])
    before = (F.col("_before") + F.col("_inside")) % 2
    one = (before == 0) & (F.col("_odd") == 0)
    opener = F.col("_offset") + F.when(F.col("_inside") == 0, F.col("_open0")).otherwise(F.col("_open1"))
    parts = F.sort_array(F.collect_list(F.struct("_block", "_at", "line")))
    joined = placed.where(~one).groupBy("_file", opener.alias("_record")).agg(parts.alias("_parts")).select(
        F.array_join(F.transform("_parts", lambda x: x["line"]), "\n").alias("line"), "_file", F.col("_parts")[0]["_block"].alias("_block"),
        F.col("_parts")[0]["_at"].alias("_at"))
    return placed.where(one).select("line", "_file", "_block", "_at").union(joined).withColumn("line", F.regexp_replace("line", "\\r$", ""))


def _csv_cells(line: Column | str) -> Column:
    """Cells of a line, quotes kept. Each character is read once: the repeats are possessive and cells never go back."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1)), lambda x: x)


def _plain(text: Column) -> Column:
    """A cell without its outer quotes; doubled quotes inside are single ones."""
    quoted = F.trim(text).rlike('^"[^\\x00]*"$')
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), '^"|"$', ""), '""', '"')
    return F.when(quoted, bare).otherwise(F.trim(text))


def read_wide_panel(spark: SparkSession, path: str, value: str = "value", zero_missing: bool = False) -> DataFrame:
    """CSV with tickers in the header and dates in the first column; one file, or a folder of files with a header each (``write_wide``).

    The header meets the lines as a row, so tickers are data and no list of columns is made.
    """
    lines = _placed(spark.read.option("recursiveFileLookup", True).text(path).withColumnRenamed("value", "line"))
    rows = _with_heads(lines).withColumns({"_names": F.transform(_csv_cells("_head"), _plain), "_cells": _csv_cells("line")})
    pairs = F.slice(F.arrays_zip(F.col("_names").alias("name"), F.col("_cells").alias("text")), F.lit(2), F.size("_names"))
    cells = rows.select(_plain(F.get("_cells", F.lit(0))).try_cast("date").alias("date"), F.inline(pairs))
    number = null_if_nan(_plain(F.col("text")).try_cast("double"))
    return cells.select("date", F.col("name").alias("symbol"), (F.coalesce(number, F.lit(0.0)) if zero_missing else number).alias(value))


def _with_heads(lines: DataFrame) -> DataFrame:
    """Lines of ``_placed`` files with the first line of their file (``_head``); that line and empty ones are left out."""
    heads = lines.where(F.col("_block") == 0).groupBy("_file").agg(
        F.min(F.struct("_at", F.col("line").alias("_head"))).alias("_first")).select("_file", F.col("_first._at").alias("_head_at"), "_first._head")
    return lines.join(heads, "_file").where((F.col("_at") != F.col("_head_at")) & (F.col("line") != ""))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add pos: rows of a text scan numbered from 0 in file order.

    Rows are numbered inside each file split, and the splits' row counts give the offsets, so a large file is numbered
    in parallel. Needs the columns of ``_placed``.
    """
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, 0)
    offsets = splits.select("_file", "_block", (F.sum("_n").over(running) - F.col("_n")).alias("_offset"))
    inside = Window.partitionBy("_file", "_block").orderBy("_at")
    return (rows.withColumn("_in", F.row_number().over(inside)).join(offsets, ["_file", "_block"])
            .withColumn("pos", (F.col("_offset") + F.col("_in") - 1).cast("int"))
            .drop("_file", "_block", "_at", "_in", "_offset"))


def _placed(scan: DataFrame) -> DataFrame:
    return scan.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_at"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos): text lines in file order."""
    return _numbered(_placed(spark.read.text(path).withColumnRenamed("value", "line")))


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, pos): one symbol per line, blank lines dropped, positions in line order."""
    kept = numbered_lines(spark, path).select(F.trim("line").alias("symbol"), "pos").where(F.col("symbol") != "")
    return kept.select("symbol", (F.row_number().over(Window.orderBy("pos")) - 1).cast("int").alias("pos"))


def read_positional_matrix(spark: SparkSession, path: str, dates: DataFrame, tickers: DataFrame,
                           value: str = "pred", as_text: bool = False) -> DataFrame:
    """Headerless CSV, row i = date i, column j = ticker j, to (date, symbol, value).

    ``dates``: (date, pos); ``tickers``: (symbol, pos). A count mismatch is an error. Cells may be quoted text.
    """
    n_dates, n_tickers = dates.agg(F.count("*")).scalar(), tickers.agg(F.count("*")).scalar()
    lines = numbered_lines(spark, path).where(F.col("line") != "")
    cells = _csv_cells("line")
    wrong = F.when(F.size("_cells") != n_tickers, F.raise_error(F.lit("columns and tickers differ in number")))
    checked = lines.withColumn("_cells", cells).withColumn("_cells", F.coalesce(wrong.cast("array<string>"), "_cells"))
    rows = lines.agg(F.count("*")).scalar()
    days = dates.withColumn("pos", F.when(rows != n_dates, F.raise_error(F.lit("rows and dates differ in number"))
                                          .cast("int")).otherwise(F.col("pos")))
    text = _plain(F.col("_text"))
    number: Column = text if as_text else null_if_nan(text.try_cast("double"))
    return (checked.select("pos", F.posexplode("_cells").alias("_j", "_text"))
            .join(days, "pos").select("date", "_j", "_text")
            .join(tickers.withColumnRenamed("pos", "_j"), "_j")
            .select("date", "symbol", number.alias(value)))


def read_sectioned_ohlc(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """CSV with one wide block per price field, each opened by a heading in its first cell, to (date, symbol, open..close).

    The last two rows of each block are notes and dropped. Cells that are no numbers are NULL. Spark itself reads GBK only with a
    legacy setting, so lines are taken as bytes and decoded in batches, whatever the session; the encoding must end lines by one byte,
    as GBK and UTF-8 do.
    """
    scan = _placed(spark.read.option("lineSep", "\n").text(path).withColumn("value", F.col("value").cast("binary")))
    lines = _decoded(scan, encoding).withColumn("line", F.regexp_replace("line", "\\r$", "")).where(F.trim("line") != "")
    numbered = _numbered(lines)
    first = numbered.where(F.col("pos") == 0)
    n_columns = first.select(F.size(_csv_cells("line"))).first()
    if n_columns is None:
        raise ValueError(f"no lines in {path}")
    names = [f"_c{i}" for i in range(n_columns[0])]
    raw = numbered.select(F.from_csv("line", ", ".join(f"{n} string" for n in names)).alias("_row"), "pos").select("_row.*", "pos")
    head = raw.where(F.col("pos") == 0).select(*names).first()
    code, dates = names[3], names[4:]
    heading = F.col(names[0]).isin(*SECTIONS)
    heads = raw.where(heading).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(names[0]).alias("name"))))).scalar()
    n_rows = raw.agg(F.max("pos") + 1).scalar()
    before = F.filter("_heads", lambda h: h["pos"] <= F.col("pos"))
    after = F.filter("_heads", lambda h: h["pos"] > F.col("pos"))
    rows = (raw.withColumn("_heads", heads).withColumns({"_head": F.try_element_at(before, F.lit(-1)),
                             "_end": F.coalesce(F.try_element_at(after, F.lit(1))["pos"], n_rows)})
            .where(F.col("_head").isNotNull() & (F.col("pos") < F.col("_end") - SECTION_TAIL)))
    field = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[F.col("_head.name")]
    named = rows.select(F.col(code).alias("symbol"), field.alias("_field"), *[F.col(c).alias(head[c]) for c in dates])
    long = named.unpivot(["symbol", "_field"], [f"`{head[c]}`" for c in dates], "_date", "_value")
    day = F.coalesce(F.col("_date").try_cast("date"),
                     F.try_to_timestamp("_date", F.lit("yyyy/M/d")).cast("date"))
    cells = long.select(day.alias("date"), "symbol", "_field", F.col("_value").try_cast("double").alias("_value"))
    return cells.groupBy("date", "symbol").pivot("_field", list(SECTIONS.values())).agg(F.first("_value", True))


def _decoded(scan: DataFrame, encoding: str) -> DataFrame:
    """Bytes of a ``_placed`` scan (value) as text (line)."""
    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [None if v is None else v.decode(encoding, "replace") for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *(batch.column(c) for c in ("_file", "_block", "_at"))],
                                             names=["line", "_file", "_block", "_at"])

    return scan.mapInArrow(decode, "line string, _file string, _block long, _at long")


def read_split_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("train_end int, val_end int").option("multiLine", True).json(path)


def attach_calendar(matrix_path: str, calendar: DataFrame, tickers: DataFrame, start: str, **kw) -> DataFrame:
    """Key a headerless score matrix by the calendar dates from ``start`` on."""
    from barloom.operators.align import calendar_positions

    days = calendar_positions(calendar.where(F.col("date") >= F.lit(start).cast("date")))
    return read_positional_matrix(calendar.sparkSession, matrix_path, days, tickers, **kw)
