"""The panels the registered queries run on, derived from the bench tables.

Suppliers are the symbols, weeks (months, days) the dates, price per unit the price, quantity the volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.frames import lagged, trailing
from barloom.functions.expr import ratio
from barloom.operators import align, clean, targets, xsection
from barloom.operators.sizing import dates_fit, groups_fit

FIELDS = list(clean.PRICE_FIELDS)
UNITS = {"week": "week", "month": "month", "day": None}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_fits: dict[tuple[str, str], bool] = {}


def small_dates(spark: SparkSession, sf: str, source: str = "lineitem", time: str = "l_shipdate") -> bool:
    """Checked once per table: does a table with one row per date of it fit a broadcast?"""
    if (sf, source) not in _fits:
        _fits[sf, source] = dates_fit(table(spark, sf, source).select(F.to_date(time).alias("date")))
    return _fits[sf, source]


_groups: dict[str, bool] = {}


def small_groups(spark: SparkSession, sf: str) -> bool:
    """Checked once per table: is every date's universe small enough for one task?"""
    if sf not in _groups:
        _groups[sf] = groups_fit(bars(spark, sf))
    return _groups[sf]


def _ohlc(rows: DataFrame, order: Column) -> DataFrame:
    """First, highest, lowest, last price and volume per symbol and date."""
    return rows.groupBy("symbol", "date").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"))


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Result several queries start from, written once per process as Parquet and read back.

    The written table cuts the lineage: a lost executor rereads files instead of replaying the chain, and the plans
    of the queries stay short.
    """
    if (sf, name) not in _stored:
        path = scratch(spark, name)
        build().write.parquet(path)
        _stored[sf, name] = path
    return spark.read.parquet(_stored[sf, name])


def bars(spark: SparkSession, sf: str, unit: str = "week") -> DataFrame:
    return stored(spark, sf, f"bars-{unit}", lambda: build_bars(spark, sf, unit))


def build_bars(spark: SparkSession, sf: str, unit: str = "week") -> DataFrame:
    li = table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate")
    date = F.trunc(day, UNITS[unit]) if UNITS[unit] else day
    fields = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    # the slim rows travel, not aggregates holding two of them: a bar has few rows, so combining first sorts (and spills) all rows for little
    slim = li.select(F.col("l_suppkey").alias("symbol"), date.alias("date"), *fields).repartition("symbol", "date")
    rows = slim.select("symbol", "date", F.struct(*fields).alias("at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                       F.col("l_quantity").alias("amount"))
    return _ohlc(rows, F.col("at"))


def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    rows = ev.select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date"), F.struct("ts", "event_id").alias("at"),
                     F.col("value").alias("price"), F.col("value").alias("amount"))
    return _ohlc(rows, F.col("at"))


def aligned(spark: SparkSession, sf: str, unit: str = "week") -> DataFrame:
    return align.align_to_master_calendar(bars(spark, sf, unit), small_dates(spark, sf))


def filled(spark: SparkSession, sf: str, unit: str = "week", n: int = 5) -> DataFrame:
    return clean.ffill_limit(aligned(spark, sf, unit), n=n)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars on the master calendar, gaps filled: no missing cell."""
    return stored(spark, sf, "panel", lambda: build_panel(spark, sf))


def build_panel(spark: SparkSession, sf: str) -> DataFrame:
    return clean.ffill_bfill(clean.drop_sparse_symbols(filled(spark, sf)))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, score): cross-section z-score of the five-week change known a week earlier."""
    return stored(spark, sf, "scores", lambda: build_scores(spark, sf))


def build_scores(spark: SparkSession, sf: str) -> DataFrame:
    known = panel(spark, sf).select("symbol", "date", ((ratio(lagged("close", 1), lagged("close", 6)) - 1) * 100)
                                    .alias("score")).where(F.col("score").isNotNull())
    return xsection.cs_zscore(known, ["score"], small_dates(spark, sf)).select("date", "symbol", "score")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "labels", lambda: targets.forward_return(
        panel(spark, sf), small_dates=small_dates(spark, sf)))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Scores next to labels: pred, label and the classes of both."""
    joined = scores(spark, sf).join(labels(spark, sf), ["date", "symbol"])
    return joined.select("date", "symbol", (F.col("score") / 100).alias("pred"), F.col("fwd_ret").alias("label"),
                         (F.col("score") > 0).cast("int").alias("pred_class"),
                         (F.col("fwd_ret") > 0).cast("int").alias("label_class"))


def logit_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, cell): two logits as bracketed text with four decimals."""
    s = F.col("score")
    cell = F.concat(F.lit("[ "), (-s).cast("decimal(12,4)").cast("string"), F.lit(" "),
                    s.cast("decimal(12,4)").cast("string"), F.lit("]"))
    return scores(spark, sf).select("date", "symbol", cell.alias("cell"))


def index_close(spark: SparkSession, sf: str) -> DataFrame:
    """(date, close): mean close of the panel as the index."""
    return panel(spark, sf).groupBy("date").agg(F.avg("close").alias("close"))


def industries(spark: SparkSession, sf: str) -> DataFrame:
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("symbol"), F.col("n_regionkey").alias("industry"))


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with shares (traded volume of twelve weeks) and cap = close * shares."""
    shares = F.sum("volume").over(trailing(12))
    return panel(spark, sf).withColumn("shares", shares).withColumn("cap", F.col("close") * F.col("shares"))


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, factor, momentum, close, cap, log_cap, industry) where the factor is known."""
    base = fundamentals(spark, sf).withColumns({
        "factor": ratio("close", lagged("close", 5)) - 1, "momentum": F.col("close") - lagged("close", 10)})
    return (base.where(F.col("factor").isNotNull()).join(industries(spark, sf), "symbol", "left")
            .select("date", "symbol", "factor", "momentum", "close", "cap", F.ln("cap").alias("log_cap"), "industry"))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listing date (first day traded) of suppliers in nations below 20; the others have none on record."""
    first = bars(spark, sf, "day").groupBy("symbol").agg(F.min("date").alias("listing_date"))
    known = table(spark, sf, "supplier").where(F.col("s_nationkey") < 20).select(F.col("s_suppkey").alias("symbol"))
    return first.join(known, "symbol")


def status_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with listing status and book value of the symbol."""
    nation = F.col("s_nationkey")
    status = F.when(nation.isin(0, 24), "*ST").when(nation == 23, "ST").otherwise("Norm")
    facts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), status.alias("status"),
                                                F.col("s_acctbal").alias("book_value"))
    return bars(spark, sf, "day").select("symbol", "date", "close").join(facts, "symbol")


def constituents(spark: SparkSession, sf: str) -> DataFrame:
    """Index members: suppliers outside region 0."""
    return industries(spark, sf).where(F.col("industry") != 0).select("symbol")


# Fourteen overlapping train / val / test ranges, each a quarter after the one before.
def spans() -> list[dict]:
    import datetime as dt

    out = []
    for i in range(14):
        first = dt.date(1995, 1, 2) + dt.timedelta(weeks=13 * i)
        ends = [first + dt.timedelta(weeks=w) for w in (0, 104, 130, 156)]
        cut = [(str(a), str(b - dt.timedelta(days=1))) for a, b in zip(ends, ends[1:])]
        out.append({"span": i, "train": cut[0], "val": cut[1], "test": cut[2]})
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder for a written table, below ``spark.checkpoint.dir`` or else the warehouse; both are shared by all executors."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    import uuid

    return f"{base}/barloom-{name}-{uuid.uuid4().hex[:12]}"
