"""One registered query per operator, each over the whole bench tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.types import DoubleType, FloatType

from barloom.functions import logits as L
from barloom.operators import (align, clean, embedding, evaluate, features, graph, nav, portfolio, reports, scoring, sizing, targets,
                               wide, windows, xsection)
from barloom.plans import pipeline, views as V
from barloom.session import in_buckets
from barloom.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def comparable(name: str, digits: int):
    """Round so that two engines' sums compare equal: to ``digits`` decimals, values from a million on to ten figures.

    The small shift keeps exact decimal ties, which engines round differently, away from the edge.
    """
    x = F.col(name).cast("double")
    return F.when(F.abs(x) >= 1e6, F.format_string("%.9e", x).cast("double")).otherwise(
        F.round(x + 1e-9, digits)).alias(name)


def query(name: str, digits: int = 6):
    """Register a query; double columns of its result are made comparable."""
    def wrap(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = f(spark, sf)
            return out.select(*[comparable(c.name, digits) if isinstance(c.dataType, (DoubleType, FloatType))
                                else F.col(c.name) for c in out.schema])
        run.__name__ = name
        run.__doc__ = f.__doc__
        run.plain = f
        QUERIES[name] = run
        return f
    return wrap


def fits(spark, sf):
    return V.small_dates(spark, sf)


def event_dates_fit(spark, sf):
    return V.small_dates(spark, sf, "events", "ts")


# Sources and sinks: written in one layout, read back through the reader.

@query("A1_read_bars")
def _(spark, sf):
    path = V.scratch(spark, "tickers")
    writers.write_bars(V.bars(spark, sf, "month"), path)
    return readers.read_bars(spark, path).withColumn("symbol", F.col("symbol").cast("bigint"))


@query("A2_read_csv_folder")
def _(spark, sf):
    path = V.scratch(spark, "csv")
    V.bars(spark, sf).write.option("header", True).csv(path)
    schema = "symbol bigint, date date, open double, high double, low double, close double, volume double"
    return readers.read_csv_folder(spark, path, schema, ["symbol", "date", "close", "volume"])


@query("A2_read_csv_line_breaks")
def _(spark, sf):
    """Whole documents as quoted cells with line breaks, commas and quotes, read back."""
    path = V.scratch(spark, "quoted")
    docs = V.table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.read_csv_folder(spark, f"{path}/*.csv", "doc_id bigint, lang string, text string", ["doc_id", "lang", "text"])
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("A3_read_wide_panel")
def _(spark, sf):
    path = V.scratch(spark, "wide")
    writers.write_wide(V.bars(spark, sf, "month"), path, "close", width=64)
    wide = readers.read_wide_panel(spark, path, "close", zero_missing=True)
    return wide.select("date", F.col("symbol").cast("bigint").alias("symbol"), "close")


def _matrix(spark, sf):
    """Write monthly closes as a headerless matrix in date order; return (path, dates, tickers)."""
    bars = V.bars(spark, sf, "month")
    path = V.scratch(spark, "matrix")
    writers.write_matrix(bars, path, "close")
    return path, bars.select("date").distinct(), wide.numbered_keys(bars, "symbol").select("symbol", F.col("pos").cast("int").alias("pos"))


@query("A4_read_positional_matrix")
def _(spark, sf):
    path, days, tickers = _matrix(spark, sf)
    return readers.read_positional_matrix(spark, path, align.calendar_positions(days), tickers, "close")


@query("I4_attach_calendar")
def _(spark, sf):
    path, days, tickers = _matrix(spark, sf)
    return readers.attach_calendar(path, days, tickers, "1990-01-01", value="close")


@query("A5_read_sectioned_ohlc")
def _(spark, sf):
    """Four price blocks in one GBK file, each with its heading and two closing notes, read back."""
    bars = V.bars(spark, sf, "month")
    path = V.scratch(spark, "sections")
    writers.write_sectioned_ohlc(bars, path)
    return readers.read_sectioned_ohlc(spark, path).withColumn("symbol", F.col("symbol").cast("bigint"))


@query("A6_read_ticker_list")
def _(spark, sf):
    path = V.scratch(spark, "tickers")
    V.table(spark, sf, "supplier").orderBy("s_suppkey").select("s_name").write.text(path)
    return readers.read_ticker_list(spark, path)


@query("A7_split_table_json")
def _(spark, sf):
    path = V.scratch(spark, "split")
    writers.write_split_table(targets.split_table(V.panel(spark, sf)), path)
    return readers.read_split_table(spark, path)


@query("A8_write_panel")
def _(spark, sf):
    path = V.scratch(spark, "panel")
    writers.write_panel(V.bars(spark, sf), path, "symbol")
    back = spark.read.schema("date date, open double, high double, low double, close double, volume double, "
                             "symbol bigint").parquet(path)
    return back.select("symbol", "date", "open", "high", "low", "close", "volume")


@query("A8_write_panel_by_feature", 4)
def _(spark, sf):
    """A folder per feature, all features, read back."""
    path = V.scratch(spark, "by-feature")
    made = V.stored(spark, sf, "features", lambda: features.compute_features(V.panel(spark, sf)).select("symbol", "date", *features.FEATURES))
    writers.write_features(made, path, features.FEATURES)
    return spark.read.parquet(path).select("date", "symbol", "feature", "value")


@query("A9_write_results")
def _(spark, sf):
    path = V.scratch(spark, "results")
    writers.write_results({"positions": portfolio.positions(V.scores(spark, sf), 10)}, path, "parquet")
    return spark.read.parquet(f"{path}/positions")


# Projections, filters, guards.

@query("B1_slice_dates")
def _(spark, sf):
    closed = align.slice_dates(V.bars(spark, sf), "1996-01-01", "1998-12-28").withColumn("ends", F.lit("closed"))
    half = align.slice_dates(V.bars(spark, sf), "1996-01-01", "1998-12-28", half_open=True).withColumn(
        "ends", F.lit("half_open"))
    return closed.unionByName(half).select("ends", "symbol", "date", "close")


@query("B2_rename_select")
def _(spark, sf):
    return clean.rename_select(V.bars(spark, sf), {"symbol": "code", "date": "day", "close": "price"})


@query("B3_format_symbol")
def _(spark, sf):
    codes = V.table(spark, sf, "part").select(F.col("p_partkey"), (F.col("p_partkey") * 4001).cast("string").alias("code"))
    return clean.with_formatted_symbol(codes, "code")


@query("B4_normalise_ticker")
def _(spark, sf):
    names = V.table(spark, sf, "documents").select("doc_id", F.col("text").alias("ticker"))
    return clean.with_normalised_ticker(names).select("doc_id", F.md5("ticker").alias("ticker_md5"))


@query("B5_post_listing_filter")
def _(spark, sf):
    return clean.post_listing_filter(V.status_bars(spark, sf), V.listings(spark, sf)).select("symbol", "date", "close")


@query("B6_stock_pool_filter")
def _(spark, sf):
    pool = clean.stock_pool_filter(V.status_bars(spark, sf), V.listings(spark, sf), V.constituents(spark, sf))
    return pool.select("symbol", "date", "close", "book_value")


@query("B7_drop_null_and_constant_columns")
def _(spark, sf):
    wide = V.bars(spark, sf).withColumns({
        "empty": F.lit(None).cast("double"), "flat": F.col("volume") * 0 + 7.0, "some": F.when(F.col("volume") > 50, 1.0)})
    columns = ["open", "close", "empty", "flat", "some"]
    return clean.drop_null_and_constant_columns(wide.select("symbol", "date", *columns), columns)


@query("B8_label_mask_fill")
def _(spark, sf):
    rows = V.judged(spark, sf).select("date", "symbol", "pred", "label", (0.5 + F.col("pred")).alias("prob"))
    return clean.label_mask_fill(rows)


@query("B9_nan_to_zero")
def _(spark, sf):
    return clean.zero_missing(V.aligned(spark, sf), ["close", "volume"]).select("symbol", "date", "close", "volume")


@query("B10_inf_to_null")
def _(spark, sf):
    rows = V.bars(spark, sf).select("symbol", "date", F.when(F.col("volume") > 20, float("inf"))
                                    .when(F.col("volume") < 3, float("-inf")).otherwise(F.col("close")).alias("close"))
    return clean.null_infinite(rows, ["close"])


@query("B11_panel_guards")
def _(spark, sf):
    """The suppliers of a large table outnumber its weeks, so the panel is wide."""
    return align.panel_guards(V.labels(spark, sf), "fwd_ret", wide=True)


@query("B12_expand_pct")
def _(spark, sf):
    return reports.expand_pct(nav.performance_metrics(_daily(spark, sf)))


# Joins and alignment.

@query("C1_merge_bars_fundamentals")
def _(spark, sf):
    facts = V.bars(spark, sf, "month").select("symbol", "date", F.col("volume").alias("month_volume"))
    return align.merge_bars_fundamentals(V.bars(spark, sf).select("symbol", "date", "close"), facts)


@query("C2_align_to_master_calendar")
def _(spark, sf):
    return V.aligned(spark, sf)


@query("C3_align_outer")
def _(spark, sf):
    return align.align_outer(V.event_bars(spark, sf), event_dates_fit(spark, sf))


@query("C4_align_intersection")
def _(spark, sf):
    return align.align_intersection(V.bars(spark, sf, "month"), fits(spark, sf)).select("symbol", "date", "close")


@query("C5_asof_prices")
def _(spark, sf):
    events = V.event_bars(spark, sf)
    wanted = align.align_outer(events.select("symbol", "date", "close"), event_dates_fit(spark, sf)).select("symbol", "date")
    return align.asof_prices(wanted, events)


@query("C6_constituent_semi_join")
def _(spark, sf):
    return clean.constituent_semi_join(V.bars(spark, sf), V.constituents(spark, sf)).select("symbol", "date", "close")


@query("C7_attach_cap_and_industry")
def _(spark, sf):
    base = V.factors(spark, sf).select("date", "symbol", "factor")
    caps = V.fundamentals(spark, sf).select("symbol", "date", "cap")
    return align.attach_cap_and_industry(base, caps, V.industries(spark, sf))


@query("C8_walk_forward_subsets")
def _(spark, sf):
    return align.walk_forward_subsets(V.labels(spark, sf), V.spans())


@query("C9_returns_onto_universe")
def _(spark, sf):
    universe = V.aligned(spark, sf).select("symbol", "date")
    returns = clean.simple_return(V.bars(spark, sf)).select("symbol", "date", "ret")
    return align.returns_onto_universe(universe, returns)


@query("C11_combine_nav")
def _(spark, sf):
    spine = nav.benchmark_nav(V.index_close(spark, sf))
    models = _models(spark, sf)
    curves = nav.topk_drift_backtest(models, V.panel(spark, sf), 10, small_dates=fits(spark, sf))
    return nav.combine_nav(spine, curves, ["follow", "reverse"])


# Cleaning.

@query("D1_ffill_limit")
def _(spark, sf):
    return clean.ffill_limit(V.aligned(spark, sf, "month"), n=1)


@query("D2_drop_sparse_symbols")
def _(spark, sf):
    return clean.drop_sparse_symbols(V.filled(spark, sf, n=1)).select("symbol", "date", "close")


@query("D3_ffill_bfill")
def _(spark, sf):
    return clean.ffill_bfill(V.aligned(spark, sf))


@query("D3_ffill")
def _(spark, sf):
    return clean.ffill(V.aligned(spark, sf))


@query("D4_mad_clip")
def _(spark, sf):
    return clean.mad_clip(V.bars(spark, sf), ["close", "volume"]).select("symbol", "date", "close", "volume")


@query("D5_zscore_symbol")
def _(spark, sf):
    return clean.zscore_symbol(V.bars(spark, sf), ["close", "volume"]).select("symbol", "date", "close", "volume")


@query("D6_cap_outliers_xs")
def _(spark, sf):
    rows = V.bars(spark, sf).select("symbol", "date", F.col("volume").alias("factor"))
    return xsection.cap_outliers_xs(rows, small_dates=fits(spark, sf))


@query("D7_drop_warmup")
def _(spark, sf):
    return align.drop_warmup(V.bars(spark, sf), 60, fits(spark, sf)).select("symbol", "date", "close")


@query("D8_standard_process")
def _(spark, sf):
    return clean.standard_process(V.aligned(spark, sf), ["close", "volume"]).select("symbol", "date", "close", "volume")


@query("D9_mask_missing_price")
def _(spark, sf):
    rows = V.aligned(spark, sf).select("symbol", "date", "close", F.col("volume").alias("cap"), F.lit(1.0).alias("factor"))
    return clean.mask_missing_price(rows)


# Rolling features.

def _feature(name: str, columns: list[str], digits: int, make):
    @query(name, digits)
    def run(spark, sf):
        return make(V.panel(spark, sf)).select("symbol", "date", *columns)


def _named(prefix: str) -> list[str]:
    return [c for c in features.FEATURES if c.startswith(prefix)]


_feature("E1_roc", _named("ROC_"), 5, features.roc)
_feature("E2_rsi", _named("RSI_"), 5, features.rsi)
_feature("E3_ema", _named("EMA_"), 4, features.ema)
_feature("E4_macd", ["MACD", "MACD_signal", "MACD_hist"], 4, features.macd)
_feature("E5_bollinger", _named("BB_"), 4, features.bollinger)
_feature("E6_volume_ratio", _named("VOL_ratio_"), 5, features.volume_ratio)
_feature("E7_atr", _named("ATR_"), 4, features.atr)
_feature("E8_obv", ["OBV"], 3, features.obv)
_feature("E9_stochastic", _named("STOCH_"), 4, features.stochastic)
_feature("E10_williams", _named("WILLR_"), 4, features.williams)
_feature("E11_cci", _named("CCI_"), 4, features.cci)
_feature("E12_donchian", _named("DC_"), 4, features.donchian)
_feature("E13_momentum", _named("MOM_"), 4, features.momentum)
_feature("E14_sma", _named("SMA_"), 4, features.sma)
_feature("E15_sma_distance", ["DIST_SMA20", "DIST_SMA50"], 6, features.sma_distance)
_feature("E16_daily_return", ["DAILY_RET"], 6, features.daily_return)
_feature("E17_volume_norm", ["VOL_norm_252"], 6, features.volume_norm)
_feature("E18_high_low_spread", ["HL_SPREAD"], 6, features.high_low_spread)
_feature("E19_close_open_return", ["CO_RET"], 6, features.close_open_return)
_feature("E20_compute_features", features.FEATURES, 4, features.compute_features)


@query("E3_ema_gaps", 4)
def _(spark, sf):
    """EMA over the unfilled calendar: gaps weigh by their length."""
    return features.ema(V.aligned(spark, sf).select("symbol", "date", "close")).drop("close")


@query("E21_build_feature_matrix", 4)
def _(spark, sf):
    return features.build_feature_matrix(V.panel(spark, sf), small_dates=fits(spark, sf))


@query("E22_feature_matrix_long", 4)
def _(spark, sf):
    return features.feature_matrix_long(features.compute_features(V.panel(spark, sf)).select("symbol", "date", *features.FEATURES))


@query("E22_feature_matrix_wide", 4)
def _(spark, sf):
    """Dates x symbols of one feature in blocks of 64 symbols, one row per cell."""
    panel = V.panel(spark, sf)
    symbols = wide.numbered_keys(panel, "symbol", 64)
    blocks = features.feature_matrix_wide(features.rsi(panel), "RSI_14", symbols)
    return blocks.select("date", "block", F.posexplode("values").alias("at", "value"))


@query("E23_lag_ratio_factors", 5)
def _(spark, sf):
    """Sixty lags of six fields, one row per lag."""
    arrays = features.lag_ratio_factors(V.panel(spark, sf))
    fields = ["close", "open", "high", "low", "vwap", "volume"]
    rows = arrays.select("symbol", "date", F.posexplode(F.arrays_zip(*[f"{f}_lags" for f in fields])).alias("lag", "z"))
    return rows.select("symbol", "date", "lag", *[F.col(f"z.{f}_lags").alias(f) for f in fields])


# Cross-section.

@query("F1_cs_zscore")
def _(spark, sf):
    rows = V.bars(spark, sf).select("symbol", "date", "close", "volume", F.lit(3.0).alias("flat"))
    return xsection.cs_zscore(rows, ["close", "volume", "flat"], fits(spark, sf))


@query("F2_cs_standardise")
def _(spark, sf):
    rows = V.bars(spark, sf).select("symbol", "date", "close", "volume", F.lit(3.0).alias("flat"))
    return xsection.cs_standardise(rows, ["close", "volume", "flat"], fits(spark, sf))


@query("F3_log_float_cap")
def _(spark, sf):
    return xsection.log_float_cap(V.fundamentals(spark, sf)).select("symbol", "date", "log_cap")


@query("F4_neutralise_cap_industry", 5)
def _(spark, sf):
    return xsection.neutralise_cap_industry(V.factors(spark, sf), ["factor", "momentum"], small_dates=fits(spark, sf)).select(
        "date", "symbol", "factor", "momentum")


@query("F4_neutralised_on_codes", 5)
def _(spark, sf):
    """The neutralised factors on the whole code list: a row per date and code."""
    out = xsection.neutralise_cap_industry(V.factors(spark, sf), ["factor", "momentum"], small_dates=fits(spark, sf)).select(
        "date", "symbol", "factor", "momentum")
    codes = V.table(spark, sf, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("symbol"))
    return xsection.onto_codes(out, codes, fits(spark, sf))


@query("F5_neutralise_cap")
def _(spark, sf):
    return xsection.neutralise_cap(V.factors(spark, sf), small_dates=fits(spark, sf)).select("date", "symbol", "factor")


@query("F6_factor_preprocess", 5)
def _(spark, sf):
    eves = nav.rebalance_calendar(V.panel(spark, sf)).select(F.col("eve").alias("date"))
    rows = V.stored(spark, sf, "eve-factors", lambda: sizing.join_per_date(
        V.factors(spark, sf).select("date", "symbol", "factor", "close", "cap"), eves, how="left_semi", small_dates=fits(spark, sf)))
    return xsection.factor_preprocess(rows, eves, small_dates=fits(spark, sf), small_groups=V.small_groups(spark, sf)).select("date", "symbol", "factor")


@query("F7_average_rank")
def _(spark, sf):
    rows = V.bars(spark, sf).select("symbol", "date", "volume")
    return xsection.with_average_rank(rows, "volume", "volume_rank")


@query("F8_factor_layers")
def _(spark, sf):
    rows = V.bars(spark, sf).select("symbol", "date", F.col("volume").alias("factor"))
    return xsection.factor_layers(rows, layers=5, small_groups=V.small_groups(spark, sf))


@query("F9_top_k")
def _(spark, sf):
    rows = V.bars(spark, sf).select("symbol", "date", F.col("volume").alias("score"))
    return xsection.top_k(rows, 7)


# Labels, splits, windows.

@query("G1_forward_return")
def _(spark, sf):
    return targets.forward_return(V.bars(spark, sf), small_dates=fits(spark, sf))


@query("G2_trend_indicator")
def _(spark, sf):
    return targets.trend_indicator(V.labels(spark, sf)).select("symbol", "date", "trend")


@query("G3_model_targets", 4)
def _(spark, sf):
    return targets.model_targets(V.labels(spark, sf))


@query("G4_simple_return")
def _(spark, sf):
    return clean.simple_return(V.bars(spark, sf)).select("symbol", "date", "ret")


@query("G5_split_by_position")
def _(spark, sf):
    return targets.split_by_position(V.labels(spark, sf), small_dates=fits(spark, sf)).select("symbol", "date", "split")


@query("G6_split_by_round")
def _(spark, sf):
    return targets.split_by_round(V.labels(spark, sf), small_dates=fits(spark, sf)).select("symbol", "date", "split")


def _windowed(spark, sf) -> DataFrame:
    tagged = targets.split_by_round(V.labels(spark, sf), small_dates=fits(spark, sf))
    return windows.sliding_windows(tagged, ["fwd_ret"])


def _cells(df: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """One row per array element, the element named."""
    def named(part: str, column: str):
        return F.transform(F.col(column), lambda v, i: F.struct(F.lit(part).alias("part"), i.alias("i"), v.alias("v")))

    return df.select(*keys, F.inline(F.flatten(F.array(*[named(p, c) for p, c in arrays.items()]))))


@query("G7_sliding_windows")
def _(spark, sf):
    return _cells(_windowed(spark, sf), ["split", "symbol", "sample"], x="x_fwd_ret", y="y_fwd_ret")


def _model_samples(spark, sf) -> DataFrame:
    return pipeline.model_input(V.panel(spark, sf), small_dates=fits(spark, sf))


def _weighted(column, of=lambda v: v):
    """Sum of an array's elements, each weighted by its place from 1, which shows their order."""
    return F.aggregate(F.transform(column, lambda v, i: of(v) * (i + 1)), F.lit(0.0), lambda a, v: a + v)


@query("G7_model_windows", 3)
def _(spark, sf):
    """Windows of the 71 stacked features: per sample the sums of the past and of the following vectors, weighted by place and by feature."""
    samples = _model_samples(spark, sf).select("split", "symbol", "sample", "as_of", "x_features", "y_features")
    keys = samples.select("split", "symbol", "sample", "as_of").schema

    def sums(windows: pa.ListArray) -> pa.Array:
        vectors = windows.flatten()  # whole vectors without NULLs, as they are stacked
        rows = vectors.flatten().to_numpy().reshape(len(vectors), -1)
        place = np.arange(len(vectors)) - np.repeat(np.asarray(windows.offsets)[:-1] - windows.offsets[0].as_py(), np.diff(windows.offsets)) + 1
        return pa.array(np.add.reduceat(rows @ np.arange(1.0, rows.shape[1] + 1) * place, np.asarray(windows.offsets)[:-1] - windows.offsets[0].as_py()))

    def weighted(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys.names], sums(batch.column("x_features")), sums(batch.column("y_features"))],
                                                 names=[*keys.names, "x", "y"])

    return samples.mapInArrow(weighted, T.StructType([*keys.fields, *[T.StructField(c, DoubleType()) for c in ("x", "y")]]))


@query("G7_indicator_code_windows")
def _(spark, sf):
    """Windows of the indicator and of the calendar codes, per sample their sums weighted by place."""
    names = [f"{side}_{c}" for side in ("x", "y") for c in ("trend", "month_code", "day_code")]
    return _model_samples(spark, sf).select("split", "symbol", "sample", *[_weighted(F.col(c)).alias(c) for c in names])


@query("G8_temporal_codes")
def _(spark, sf):
    coded = windows.temporal_codes(V.bars(spark, sf))
    return coded.select("date", "pos", "month_code", "day_code",
                        (F.array_position("month_hot", 1) - 1).alias("month_slot"),
                        (F.array_position("day_hot", 1) - 1).alias("day_slot"))


@query("G9_wavelet_split")
def _(spark, sf):
    """Both windows, the twenty past values and the two that follow."""
    both = windows.wavelet_split(windows.wavelet_split(_windowed(spark, sf), "x_fwd_ret", 20), "y_fwd_ret", 2)

    def parts(side):
        zipped = F.arrays_zip(F.col(f"{side}_fwd_ret_low").alias("low"), F.col(f"{side}_fwd_ret_high").alias("high"))
        return F.transform(zipped, lambda z, i: F.struct(F.lit(side).alias("part"), i.alias("i"), z["low"].alias("low"), z["high"].alias("high")))

    return both.select("split", "symbol", "sample", F.inline(F.flatten(F.array(parts("x"), parts("y")))))


@query("G10_stack_features", 4)
def _(spark, sf):
    labels = targets.trend_indicator(V.labels(spark, sf))  # joined to the narrow panel; the last date has no label
    made = features.compute_features(V.panel(spark, sf).join(labels, ["symbol", "date"], "left"))
    stacked = windows.stack_features(made.where(F.col("trend").isNotNull()), features.FEATURES)
    return _cells(stacked, ["symbol", "date"], f="features")


@query("G9_model_split")
def _(spark, sf):
    """Wavelet parts of the returns of each model sample, per window their sums weighted by place."""
    names = [f"{side}_fwd_ret_{part}" for side in ("x", "y") for part in ("low", "high")]
    return _model_samples(spark, sf).select("split", "symbol", "sample", "as_of", *[_weighted(F.col(c)).alias(c.replace("_fwd_ret", "")) for c in names])


@query("G10_model_table", 4)
def _(spark, sf):
    """Bars to the tagged model table: clean, features, z-score, labels, split; the 71 values of a row as a sum weighted by place."""
    bars = V.stored(spark, sf, "clean-bars", lambda: clean.ffill_bfill(pipeline.clean_bars(V.bars(spark, sf), small_dates=fits(spark, sf))))
    matrix = V.stored(spark, sf, "labelled-matrix", lambda: pipeline.labelled_matrix(bars, small_dates=fits(spark, sf)))
    table = pipeline.model_table(bars, matrix, small_dates=fits(spark, sf))
    return table.select("symbol", "date", "split", "fwd_ret", "trend", _weighted(F.col("features")).alias("features"))


# Graph.

@query("H1_correlation_matrix")
def _(spark, sf):
    return graph.correlation_matrix(V.labels(spark, sf))


@query("H2_correlation_edges")
def _(spark, sf):
    return graph.correlation_edges(V.labels(spark, sf), threshold=0.1)


@query("H3_correlation_edges_all")
def _(spark, sf):
    return graph.correlations(V.labels(spark, sf), "fwd_ret").where(F.col("weight").isNotNull())


def _links(spark, sf):
    edges = graph.correlation_edges(V.labels(spark, sf), threshold=0.1)
    return edges.select("src", "dst", F.abs("weight").alias("weight")), V.labels(spark, sf).select("symbol").distinct()


@query("H4_normalised_laplacian")
def _(spark, sf):
    return graph.normalised_laplacian(*_links(spark, sf))


def _spectral(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The Laplacian and its four leading eigenpairs."""
    laplacian = V.stored(spark, sf, "laplacian", lambda: graph.normalised_laplacian(*_links(spark, sf)))
    return laplacian, V.stored(spark, sf, "spectral", lambda: graph.spectral_vectors(laplacian, 4))


@query("H5_spectral_vectors", 4)
def _(spark, sf):
    """Four leading eigenpairs; the sign of a vector is free, so squares are shown."""
    pairs = _spectral(spark, sf)[1]
    return pairs.select("symbol", F.posexplode(F.zip_with("vector", "values", lambda v, x: F.struct(
        (v * v).alias("square"), x.alias("value")))).alias("rank", "z")).select("symbol", "rank", "z.square", "z.value")


@query("H5_spectral_residual", 4)
def _(spark, sf):
    """How far L v is from value * v, per symbol and pair."""
    return graph.eigen_residuals(*_spectral(spark, sf)).select("symbol", "rank", F.abs("residual").alias("residual"))


@query("H5_spectral_gram", 4)
def _(spark, sf):
    """Inner products of the eigenvectors, and whether their values fall in size."""
    pairs = _spectral(spark, sf)[1]
    sums = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.col("vector")[i] * F.col("vector")[j]).alias("product"),
                     F.min(F.abs(F.col("values")[i]) >= F.abs(F.col("values")[j])).alias("ordered")) for i in range(4) for j in range(i, 4)]
    return pairs.agg(F.array(*sums).alias("_s")).select(F.inline("_s"))


@query("H6_structural_embedding", 4)
def _(spark, sf):
    """One row per symbol with the length of its vector."""
    edges, nodes = _links(spark, sf)
    out = embedding.structural_embedding(edges, nodes)
    return out.select("symbol", F.size("embedding").alias("dims"),
                      F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("length"))


@query("H6_structural_twins")
def _(spark, sf):
    """The graph beside a copy of itself: a node and its twin have the same surroundings and no path between them, so their vectors
    are nearer than the node's to all others on average. Nodes without edges are zero vectors."""
    edges, nodes = _links(spark, sf)
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    twice = [F.col(c) * 2 + F.col("copy") for c in ("src", "dst", "symbol")]
    out = V.stored(spark, sf, "twins", lambda: embedding.structural_embedding(
        edges.select("*", copies).select(twice[0].alias("src"), twice[1].alias("dst")),
        nodes.select("*", copies).select(twice[2].alias("symbol"))))

    def product(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    size = F.sqrt(product("embedding", "embedding"))
    units = out.select("symbol", "embedding", size.alias("size"), F.transform("embedding", lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("unit"))
    mean = units.where("size > 0").select(F.posexplode("unit")).groupBy("pos").agg(F.avg("col").alias("col")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "col")))["col"]).scalar()  # as long as one vector
    twin = units.where("symbol % 2 = 1").select((F.col("symbol") - 1).alias("symbol"), F.col("unit").alias("other"))
    return (units.where("symbol % 2 = 0").join(twin, "symbol").withColumn("mean", mean)
            .select((F.col("symbol") / 2).cast("bigint").alias("symbol"), F.size("embedding").alias("dims"), (F.col("size") > 0).alias("linked"),
                    F.coalesce(product("unit", "other") > product("unit", "mean"), F.lit(False)).alias("twin_near")))


# Logit cells.

@query("I1_parse_logits")
def _(spark, sf):
    cells = V.logit_cells(spark, sf)
    both = [cells.select("date", "symbol", F.lit(n).alias("pattern"), L.parse_logits("cell", p).alias("logits"))
            for n, p in (("evaluate", L.PATTERN_EVALUATE), ("results", L.PATTERN_RESULTS))]
    return both[0].unionByName(both[1]).select("date", "symbol", "pattern", F.size("logits").alias("n"),
                                               F.get("logits", F.lit(0)).alias("first"), F.get("logits", F.lit(1)).alias("second"))


@query("I2_argmax_class")
def _(spark, sf):
    return evaluate.with_class(evaluate.with_parsed_logits(V.logit_cells(spark, sf))).select("date", "symbol", "pred_class")


@query("I3_softmax_prob")
def _(spark, sf):
    return evaluate.with_softmax(evaluate.with_parsed_logits(V.logit_cells(spark, sf))).select("date", "symbol", "prob")


# Evaluation.

@query("J1_ic_spearman_by_day")
def _(spark, sf):
    return evaluate.ic_spearman_by_day(V.judged(spark, sf))


@query("J2_ic_pearson_by_day")
def _(spark, sf):
    return evaluate.ic_pearson_by_day(V.judged(spark, sf))


@query("J3_ic_summary")
def _(spark, sf):
    return evaluate.ic_summary(evaluate.ic_pearson_by_day(V.judged(spark, sf)), "IC_pearson")


@query("J4_mae_rmse")
def _(spark, sf):
    return evaluate.mae_rmse(V.judged(spark, sf))


@query("J5_accuracy")
def _(spark, sf):
    return evaluate.accuracy(V.judged(spark, sf))


@query("J6_f1_macro")
def _(spark, sf):
    return evaluate.f1_macro(V.judged(spark, sf))


def _steps(spark, sf) -> DataFrame:
    """Two horizon steps: the label of the date and of the next one."""
    w = Window.partitionBy("symbol").orderBy("date")
    wide = V.judged(spark, sf).withColumn("later", F.lead("label").over(w))
    steps = wide.select("pred", "pred_class", F.posexplode(F.array("label", "later")).alias("step", "label"))
    return steps.where(F.col("label").isNotNull()).withColumn("label_class", (F.col("label") > 0).cast("int"))


@query("J7_masked_step_metrics")
def _(spark, sf):
    return evaluate.masked_step_metrics(_steps(spark, sf))


@query("J7_mean_step_metrics")
def _(spark, sf):
    return evaluate.mean_step_metrics(evaluate.masked_step_metrics(_steps(spark, sf)))


@query("J8_cross_entropy")
def _(spark, sf):
    cells = evaluate.with_parsed_logits(V.logit_cells(spark, sf))
    return evaluate.cross_entropy(cells.join(V.judged(spark, sf).select("date", "symbol", "label_class"), ["date", "symbol"]))


@query("J9_evaluation_summary")
def _(spark, sf):
    return evaluate.evaluation_summary(V.judged(spark, sf), small_groups=V.small_groups(spark, sf))


@query("J9_ic_by_day")
def _(spark, sf):
    return evaluate.ic_by_day(V.judged(spark, sf), small_groups=V.small_groups(spark, sf))


# Portfolio and backtest.

@query("K1_equal_weights")
def _(spark, sf):
    return portfolio.dense_weights(V.scores(spark, sf), 10)


@query("K2_price_returns")
def _(spark, sf):
    return portfolio.price_returns(clean.zero_missing(V.aligned(spark, sf), ["close"]))


@query("K3_turnover")
def _(spark, sf):
    s = V.scores(spark, sf)
    return portfolio.turnover(portfolio.equal_weights(s, 10), s, fits(spark, sf))


@query("K4_daily_net_return")
def _(spark, sf):
    s = V.scores(spark, sf)
    return portfolio.daily_net_return(portfolio.equal_weights(s, 10), portfolio.price_returns(V.panel(spark, sf)), s,
                                      small_dates=fits(spark, sf))


@query("K5_positions")
def _(spark, sf):
    return portfolio.positions(V.scores(spark, sf), 10)


def _daily(spark, sf) -> DataFrame:
    return portfolio.backtest_daily(V.scores(spark, sf), V.panel(spark, sf), V.index_close(spark, sf), 10,
                                    small_dates=fits(spark, sf))


@query("K6_backtest_daily")
def _(spark, sf):
    return _daily(spark, sf)


@query("K7_performance_metrics")
def _(spark, sf):
    return nav.performance_metrics(_daily(spark, sf))


@query("K8_alpha_beta")
def _(spark, sf):
    return nav.alpha_beta(_daily(spark, sf))


@query("K9_equity_curve")
def _(spark, sf):
    return nav.equity_curve(_daily(spark, sf))


@query("K9_equity_curve_shifted")
def _(spark, sf):
    return nav.equity_curve(_daily(spark, sf), shifted=True)


@query("K10_rebalance_calendar")
def _(spark, sf):
    return nav.rebalance_calendar(V.panel(spark, sf))


def _layers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Five layers by score on the eve of each month, traded on its first date."""
    cal = nav.rebalance_calendar(V.panel(spark, sf))
    eves = cal.select(F.col("eve").alias("date"), F.col("date").alias("trade"))
    signal = sizing.join_per_date(V.scores(spark, sf), eves, small_dates=fits(spark, sf)).select(
        F.col("trade").alias("date"), "symbol", F.col("score").alias("factor"))
    return nav.period_backtest(xsection.factor_layers(signal, layers=5), V.panel(spark, sf), small_dates=fits(spark, sf))


@query("K11_period_backtest")
def _(spark, sf):
    return _layers(spark, sf)[0]


@query("K11_period_turnover")
def _(spark, sf):
    return _layers(spark, sf)[1]


def _models(spark, sf) -> DataFrame:
    s = V.scores(spark, sf)
    return s.select("date", "symbol", F.inline(F.array(
        F.struct(F.lit("follow").alias("strategy"), F.col("score").alias("score")),
        F.struct(F.lit("reverse").alias("strategy"), (-F.col("score")).alias("score")))))


@query("K12_topk_drift_backtest")
def _(spark, sf):
    return nav.topk_drift_backtest(_models(spark, sf), V.panel(spark, sf), 10, small_dates=fits(spark, sf))


def _model_metrics(spark, sf) -> DataFrame:
    return nav.nav_metrics(nav.topk_drift_backtest(_models(spark, sf), V.panel(spark, sf), 10, small_dates=fits(spark, sf)))


@query("K13_nav_metrics")
def _(spark, sf):
    return _model_metrics(spark, sf)


@query("K14_best_model_by_sharpe")
def _(spark, sf):
    return nav.best_model_by_sharpe(_model_metrics(spark, sf))


@query("K15_benchmark_nav")
def _(spark, sf):
    return nav.benchmark_nav(V.index_close(spark, sf))


@query("K15_equal_weight_benchmark")
def _(spark, sf):
    """Mean return per date, for panels without an index series."""
    return portfolio.benchmark_returns(V.panel(spark, sf))


@query("K16_scoring_calendar")
def _(spark, sf):
    return align.scoring_calendar(V.labels(spark, sf), 30, 200, "2001-01-01", "2001-06-30")


@query("K17_layer_backtest_panel")
def _(spark, sf):
    return nav.layer_backtest_panel(*_layers(spark, sf), layers=5)


# Reports.

@query("L1_latest_holdings")
def _(spark, sf):
    return reports.latest_holdings(portfolio.positions(V.scores(spark, sf), 10))


@query("L2_held_tickers")
def _(spark, sf):
    return reports.held_tickers(portfolio.positions(V.scores(spark, sf), 10))


@query("L3_heatmap_scores")
def _(spark, sf):
    s = V.scores(spark, sf)
    return reports.heatmap_scores(s, portfolio.positions(s, 10), 10)


@query("L4_kpi_row")
def _(spark, sf):
    return reports.kpi_row(nav.performance_metrics(_daily(spark, sf)))


@query("L5_equity_window")
def _(spark, sf):
    return reports.equity_window(_daily(spark, sf), "1997-01-01", "1999-12-31")


# Scoring.

@query("M1_score_windows")
def _(spark, sf):
    """A stand-in model: mean of the window per horizon step, all symbols of a date in one call."""
    def predict(frame):
        import numpy as np
        import pandas as pd

        mean = np.stack(frame["x_fwd_ret"].to_numpy()).mean(axis=1)
        parts = [pd.DataFrame({"symbol": frame["symbol"], "as_of": frame["as_of"], "step": step, "up": mean > 0, "pred": mean})
                 for step in (0, 1)]
        return pd.concat(parts)

    table = _windowed(spark, sf).select("split", "symbol", "as_of", "x_fwd_ret")
    scored = scoring.score_windows(table, predict, "symbol bigint, as_of date, step int, up boolean, pred double", across="as_of")
    return scoring.last_step(scored)


_tree_rows_of: dict[str, DataFrame] = {}


def _tree_rows(spark, sf) -> DataFrame:
    """The narrow panel with label and split, in buckets of the symbol: the trees read their table many times, and no row travels again."""
    if sf not in _tree_rows_of:
        tagged = targets.split_by_position(V.panel(spark, sf), small_dates=fits(spark, sf))
        _tree_rows_of[sf] = in_buckets(tagged.join(V.labels(spark, sf), ["symbol", "date"], "left"), "symbol")
    return _tree_rows_of[sf]


def _tree_table(spark, sf) -> DataFrame:
    """Features with label and split, made anew from the narrow rows at each reading: stored, they would take the disk of 71 numbers a row."""
    base = features.compute_features(_tree_rows(spark, sf), placed=True)
    labelled = base.where(F.col("fwd_ret").isNotNull())  # a label is never NULL: the last date has none
    return labelled.select("symbol", "date", "split", "fwd_ret", *features.FEATURES)


@query("M2_boosted_tree_scores")
def _(spark, sf):
    return scoring.boosted_tree_scores(_tree_table(spark, sf), features.FEATURES)


@query("M2_boosted_tree_expression")
def _(spark, sf):
    """The fitted trees as rows, scored as one column expression over the test rows: the same scores as the model gives."""
    table = _tree_table(spark, sf)
    model = scoring.fit_boosted_trees(table, features.FEATURES)
    test = table.where(F.col("split") == "test")
    by_model = model.transform(scoring._assembled(test, features.FEATURES))
    rows = scoring.tree_rows(model, features.FEATURES)
    return by_model.select("symbol", "date", (F.abs(F.col("score") - scoring.tree_score(rows)) < 1e-9).alias("same"))


@query("M2_boosted_tree_error")
def _(spark, sf):
    """Squared error over all test rows against that of the mean label of the train rows."""
    table = _tree_table(spark, sf)
    rows = scoring.tree_rows(scoring.fit_boosted_trees(table, features.FEATURES), features.FEATURES)
    mean = _tree_rows(spark, sf).where((F.col("split") == "train") & F.col("fwd_ret").isNotNull()).agg(F.avg("fwd_ret")).scalar()
    test = table.where(F.col("split") == "test").select("fwd_ret", scoring.tree_score(rows).alias("score"))
    errors = [F.avg((F.col("fwd_ret") - x) * (F.col("fwd_ret") - x)) for x in (F.col("score"), mean)]
    return test.agg(F.count("*").alias("n"), (errors[0] < errors[1]).alias("better"))


@query("M3_pivot_scores")
def _(spark, sf):
    """Symbols x dates and back, in blocks of 100 dates."""
    s = V.scores(spark, sf).withColumn("day", F.col("date").cast("string"))
    days = wide.numbered_keys(s, "day", 100)
    return wide.from_blocks(wide.to_blocks(s, "score", days, "symbol", "day"), days, "score", "symbol", "day")


@query("M4_pivot_prices")
def _(spark, sf):
    """Dates x symbols and back, in blocks of 64 symbols; missing prices stay NULL."""
    bars = V.bars(spark, sf).select("date", F.col("symbol").cast("string").alias("symbol"), "close")
    symbols = wide.numbered_keys(bars, "symbol", 64)
    return wide.from_blocks(wide.to_blocks(bars, "close", symbols), symbols, "close")


@query("entry_top_k_performance")
def _(spark, sf):
    """Bars to summary: clean, score, pick ten, charge costs, measure."""
    bars = V.bars(spark, sf)
    report = pipeline.score_report(V.scores(spark, sf), clean.ffill_bfill(pipeline.clean_bars(bars, small_dates=fits(spark, sf))),
                                   V.index_close(spark, sf), small_dates=fits(spark, sf))
    return report["summary"]
