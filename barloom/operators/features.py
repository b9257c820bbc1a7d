"""Rolling technical features per symbol in date order.

Each function adds columns to (symbol, date, open, high, low, close, volume). All frames share one partitioning and
one order, so any combination costs a single exchange by symbol.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.expr import ratio
from barloom.functions.frames import forward_fill, lagged, to_date, trailing
from barloom.operators import histories
from barloom.operators.align import calendar_positions, common_dates
from barloom.operators.clean import PRICE_FIELDS
from barloom.operators.ewm import Ewm, ewm, span_alpha
from barloom.operators.sizing import join_per_date
from barloom.operators.wide import to_blocks

# Window lengths of the feature set.
ROC_WINDOWS = (3, 5, 10, 14, 20, 60)
RSI_WINDOWS = (3, 5, 10, 14, 20, 60)
EMA_SPANS = (5, 10, 20, 50)
MACD_SPANS = (12, 26, 9)
BB_WINDOWS = (5, 10, 20, 60)
VOL_WINDOWS = (3, 5, 10, 14, 20, 60)
ATR_WINDOWS = (5, 10, 14, 20)
STOCH_WINDOWS = (5, 14)
WILLR_WINDOWS = (14, 20)
CCI_WINDOWS = (14, 20)
DC_WINDOWS = (20, 60)
MOM_WINDOWS = (5, 10, 20)
SMA_WINDOWS = (5, 10, 20, 50)
DIST_WINDOWS = (20, 50)
VOL_NORM_WINDOW = 252
FLAT = 1e-8

FEATURES = (
    [f"ROC_{w}" for w in ROC_WINDOWS] + [f"RSI_{w}" for w in RSI_WINDOWS] + ["MACD", "MACD_signal", "MACD_hist"]
    + [f"BB_{p}_{w}" for w in BB_WINDOWS for p in ("upper", "lower", "width")]
    + [f"VOL_ratio_{w}" for w in VOL_WINDOWS] + [f"ATR_{w}" for w in ATR_WINDOWS] + ["OBV"]
    + [f"STOCH_{p}_{w}" for w in STOCH_WINDOWS for p in ("K", "D")] + [f"WILLR_{w}" for w in WILLR_WINDOWS]
    + [f"CCI_{w}" for w in CCI_WINDOWS] + [f"DC_{p}_{w}" for w in DC_WINDOWS for p in ("upper", "lower", "width")]
    + [f"MOM_{w}" for w in MOM_WINDOWS] + [f"EMA_{w}" for w in EMA_SPANS] + [f"SMA_{w}" for w in SMA_WINDOWS]
    + [f"DIST_SMA{w}" for w in DIST_WINDOWS] + ["DAILY_RET", f"VOL_norm_{VOL_NORM_WINDOW}", "HL_SPREAD", "CO_RET"])


HL = (("max", "high"), ("min", "low"))
WALKED = {"sd": F.stddev_samp, "max": F.max, "min": F.min}
JOINED = {"max": F.greatest, "min": F.least}


def _stat(agg: str, x: str, k: int) -> Column:
    """Trailing statistic over k rows, made by ``_with_stats``."""
    return F.col(f"_sum_{x}_{k}") / k if agg == "avg" else F.col(f"_{agg}_{x}_{k}")


def _with_stats(df: DataFrame, wanted: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Add the trailing statistics the table does not have yet, NULL until k values are present.

    Counts and sums over k rows are differences of running ones. An extreme or a deviation walks the frame of the shortest window only;
    a longer one is put together from that frame's values some rows ago, so its cost hardly grows with k. Deviations are not differences
    of running squares, which lose digits where prices moved far from their first level. Families that share a statistic (SMA and
    bands, channels and oscillators) find it there.
    """
    wanted = list(dict.fromkeys(("sum" if a == "avg" else a, x, k) for a, x, k in wanted))
    missing = [(a, x, k) for a, x, k in wanted if f"_{a}_{x}_{k}" not in df.columns]
    base = {(a, x): min(k for b, y, k in missing if (b, y) == (a, x)) for a, x, _ in missing if a != "sum"}
    running = {f"_n_{x}": F.count(x).over(to_date()) for _, x, _ in missing} | {f"_s_{x}": F.sum(x).over(to_date()) for a, x, _ in missing if a == "sum"}
    for (a, x), b in base.items():
        parts = {"mean": F.avg, "var": F.var_pop} if a == "sd" else {a: WALKED[a]}
        running |= {f"_part_{p}_{x}_{b}": made(x).over(trailing(b)) for p, made in parts.items()}
    running = {n: c for n, c in running.items() if n not in df.columns}
    df = df.withColumns(running) if running else df

    ago: dict[str, Column] = {}  # each earlier value once, as a column: a repeated window expression would be worked out each time

    def before(name: str, rows: int) -> Column:
        if rows:
            ago[f"_ago{rows}{name}"] = lagged(name, rows)
        return F.col(f"_ago{rows}{name}" if rows else name)

    def over(total: str, k: int) -> Column:
        return F.col(total) - F.coalesce(before(total, k), F.lit(0))

    means, made = {}, {}
    for a, x, k in missing:
        b, name = base.get((a, x), k), f"_{a}_{x}_{k}"
        if a == "sum":
            value = over(f"_s_{x}", k)
        elif a in JOINED:
            part = f"_part_{a}_{x}_{b}"
            value = F.col(part) if k == b else JOINED[a](*[before(part, at) for at in (*range(0, k - b, b), k - b)])
        elif b > 1 and k % b == 0:  # from the means and variances of the k / b short frames
            mean, var = ([before(f"_part_{p}_{x}_{b}", at) for at in range(0, k, b)] for p in ("mean", "var"))
            means[f"_mean_{x}_{k}"] = _total(mean) / len(mean)
            off = [m - F.col(f"_mean_{x}_{k}") for m in mean]
            value = F.sqrt(b * _total([v + d * d for v, d in zip(var, off)]) / (k - 1))
        else:
            ago[f"_walked{name}"] = WALKED[a](x).over(trailing(k))
            value = F.col(f"_walked{name}")
        made[name] = F.when(over(f"_n_{x}", k) == k, value)
    for layer in (ago, means):
        df = df.withColumns(layer) if layer else df
    return df.withColumns(made).drop(*ago, *means) if made else df


def _total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def roc(df: DataFrame, windows: Sequence[int] = ROC_WINDOWS) -> DataFrame:
    """Percent change over w rows of the forward-filled close."""
    return _added(df, df.withColumn("_filled", forward_fill("close")), _roc(windows))


def _roc(windows: Sequence[int]) -> dict[str, Column]:
    return {f"ROC_{w}": (ratio("_filled", lagged("_filled", w)) - 1) * 100 for w in windows}


def _moves(df: DataFrame) -> DataFrame:
    change = F.col("close") - lagged("close")
    return df.withColumns({"_gain": F.greatest(change, change * 0), "_loss": F.greatest(-change, change * 0)})


def _rsi_series(windows: Sequence[int]) -> list[Ewm]:
    return [Ewm(f"_{side}_{w}", f"_{side}", 1.0 / w, w) for w in windows for side in ("gain", "loss")]


def _rsi(w: int) -> Column:
    loss = F.when(F.col(f"_loss_{w}") >= FLAT, F.col(f"_loss_{w}")).otherwise(FLAT)
    return 100 - 100 / (1 + F.col(f"_gain_{w}") / loss)


def rsi(df: DataFrame, windows: Sequence[int] = RSI_WINDOWS) -> DataFrame:
    """Relative strength with Wilder smoothing; first value at row w."""
    smooth = ewm(_moves(df), *_rsi_series(windows))
    return smooth.select(*df.columns, *[_rsi(w).alias(f"RSI_{w}") for w in windows])


def ema(df: DataFrame, spans: Sequence[int] = EMA_SPANS, source: str = "close") -> DataFrame:
    return ewm(df, *[Ewm(f"EMA_{s}", source, span_alpha(s)) for s in spans])


def macd(df: DataFrame, spans: tuple[int, int, int] = MACD_SPANS) -> DataFrame:
    """Difference of two EMAs, its own EMA, and the gap between them."""
    fast, slow, signal = spans
    out = ewm(df, *_macd_series(fast, slow, signal)).withColumn("MACD", F.col("_fast") - F.col("_slow"))
    return out.select(*df.columns, "MACD", "MACD_signal", (F.col("MACD") - F.col("MACD_signal")).alias("MACD_hist"))


def _macd_series(fast: int, slow: int, signal: int) -> list[Ewm]:
    return [Ewm("_fast", "close", span_alpha(fast)), Ewm("_slow", "close", span_alpha(slow)),
            Ewm("MACD_signal", ("_fast", "_slow"), span_alpha(signal))]


def _bollinger_stats(windows):
    return [(a, "close", w) for w in windows for a in ("avg", "sd")]


def bollinger(df: DataFrame, windows: Sequence[int] = BB_WINDOWS, width: float = 2.0) -> DataFrame:
    return _added(df, _with_stats(df, _bollinger_stats(windows)), _bollinger(windows, width))


def _bollinger(windows: Sequence[int], width: float = 2.0) -> dict[str, Column]:
    made = {}
    for w in windows:
        mid, reach = _stat("avg", "close", w), width * _stat("sd", "close", w)
        made |= {f"BB_upper_{w}": mid + reach, f"BB_lower_{w}": mid - reach, f"BB_width_{w}": (mid + reach) - (mid - reach)}
    return made


def _added(df: DataFrame, worked: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The columns of ``df`` and the made ones; helper columns already in ``df`` stay for the next family."""
    return worked.select(*df.columns, *[c.alias(n) for n, c in made.items()])


def _volume_stats(windows):
    return [("avg", "volume", w) for w in windows]


def volume_ratio(df: DataFrame, windows: Sequence[int] = VOL_WINDOWS) -> DataFrame:
    return _added(df, _with_stats(df, _volume_stats(windows)), _volume_ratio(windows))


def _volume_ratio(windows: Sequence[int], name: str = "VOL_ratio") -> dict[str, Column]:
    return {f"{name}_{w}": ratio("volume", _stat("avg", "volume", w)) for w in windows}


def _range() -> Column:
    before = lagged("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _atr_stats(windows):
    return [("avg", "_range", w) for w in windows]


def atr(df: DataFrame, windows: Sequence[int] = ATR_WINDOWS) -> DataFrame:
    """Mean true range; missing parts of the range are skipped."""
    return _added(df, _with_stats(df.withColumn("_range", _range()), _atr_stats(windows)), _atr(windows))


def _atr(windows: Sequence[int]) -> dict[str, Column]:
    return {f"ATR_{w}": _stat("avg", "_range", w) for w in windows}


def obv(df: DataFrame) -> DataFrame:
    """Running sum of volume signed by the close change; an unknown change counts 0, a missing volume leaves NULL."""
    return _added(df, df.withColumn("_signed", _signed()), _obv())


def _signed() -> Column:
    return F.coalesce(F.signum(F.col("close") - lagged("close")), F.lit(0.0)) * F.col("volume")


def _obv() -> dict[str, Column]:
    return {"OBV": F.when(F.col("_signed").isNotNull(), F.sum("_signed").over(to_date()))}


def _extremes(windows):
    return [(a, x, w) for w in windows for a, x in HL]


def stochastic(df: DataFrame, windows: Sequence[int] = STOCH_WINDOWS, smooth: int = 3) -> DataFrame:
    return _added(df, _with_stats(df, _extremes(windows)), _stoch_k(windows)).withColumns(_stoch_d(windows, smooth))


def _stoch_k(windows: Sequence[int]) -> dict[str, Column]:
    return {f"STOCH_K_{w}": 100 * ratio(F.col("close") - _stat("min", "low", w), _stat("max", "high", w) - _stat("min", "low", w)) for w in windows}


def _stoch_d(windows: Sequence[int], smooth: int = 3) -> dict[str, Column]:
    """Mean of the last values of K; NULL while one is missing."""
    return {f"STOCH_D_{w}": reduce(lambda a, b: a + b, [lagged(f"STOCH_K_{w}", i) for i in range(smooth)]) / smooth for w in windows}


def williams(df: DataFrame, windows: Sequence[int] = WILLR_WINDOWS) -> DataFrame:
    return _added(df, _with_stats(df, _extremes(windows)), _williams(windows))


def _williams(windows: Sequence[int]) -> dict[str, Column]:
    return {f"WILLR_{w}": -100 * ratio(
        _stat("max", "high", w) - F.col("close"), _stat("max", "high", w) - _stat("min", "low", w)) for w in windows}


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def _typical_past(windows: Sequence[int]) -> dict[str, Column]:
    return {f"_past{i}": lagged("_typical", i) for i in range(max(windows))}


def _cci_stats(windows):
    return [("avg", "_typical", w) for w in windows]


def cci(df: DataFrame, windows: Sequence[int] = CCI_WINDOWS) -> DataFrame:
    """Distance of the typical price from its mean in mean absolute deviations of that window."""
    worked = df.withColumn("_typical", _typical()).withColumns(_typical_past(windows))
    return _added(df, _with_stats(worked, _cci_stats(windows)), _cci(windows))


def _cci(windows: Sequence[int]) -> dict[str, Column]:
    made = {}
    for w in windows:
        mean = _stat("avg", "_typical", w)
        # a fold over an array: written out, the sums make a method too long for the JVM to compile
        spread = F.aggregate(F.array(*[F.col(f"_past{i}") for i in range(w)]), F.lit(0.0), lambda total, x: total + F.abs(x - mean)) / w
        made[f"CCI_{w}"] = F.when(mean.isNotNull(), (F.col("_typical") - mean)
                                  / (0.015 * F.greatest(spread, F.lit(FLAT))))
    return made


def donchian(df: DataFrame, windows: Sequence[int] = DC_WINDOWS) -> DataFrame:
    return _added(df, _with_stats(df, _extremes(windows)), _donchian(windows))


def _donchian(windows: Sequence[int]) -> dict[str, Column]:
    made = {}
    for w in windows:
        high, low = _stat("max", "high", w), _stat("min", "low", w)
        made |= {f"DC_upper_{w}": high, f"DC_lower_{w}": low, f"DC_width_{w}": high - low}
    return made


def momentum(df: DataFrame, windows: Sequence[int] = MOM_WINDOWS) -> DataFrame:
    return df.withColumns(_momentum(windows))


def _momentum(windows: Sequence[int]) -> dict[str, Column]:
    return {f"MOM_{w}": F.col("close") - lagged("close", w) for w in windows}


def sma(df: DataFrame, windows: Sequence[int] = SMA_WINDOWS) -> DataFrame:
    return _added(df, _with_stats(df, [("avg", "close", w) for w in windows]), _sma(windows))


def _sma(windows: Sequence[int]) -> dict[str, Column]:
    return {f"SMA_{w}": _stat("avg", "close", w) for w in windows}


def sma_distance(df: DataFrame, windows: Sequence[int] = DIST_WINDOWS) -> DataFrame:
    return _added(df, _with_stats(df, [("avg", "close", w) for w in windows]), _sma_distance(windows))


def _sma_distance(windows: Sequence[int]) -> dict[str, Column]:
    return {f"DIST_SMA{w}": ratio(F.col("close") - _stat("avg", "close", w), _stat("avg", "close", w)) for w in windows}


def daily_return(df: DataFrame) -> DataFrame:
    return df.withColumns(_daily_return())


def _daily_return() -> dict[str, Column]:
    return {"DAILY_RET": ratio("close", lagged("close")) - 1}


def volume_norm(df: DataFrame, window: int = VOL_NORM_WINDOW) -> DataFrame:
    return _added(df, _with_stats(df, _volume_stats([window])), _volume_ratio([window], "VOL_norm"))


def high_low_spread(df: DataFrame) -> DataFrame:
    return df.withColumns(_day_shape(("HL_SPREAD",)))


def close_open_return(df: DataFrame) -> DataFrame:
    return df.withColumns(_day_shape(("CO_RET",)))


def _day_shape(names: Sequence[str] = ("HL_SPREAD", "CO_RET")) -> dict[str, Column]:
    made = {"HL_SPREAD": ratio(F.col("high") - F.col("low"), "close"), "CO_RET": ratio(F.col("close") - F.col("open"), "open")}
    return {n: made[n] for n in names}


def compute_features(bars: DataFrame, filled: bool = False, placed: bool = False) -> DataFrame:
    """All 69 columns, warm-up NULLs kept; with ``filled`` each is carried forward per symbol, then its first value back.

    The narrow bars are exchanged by symbol, once, to a fixed number of tasks, since rows grow to 69 columns there; ``placed`` says that
    they lie by symbol already. Windows walk the shortest frames only; all families are then made together over arrays of whole histories
    (``histories``), since hundreds of window columns would copy each row many times. Rows leave symbol by symbol in date order, no longer
    known to Spark as lying so. A NaN or an undefined difference of infinities is missing.
    """
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (bars if placed else bars.repartition(tasks, "symbol")).withColumns(_short_frames())
    return histories.by_history(rows, bars.columns, FEATURES, _feature_arrays, [*PRICE_FIELDS, *_short_frames()], filled)


def _short_frames() -> dict[str, Column]:
    """Statistics of the shortest frames, NULL until every row of the frame has a value; longer ones are put together from them."""
    b, f = min(BB_WINDOWS), min(*STOCH_WINDOWS, *WILLR_WINDOWS, *DC_WINDOWS)
    made = {"_mean": ("close", b, F.avg), "_var": ("close", b, F.var_pop), "_top": ("high", f, F.max), "_bottom": ("low", f, F.min)}
    return {name: F.when(F.count(x).over(trailing(k)) == k, stat(x).over(trailing(k))) for name, (x, k, stat) in made.items()}


def _feature_arrays(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The features by name from arrays of the price fields and ``_short_frames``."""
    first, high, low, close, volume = (x[f] for f in PRICE_FIELDS)
    before, ratio = histories.earlier(close), histories.ratio
    change, known = close - before, histories.forward(close)
    moves = [np.maximum(change, change * 0), np.maximum(-change, change * 0)]
    smooth = histories.smoothed([(m, 1.0 / w, w) for w in RSI_WINDOWS for m in moves]
                                + [(close, span_alpha(s), 1) for s in (*EMA_SPANS, *MACD_SPANS[:2])])
    sums = {n: histories.running(v) for n, v in (("close", close), ("volume", volume))}
    made = {f"ROC_{w}": (ratio(known, histories.earlier(known, w)) - 1) * 100 for w in ROC_WINDOWS}
    for w, gain, loss in zip(RSI_WINDOWS, smooth[0::2], smooth[1::2]):
        made[f"RSI_{w}"] = 100 - 100 / (1 + gain / np.where(loss >= FLAT, loss, FLAT))
    smooth = smooth[2 * len(RSI_WINDOWS):]
    made |= {f"EMA_{s}": mean for s, mean in zip(EMA_SPANS, smooth)}
    made["MACD"] = smooth[-2] - smooth[-1]
    made["MACD_signal"] = histories.smoothed([(made["MACD"], span_alpha(MACD_SPANS[2]), 1)])[0]
    made["MACD_hist"] = made["MACD"] - made["MACD_signal"]
    for w in BB_WINDOWS:
        mid, reach = histories.mean(sums["close"], w), 2.0 * histories.deviation(x["_mean"], x["_var"], min(BB_WINDOWS), w)
        made |= {f"BB_upper_{w}": mid + reach, f"BB_lower_{w}": mid - reach, f"BB_width_{w}": (mid + reach) - (mid - reach)}
    made |= {f"VOL_ratio_{w}": ratio(volume, histories.mean(sums["volume"], w)) for w in VOL_WINDOWS}
    made[f"VOL_norm_{VOL_NORM_WINDOW}"] = ratio(volume, histories.mean(sums["volume"], VOL_NORM_WINDOW))
    true_range = histories.running(np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before)))
    made |= {f"ATR_{w}": histories.mean(true_range, w) for w in ATR_WINDOWS}
    signed = np.nan_to_num(np.sign(change)) * volume
    made["OBV"] = np.where(np.isnan(signed), np.nan, histories.running(signed)[0])
    frames = sorted({*STOCH_WINDOWS, *WILLR_WINDOWS, *DC_WINDOWS})
    top, bottom = ({w: histories.extreme(pick, x[v], frames[0], w) for w in frames} for pick, v in ((np.maximum, "_top"), (np.minimum, "_bottom")))
    for w in STOCH_WINDOWS:
        k = made[f"STOCH_K_{w}"] = 100 * ratio(close - bottom[w], top[w] - bottom[w])
        made[f"STOCH_D_{w}"] = (k + histories.earlier(k) + histories.earlier(k, 2)) / 3
    made |= {f"WILLR_{w}": -100 * ratio(top[w] - close, top[w] - bottom[w]) for w in WILLR_WINDOWS}
    typical = (high + low + close) / 3
    past, level = [histories.earlier(typical, i) for i in range(max(CCI_WINDOWS))], histories.running(typical)
    for w in CCI_WINDOWS:
        mid = histories.mean(level, w)
        made[f"CCI_{w}"] = (typical - mid) / (0.015 * np.maximum(sum(np.abs(p - mid) for p in past[:w]) / w, FLAT))
    for w in DC_WINDOWS:
        made |= {f"DC_upper_{w}": top[w], f"DC_lower_{w}": bottom[w], f"DC_width_{w}": top[w] - bottom[w]}
    made |= {f"MOM_{w}": close - histories.earlier(close, w) for w in MOM_WINDOWS}
    made |= {f"SMA_{w}": histories.mean(sums["close"], w) for w in SMA_WINDOWS}
    made |= {f"DIST_SMA{w}": ratio(close - made[f"SMA_{w}"], made[f"SMA_{w}"]) for w in DIST_WINDOWS}
    return made | {"DAILY_RET": ratio(close, before) - 1, "HL_SPREAD": ratio(high - low, close), "CO_RET": ratio(close - first, first)}


def build_feature_matrix(bars: DataFrame, warmup: int = 60, small_dates: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Features on gap-filled bars, filled per symbol, on the dates all symbols share, warm-up dropped.

    The backward fill carries the first full VOL_norm_252 back over earlier rows, as the pipeline defines it. Columns of ``bars`` named in
    ``keep`` go along: what belongs to a row joins the narrow bars, not the wide result.
    """
    table = compute_features(bars, filled=True).select("symbol", "date", *keep, *FEATURES)
    # Features keep the keys of the bars, so the dates come from the bars and the features are computed once.
    kept = calendar_positions(common_dates(bars.select("symbol", "date"))).where(F.col("pos") >= warmup).select("date")
    return join_per_date(table, kept, how="left_semi", small_dates=small_dates)


def feature_matrix_long(table: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """One row per (date, symbol, feature)."""
    return table.unpivot(["date", "symbol"], list(features), "feature", "value")


def feature_matrix_wide(table: DataFrame, feature: str, symbols: DataFrame) -> DataFrame:
    """(date, block, values): dates x symbols of one feature, an edge format; ``symbols`` as ``wide.numbered_keys`` numbers them."""
    return to_blocks(table.select("date", "symbol", feature), feature, symbols)


def lag_ratio_factors(bars: DataFrame, lags: int = 60, fields: Sequence[str] = ("close", "open", "high", "low", "vwap",
                                                                             "volume")) -> DataFrame:
    """fields x lags ratio factors as one array per field: element i is the field i rows ago over the latest close
    (volume over the latest volume); NULL until i rows of history exist. Without a vwap column the mean of high, low
    and close stands in."""
    df = bars
    if "vwap" in fields and "vwap" not in bars.columns:
        df = df.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumns({f"_past_{f}": F.array(*[lagged(f, i) for i in range(lags)]) for f in fields})

    def scaled(f: str) -> Column:
        base = F.col("volume") if f == "volume" else F.col("close")
        return F.transform(F.col(f"_past_{f}"), lambda v: F.try_divide(v, base)).alias(f"{f}_lags")

    return df.select("symbol", "date", *[scaled(f) for f in fields])
