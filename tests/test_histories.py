"""Features over arrays of whole histories, and windows packed where the rows lie."""

import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import features, histories, windows
from barloom.operators.clean import PRICE_FIELDS, ffill_bfill


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark):
    """70 symbols of 260 rows in one task, more than a task takes at a time; every thirtieth cell missing, some prices zero."""
    at = spark.range(70 * 260, numPartitions=1).select((F.col("id") / 260).cast("bigint").alias("symbol"), F.date_add(
        F.lit("2020-01-01"), (F.col("id") % 260).cast("int")).alias("date"))
    def draw(c, of):
        return F.pmod(F.xxhash64("symbol", "date", F.lit(c)), F.lit(of))

    made = {c: F.when(draw(c, 30) > 0, F.when(draw(c + "0", 60) > 0, 50.0 + draw(c + "v", 1000) / 100).otherwise(0.0)) for c in PRICE_FIELDS}
    return at.select("symbol", "date", *[v.alias(c) for c, v in made.items()]).where("symbol % 9 > 0 or date < '2020-02-01'")


def _apart(left, right, columns):
    both = left.alias("a").join(right.alias("b"), ["symbol", "date"])
    off = [F.sum((F.col(f"a.{c}").isNull() != F.col(f"b.{c}").isNull()).cast("int")
                 + F.coalesce((F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > 1e-7 * (1 + F.abs(F.col(f"b.{c}")))).cast("int"), F.lit(0))).alias(c) for c in columns]
    found = both.agg(F.count("*").alias("n"), *off).first().asDict()
    return found.pop("n"), {c: n for c, n in found.items() if n}


def test_features_equal_their_families(bars):
    families = bars
    for made in (features.roc, features.rsi, features.macd, features.bollinger, features.volume_ratio, features.atr, features.obv, features.stochastic,
                 features.williams, features.cci, features.donchian, features.momentum, features.ema, features.sma, features.sma_distance,
                 features.daily_return, features.volume_norm, features.high_low_spread, features.close_open_return):
        families = made(families)
    n, off = _apart(features.compute_features(bars), families, features.FEATURES)
    assert (n, off) == (bars.count(), {})


def test_features_need_few_windows(bars):
    plan = _plan(features.build_feature_matrix(bars.select("symbol", "date", *PRICE_FIELDS), warmup=3).select("RSI_14", "VOL_norm_252"))
    assert plan.count("Window [") <= 3 and "lag(" not in plan and "last(" not in plan


def test_filled_features(bars):
    some = bars.where("symbol < 12")
    wanted = ffill_bfill(features.compute_features(some), features.FEATURES)
    assert _apart(features.compute_features(some, filled=True), wanted, features.FEATURES) == (some.count(), {})


def test_one_row_and_no_row(spark, frame):
    schema = "symbol string, date date, open double, high double, low double, close double, volume double, note string"
    one = features.compute_features(frame(schema, [[None, "2020-01-01", 1.0, 3.0, 1.0, 2.0, 5.0, "x"]])).first()
    assert (one.symbol, one.note, one.HL_SPREAD, one.ROC_3, one.EMA_5) == (None, "x", 1.0, None, 2.0)
    assert features.compute_features(frame(schema, [])).count() == 0


def test_a_long_history_beside_short_ones():
    import numpy as np

    x = np.array([[1.0, np.nan, 3.0], [np.nan, np.nan, 2.0], [np.nan] * 3])
    assert np.nan_to_num(histories.filled(x), nan=-1).tolist() == [[1, 1, 3], [2, 2, 2], [-1, -1, -1]]
    assert np.nan_to_num(histories.extreme(np.maximum, x, 1, 2), nan=-1).tolist() == [[-1] * 3] * 3
    means, variances = np.array([[np.nan, 1.5, 3.0, 6.0]]), np.array([[np.nan, 0.25, 1.0, 4.0]])  # of 1, 2, 4, 8 by twos
    assert math.isclose(histories.deviation(means, variances, 2, 4)[0, -1], 3.0956959, rel_tol=1e-6)


def test_sequences_packed_in_place(bars):
    tagged = bars.withColumns({"split": F.when(F.month("date") % 2 == 0, "even").otherwise("odd"), "pair": F.array("close", "open")})
    wanted = windows.packed_sequences(tagged, ["close", "pair"])
    lying = tagged.repartition(3, "symbol").sortWithinPartitions("symbol", "date")
    got = windows.packed_sequences(lying, ["close", "pair"], placed=True)
    assert got.columns == wanted.columns and "Aggregate" not in _plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_tree_table_reads_narrow_rows_in_place(spark, tmp_path):
    """Each reading makes the features anew from buckets of the symbol: nothing is exchanged and no wide table is written."""
    from barloom.plans import queries as Q, views as V

    rows = spark.range(40 * 30).select((F.col("id") % 40).alias("l_suppkey"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
                                       F.col("id").alias("l_partkey"), (100.0 + F.col("id") % 97).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"),
                                       F.expr("timestamp'1995-01-02' + make_dt_interval(cast(id / 40 as int) * 7)").alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    table = Q._tree_table(spark, str(tmp_path))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount" in plan and (str(tmp_path), "tree-table") not in V._stored
    assert table.count() == 40 * 29 and set(table.columns) == {"symbol", "date", "split", "fwd_ret", *features.FEATURES}
