"""Windows by group and cells of bounded size give the same ranks, medians and row numbers."""
import random

from pyspark.sql import functions as F

from barloom.operators import evaluate, ranking, sizing


def rows(n=400):
    r = random.Random(8)
    return [(f"d{r.randint(0, 3)}", i, None if r.random() < .1 else round(r.gauss(0, 1), r.choice((0, 1, 6))), r.choice((None, 0.0, 1.5, r.random()))) for i in range(n)]


def test_both_ways_agree(spark):
    df = spark.createDataFrame(rows(), "date string, symbol int, v double, w double")

    def both(make):
        a, b = (sorted(map(tuple, make(small).collect()), key=str) for small in (False, True))
        assert a == b and a
        return a

    both(lambda small: ranking.average_rank(df, "v", "r", small_groups=small).select("symbol", "r"))
    both(lambda small: ranking.exact_median(df, "v", "m", small_groups=small).select("date", F.round("m", 12)))
    both(lambda small: ranking.descending_row_number(df, "w", "rn", "n", small_groups=small).select("symbol", "rn", "n"))
    both(lambda small: evaluate.ic_by_day(df, "v", "w", small_groups=small).select("date", F.round("IC", 10), F.round("IC_pearson", 10)))


def test_groups_fit(spark):
    df = spark.createDataFrame(rows(50), "date string, symbol int, v double, w double")
    assert sizing.groups_fit(df, limit=50) and not sizing.groups_fit(df, limit=5) and sizing.groups_fit(df.limit(0), limit=5)


def test_onto_codes(spark):
    from barloom.operators import xsection

    df = spark.createDataFrame([("2020-01-01", "a", 1.0), ("2020-01-02", "b", 2.0), ("2020-01-02", "x", 3.0)], "date string, symbol string, f double").withColumn("date", F.to_date("date"))
    codes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "symbol string")
    got = sorted((str(r.date), r.symbol, r.f) for r in xsection.onto_codes(df, codes).collect())
    days = ("2020-01-01", "2020-01-02")
    assert got == sorted((d, s, {("2020-01-01", "a"): 1.0, ("2020-01-02", "b"): 2.0}.get((d, s))) for d in days for s in "abc")
