"""Scores against labels: information coefficients, errors, classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.expr import deviation, guarded_corr, ratio
from barloom.functions.logits import argmax_class, parse_logits, up_probability
from barloom.operators.ranking import average, value_ranks, window_average


def _ranked_pairs(df: DataFrame, pred: str, label: str, small_groups: bool = False) -> DataFrame:
    """(date, _p, _l, _rp, _rl): rows with a missing side keep their date and count in no rank or sum."""
    both = F.col(pred).isNotNull() & F.col(label).isNotNull()
    pairs = df.select("date", F.when(both, F.col(pred)).alias("_p"), F.when(both, F.col(label)).alias("_l"))
    if small_groups:
        return pairs.select("*", window_average("_p", "_rp"), window_average("_l", "_rl"))
    ranks = [value_ranks(pairs, ["date"], x).select("date", x, average(out)) for x, out in (("_p", "_rp"), ("_l", "_rl"))]
    return pairs.join(ranks[0], ["date", "_p"], "left").join(ranks[1], ["date", "_l"], "left")


def ic_spearman_by_day(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Correlation of average ranks per date, over the rows with both sides; NULL when a side is constant or no row has
    both, so that no day is lost."""
    return _ranked_pairs(df, pred, label).groupBy("date").agg(guarded_corr("_rp", "_rl").alias("IC"))


def ic_pearson_by_day(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    return df.groupBy("date").agg(guarded_corr(pred, label).alias("IC_pearson"))


def ic_summary(by_day: DataFrame, column: str = "IC") -> DataFrame:
    """Mean and mean / sd of the defined days, and the number of undefined ones."""
    return by_day.agg(F.avg(column).alias("IC_mean"),
                      ratio(F.avg(column), deviation(column)).alias("ICIR"),
                      F.count(column).alias("n_days"), F.count_if(F.col(column).isNull()).alias("n_undefined"))


def mae_rmse(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    error = F.col(pred) - F.col(label)
    return df.agg(F.avg(F.abs(error)).alias("MAE"), F.sqrt(F.avg(error * error)).alias("RMSE"))


def accuracy(df: DataFrame, pred: str = "pred_class", label: str = "label_class") -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("int")).alias("Accuracy"))


def f1_macro(df: DataFrame, pred: str = "pred_class", label: str = "label_class") -> DataFrame:
    """Unweighted mean of F1 over all classes seen on either side; a zero denominator gives 0.

    The table collapses to one row per (predicted, true) pair before classes are formed.
    """
    confusion = df.groupBy(F.col(pred).alias("p"), F.col(label).alias("t")).agg(F.count("*").alias("n"))
    sides = confusion.select("n", F.inline(F.array(
        F.struct(F.col("p").alias("c"), F.lit(1).alias("is_pred"), (F.col("p") == F.col("t")).cast("int").alias("hit")),
        F.struct(F.col("t").alias("c"), F.lit(0).alias("is_pred"), F.lit(0).alias("hit")))))
    by_class = sides.groupBy("c").agg(F.sum(F.col("n") * F.col("is_pred")).alias("predicted"),
                                      F.sum(F.col("n") * (1 - F.col("is_pred"))).alias("actual"),
                                      F.sum(F.col("n") * F.col("hit")).alias("hits"))
    f1 = F.coalesce(ratio(2.0 * F.col("hits"), F.col("predicted") + F.col("actual")), F.lit(0.0))
    return by_class.agg(F.avg(f1).alias("F1_macro"))


def masked_step_metrics(df: DataFrame, step: str = "step", pred: str = "pred", label: str = "label",
                        pred_class: str = "pred_class", label_class: str = "label_class") -> DataFrame:
    """Per horizon step, over rows with a non-zero label: MAE, RMSE and MAPE (signed label below); accuracy over all
    rows; an empty mask gives 0."""
    live = F.col(label) != 0
    error = F.when(live, F.abs(F.col(pred) - F.col(label)))
    return df.groupBy(step).agg(
        F.avg((F.col(pred_class) == F.col(label_class)).cast("int")).alias("acc"),
        F.coalesce(F.avg(error), F.lit(0.0)).alias("mae"),
        F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.avg(ratio(error, label)), F.lit(0.0)).alias("mape"))


def mean_step_metrics(steps: DataFrame) -> DataFrame:
    return steps.agg(*[F.avg(c).alias(c) for c in ("acc", "mae", "rmse", "mape")])


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label_class") -> DataFrame:
    """Mean of -log softmax[label], the logarithm taken of the sum so far logits do not underflow."""
    a = F.col(logits)
    top = F.array_max(a)
    log_sum = F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return df.agg(F.avg(log_sum - F.get(a, F.col(label).cast("int"))).alias("cross_entropy"))


def with_parsed_logits(df: DataFrame, cell: str = "cell", out: str = "logits", **kw) -> DataFrame:
    return df.withColumn(out, parse_logits(cell, **kw))


def with_class(df: DataFrame, logits: str = "logits", out: str = "pred_class") -> DataFrame:
    return df.withColumn(out, argmax_class(logits))


def with_softmax(df: DataFrame, logits: str = "logits", out: str = "prob") -> DataFrame:
    return df.withColumn(out, up_probability(logits))


def ic_by_day(df: DataFrame, pred: str = "pred", label: str = "label", small_groups: bool = False) -> DataFrame:
    """(date, IC, IC_pearson). The plain and the rank correlation come from one aggregate over the ranked rows."""
    return _ranked_pairs(df, pred, label, small_groups).groupBy("date").agg(guarded_corr("_rp", "_rl").alias("IC"),
                                                                            guarded_corr("_p", "_l").alias("IC_pearson"))


def evaluation_summary(df: DataFrame, pred: str = "pred", label: str = "label", pred_class: str = "pred_class",
                       label_class: str = "label_class", small_groups: bool = False) -> DataFrame:
    """One row: IC_mean, ICIR, IC_pearson, MAE, RMSE, Accuracy, F1_macro."""
    days = ic_by_day(df, pred, label, small_groups).agg(
        F.avg("IC").alias("IC_mean"), ratio(F.avg("IC"), deviation("IC")).alias("ICIR"),
        F.avg("IC_pearson").alias("IC_pearson"))
    error = F.col(pred) - F.col(label)
    errors = df.agg(F.struct(F.avg(F.abs(error)).alias("MAE"), F.sqrt(F.avg(error * error)).alias("RMSE"),
                             F.avg((F.col(pred_class) == F.col(label_class)).cast("int")).alias("Accuracy"))).scalar()
    f1 = f1_macro(df, pred_class, label_class).scalar()
    return days.select("*", *[errors[c].alias(c) for c in ("MAE", "RMSE", "Accuracy")], f1.alias("F1_macro"))
