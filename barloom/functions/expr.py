"""Scalar and aggregate expressions that stay NULL-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL on a zero denominator."""
    return F.try_divide(col(a), col(b))


def null_if_nan(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def inf_to_null(c: Column | str) -> Column:
    """Infinite or NaN values become NULL."""
    return F.when((F.abs(col(c)) != float("inf")) & ~F.isnan(col(c)), col(c))


def nan_to_zero(c: Column | str) -> Column:
    return F.coalesce(F.nanvl(col(c), F.lit(0.0)), F.lit(0.0))


def varies(x: Column | str) -> Column:
    """Aggregate: the column holds more than one distinct value.

    Merged partial moments of a constant can differ from it in the last bit, so a zero deviation is no safe test.
    """
    return F.min(col(x)) < F.max(col(x))


def deviation(x: Column | str) -> Column:
    """Sample standard deviation, NULL for a constant."""
    return F.when(varies(x), F.stddev_samp(col(x)))


def _paired(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    both = col(x).isNotNull() & col(y).isNotNull()
    return F.when(both, col(x)), F.when(both, col(y))


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation aggregate; NULL when a side is constant or has one row (built-in corr raises).

    Central moments are mergeable, so this keeps map-side partial aggregation. Rows with a NULL side are skipped.
    """
    a, b = _paired(x, y)
    return F.when(varies(a) & varies(b), ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def guarded_slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope of y on x; NULL when x is constant."""
    a, b = _paired(x, y)
    return F.when(varies(a), ratio(F.covar_pop(a, b), F.var_pop(a)))


def guarded_intercept(y: Column | str, x: Column | str) -> Column:
    a, b = _paired(x, y)
    return F.avg(b) - guarded_slope(y, x) * F.avg(a)
