"""Symbol codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barloom.functions.expr import col

# Exchange suffix by the first digit of a six-digit code.
EXCHANGE_SUFFIX = {"0": ".SZ", "3": ".SZ", "4": ".BJ", "8": ".BJ", "6": ".SH"}


def format_symbol(code: Column | str) -> Column:
    """Zero-pad to six characters (longer codes stay whole) and add the exchange suffix."""
    text = col(code).cast("string")
    padded = F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)
    first = F.substring(padded, 1, 1)
    suffix = F.lit("")
    for digit, name in EXCHANGE_SUFFIX.items():
        suffix = F.when(first == digit, F.lit(name)).otherwise(suffix)
    return F.concat(padded, suffix)


def normalise_ticker(ticker: Column | str) -> Column:
    return F.replace(col(ticker), F.lit("."), F.lit("-"))
