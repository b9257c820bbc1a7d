"""Class logits kept as text such as ``[ 0.16 -0.08]``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barloom.functions.expr import col

# The two number patterns used on logit cells. Both read `1.e-05` as two numbers.
PATTERN_EVALUATE = r"[-+]?\d*\.?\d+(?:e[-+]?\d+)?"
PATTERN_RESULTS = r"-?\d+\.\d+(?:[eE][+-]?\d+)?|-?\d+"


def parse_logits(cell: Column | str, pattern: str = PATTERN_EVALUATE) -> Column:
    """Text cell to ARRAY<DOUBLE>."""
    found = F.regexp_extract_all(col(cell), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: s.try_cast("double"))


def argmax_class(logits: Column | str) -> Column:
    """Position of the first largest logit; fewer than two numbers give class 0."""
    a = col(logits)
    return F.when(F.size(a) < 2, F.lit(0)).otherwise((F.array_position(a, F.array_max(a)) - 1).cast("int"))


def softmax(logits: Column | str) -> Column:
    a = col(logits)
    powers = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda p: p / total)


def up_probability(logits: Column | str) -> Column:
    """Probability of class 1."""
    return F.get(softmax(logits), F.lit(1))
