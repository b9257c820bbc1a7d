"""barloom: cross-sectional factor, label and portfolio analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` over long panels keyed by ``(symbol, date)``.
NULL is the only missing value; NaN is converted at the scan.
"""
