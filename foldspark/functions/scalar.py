"""Column expressions that treat what is not finite as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308


def is_finite(x: Column) -> Column:
    """True for a finite number, false for null, NaN and infinities. (NaN is above every number in Spark.)"""
    return F.coalesce(x.between(F.lit(-MAX_DOUBLE), F.lit(MAX_DOUBLE)), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a finite double, else null."""
    return finite_or_null(F.try_divide(a.cast("double"), b.cast("double")))


def rounded(df, digits: int = 6):
    """df with every double column rounded, large values to fewer places, and no negative zeros, for comparison between engines."""

    def short(c):
        return F.when(F.abs(F.col(c)) < 10.0 ** (12 - digits), F.round(F.col(c), digits) + 0.0).otherwise(F.round(F.col(c), digits - 4)).alias(c)

    return df.select(*(short(c) if t == "double" else F.col(c) for c, t in df.dtypes))
