"""Rounding helpers that reproduce JavaScript number formatting with
JVM-side expressions (no UDF).

``Math.round`` rounds half toward +infinity, so it is ``floor(x + 0.5)``;
Spark's ``round`` rounds half away from zero and would differ on negatives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """``Math.round(x * 10^d) / 10^d`` as a double."""
    if digits == 0:
        return F.floor(x + F.lit(0.5)).cast("double")
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_up_long(x: Column) -> Column:
    """``Math.round(x)`` as a bigint."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def significant(x: Column, digits: int = 5, lo_exp: int = -12, hi_exp: int = 12) -> Column:
    """``Number(x.toPrecision(digits))`` for non-negative x.

    The decimal exponent comes from a comparison ladder instead of
    ``log10`` so exact powers of ten cannot fall on the wrong side.
    """
    expr = None
    for e in range(hi_exp, lo_exp - 1, -1):
        k = digits - 1 - e
        scale = 10.0 ** k
        if k >= 0:
            val = F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
        else:
            inv = 10.0 ** (-k)
            val = F.floor(x / F.lit(inv) + F.lit(0.5)) * F.lit(inv)
        cond = x >= F.lit(10.0 ** e)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(x)


def truthy_number(x: Column) -> Column:
    """JavaScript truthiness of a number column: not null, not 0, not NaN."""
    return x.isNotNull() & (x != F.lit(0)) & ~F.isnan(x.cast("double"))
