"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_pair(pred: Column, target: Column) -> Column:
    """Predicate that every pairwise metric applies first."""
    return finite(pred) & finite(target)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is NULL where the denominator is 0, also in ANSI mode."""
    return F.try_divide(numerator, denominator)


def huber(difference: Column, delta: float) -> Column:
    """Quadratic inside ``delta``, linear outside."""
    size = F.abs(difference)
    return F.when(size <= delta, 0.5 * difference * difference).otherwise(
        delta * (size - 0.5 * delta)
    )


def floor_half(x: Column) -> Column:
    """Whole half of a non-negative integer column."""
    return F.shiftright(x, 1)


def whole_div(x: Column, by: int) -> Column:
    """Integer quotient rounded down, right for negative numbers too."""
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("bigint")
