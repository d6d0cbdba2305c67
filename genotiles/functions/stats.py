"""Correlation from sums. The three guards differ on purpose; each metric names its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_STD = 1e-8
MIN_VARIANCE_TERM = 1e-12


def pearson_guard_std(x: Column, y: Column) -> Column:
    """Aggregate: Pearson, NULL with fewer than two rows or a population std below 1e-8."""
    spread_x, spread_y = F.stddev_pop(x), F.stddev_pop(y)
    defined = (F.count(x) >= 2) & (spread_x >= MIN_STD) & (spread_y >= MIN_STD)
    return F.when(defined, F.covar_pop(x, y) / (spread_x * spread_y))


def _terms(n: Column, sx: Column, sy: Column, sx2: Column, sy2: Column, sxy: Column):
    return n * sxy - sx * sy, n * sx2 - sx * sx, n * sy2 - sy * sy


def pearson_guard_terms(n, sx, sy, sx2, sy2, sxy) -> Column:
    """Pearson from sums, NULL with n < 2 or either variance term at most 1e-12."""
    cross, var_x, var_y = _terms(n, sx, sy, sx2, sy2, sxy)
    defined = (n >= 2) & (var_x > MIN_VARIANCE_TERM) & (var_y > MIN_VARIANCE_TERM)
    return F.when(defined, cross / F.sqrt(var_x * var_y))


def pearson_guard_product(n, sx, sy, sx2, sy2, sxy) -> Column:
    """Pearson from sums, NULL where the product of the variance terms is not positive."""
    cross, var_x, var_y = _terms(n, sx, sy, sx2, sy2, sxy)
    spread = F.sqrt(F.greatest(var_x, F.lit(0.0)) * F.greatest(var_y, F.lit(0.0)))
    return F.when(spread > 0, cross / spread)
