"""Samples and orders of examples. All draws are functions of the key, so a retried task repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shuffle_key(key: str, seed: int) -> Column:
    """Pseudo-random order of a key for a seed; the same in every run and engine."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def _rows_of(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows of the chosen keys in key order. Rows may be wide; only keys ever meet in one task."""
    return rows.join(chosen, key, "left_semi").orderBy(key)


def random_sample(rows: DataFrame, n: int, seed: int, key: str = "index") -> DataFrame:
    """``n`` rows without replacement, in key order; ``key`` is unique."""
    return _rows_of(rows, rows.select(key).orderBy(shuffle_key(key, seed), key).limit(n), key)


def stride(n_rows: int, n: int) -> int:
    return max(1, n_rows // n)


def stride_filter(rows: DataFrame, step: int, position: str = "local_index") -> DataFrame:
    """Every ``step``-th row by position. Stateless, so it also runs on a stream."""
    return rows.where(F.col(position) % step == 0)


def stride_sample(rows: DataFrame, n: int, position: str = "local_index", n_rows: int | None = None) -> DataFrame:
    """At most ``n`` evenly spaced rows in position order."""
    total = rows.count() if n_rows is None else n_rows
    kept = stride_filter(rows, stride(total, n), position) if total > n else rows
    return first_rows(kept, n, position)


def first_rows(rows: DataFrame, n: int, key: str = "index") -> DataFrame:
    """The ``n`` rows of the smallest keys, in key order; ``key`` is unique."""
    return _rows_of(rows, rows.select(key).orderBy(key).limit(n), key)


def shuffled(rows: DataFrame, seed: int, key: str = "index") -> DataFrame:
    """All rows in a pseudo-random order: a range-partitioned sort, not a buffer."""
    return rows.orderBy(shuffle_key(key, seed), key)
