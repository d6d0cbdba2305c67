"""What a registered query is, and rounding that both engines agree on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """A query, the operators it exercises, and its SQL twin (None where SQL cannot say it)."""

    name: str
    operators: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round half away from a tie, so that sums taken in another order give the same digits."""
    column = F.col(x) if isinstance(x, str) else x
    return F.round(column + F.lit(1e-9), digits) + F.lit(0.0)


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"(round({x} + 1e-9, {digits}) + 0.0)"
