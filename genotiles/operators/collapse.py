"""Run-length collapse of adjacent bins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells that a task folds at a time (32 MB of doubles per work array).
MAX_CELLS = 1 << 22

RUN = T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("total", T.DoubleType()),
])


def fold_runs(values: np.ndarray, lengths: np.ndarray, rtol: float) -> tuple[np.ndarray, ...]:
    """Runs of every row of a padded matrix: ``(row, at, n, total)`` in row order.

    A value joins the open run while it is within ``rtol`` of the run's mean so far. That depends on
    order along a row but not across rows, so the loop goes over columns and handles all rows at once.
    """
    rows, width = values.shape
    totals, counts = np.empty_like(values), np.empty(values.shape, dtype=np.int32)
    opens = np.zeros(values.shape, dtype=bool)
    total, count = np.zeros(rows), np.zeros(rows, dtype=np.int32)
    for at in range(width):
        value = values[:, at]
        mean = total / np.maximum(count, 1)
        close = np.abs(value - mean) <= rtol * np.maximum(np.abs(value), np.abs(mean))
        joins = close & (count > 0)
        total = np.where(joins, total + value, value)
        count = np.where(joins, count + 1, 1)
        totals[:, at], counts[:, at], opens[:, at] = total, count, ~joins
    inside = np.arange(width) < lengths[:, None]
    opens &= inside
    # A run ends where the next one opens or the row ends.
    closes = inside.copy()
    closes[:, :-1] &= opens[:, 1:] | ~inside[:, 1:]
    row, at = np.nonzero(opens)
    return row, at, counts[closes], totals[closes]


def _runs_function(rtol: float) -> Callable[[Column], Column]:
    def run_lists(values: pa.Array) -> pa.Array:
        offsets = values.offsets.to_numpy()
        flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.diff(offsets)
        step = max(1, MAX_CELLS // max(1, int(lengths.max(initial=0))))
        found, sizes = [], []
        for first in range(0, len(lengths), step):
            part = lengths[first:first + step]
            matrix = np.zeros((len(part), int(part.max(initial=0))))
            inside = np.arange(matrix.shape[1]) < part[:, None]
            matrix[inside] = flat[offsets[first]:offsets[first + len(part)]]
            row, *runs = fold_runs(matrix, part, rtol)
            found.append(runs)
            sizes.append(np.bincount(row, minlength=len(part)))
        at, n, total = (np.concatenate(column) for column in zip(*found)) if found else ([], [], [])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])])
        runs = pa.StructArray.from_arrays(
            [pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(total, pa.float64())], names=["at", "n", "total"]
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)

    # The annotations tell Spark the kind of function; they have to be the classes themselves.
    run_lists.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run_lists, T.ArrayType(RUN))


def runs(values: Column, rtol: float) -> Column:
    """Runs ``(at, n, total)`` of an array column."""
    return _runs_function(rtol)(values)


def collapse(rows: DataFrame, bin_size: int, rtol: float = 0.01) -> DataFrame:
    """``(chrom, start_pos, end_pos, track, value)`` intervals from ``(chrom, len, pred_start, track, vals)``.

    Bins are clamped to ``[0, len)`` and empty ones dropped; runs never cross windows or tracks.
    """
    skip = F.greatest(F.floor(-F.col("pred_start") / bin_size), F.lit(0))
    stop = F.least(F.ceil((F.col("len") - F.col("pred_start")) / bin_size), F.size("vals"))
    clipped = rows.select(
        "chrom", "len", "pred_start", "track", skip.alias("__skip"),
        F.slice("vals", (skip + 1).cast("int"), F.greatest(stop - skip, F.lit(0)).cast("int")).alias("__inside"),
    )
    found = clipped.withColumn("__runs", runs(F.col("__inside"), rtol)).withColumn("__run", F.explode("__runs"))
    first = F.col("__skip") + F.col("__run.at")
    start = F.col("pred_start") + first * bin_size
    end = F.col("pred_start") + (first + F.col("__run.n")) * bin_size
    return found.select(
        "chrom",
        F.greatest(start, F.lit(0)).cast("bigint").alias("start_pos"),
        F.least(end, F.col("len")).cast("bigint").alias("end_pos"),
        "track",
        (F.col("__run.total") / F.col("__run.n")).alias("value"),
    )
