"""Positions, ranks and exact quantiles that no single task has to sort alone.

A window over a whole group puts that group into one task. Groups here (a chromosome, a split, a
track) may hold a third of all rows, so every operator that needs an order goes through this module.

Ranks are parallel prefix sums: rows are placed by ranges of (group, value), which Spark cuts by rows, so a hot group has
many ranges and small groups share one; a task counts along its range, and what lies in the ranges before it is added.
Quantiles are a selection: a histogram of the leading bits of the values per group says which few buckets hold the wanted
ranks, and only these are looked at again, 16 bits further, until a bucket is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.taskcontext import TaskContext

from genotiles.session import cut_lineage

#: Rows of a bucket that a window may sort.
SMALL_BUCKET = 1 << 18


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    fresh = renamed.select(*[F.col(c).alias(c) for c in renamed.columns])
    return left.join(fresh, match, how).drop(*[f"__right_{k}" for k in keys])


def _count_along(group: Sequence[str], weight: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over a sorted range: add the range's number and the rows of the group before each row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, counted = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for name in group:
                codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            rows = np.ones(n, np.int64) if weight is None else batch.column(weight).to_numpy()
            before = np.cumsum(rows) - rows
            start = np.concatenate(([0], np.flatnonzero(new)))
            own = before - np.repeat(before[start], np.diff(np.append(start, n)))
            key = [batch.column(name)[0] for name in group]
            end = int(start[1]) if len(start) > 1 else n
            if last is not None and all(x.equals(y) for x, y in zip(key, last, strict=True)):
                own[:end] += counted
            last, counted = [batch.column(name)[n - 1] for name in group], int(own[-1] + rows[-1])
            more = [pa.array(np.full(n, part, np.int32)), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__part", "__inside"])

    return run


def _prefix_ranks(
    df: DataFrame, group: Sequence[str], order: str, out: str, weight: str | None = None, total: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out``, the rows of the group with a smaller ``order`` (unique within the group), and ``total``, all its rows.

    The ranges are written down: their bounds come from a sample, so all that follows must see the same ones.
    """
    fields = [StructField("__part", IntegerType()), StructField("__inside", LongType())]
    ranged = cut_lineage(
        df.repartitionByRange(*([ranges] if ranges else []), *group, order).sortWithinPartitions(*group, order)
        .mapInArrow(_count_along(list(group), weight), StructType([*df.schema.fields, *fields]))
    )
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # One row per range and group in it: as many as ranges and groups together, at most.
    sizes = ranged.groupBy(*group, "__part").agg(rows.alias("__size"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        *([F.sum("__size").over(whole).alias(total)] if total else []),
    )
    return null_safe_join(ranged, offsets, [*group, "__part"]).select(
        *df.columns, (F.col("__offset") + F.col("__inside")).cast("bigint").alias(out), *([total] if total else [])
    )


def number_rows(
    df: DataFrame, order: str, *, group: Sequence[str] = (), out: str = "position", block: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row by ``order``, unique within its group.

    Ranges have ``block`` rows, about; by default as many as Spark gives a partition.
    """
    ranges = None if block is None else max(1, -(-df.count() // block))
    return _prefix_ranks(df, group, order, out, ranges=ranges)


def ordered_counts(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (group, value): ``n_equal`` rows, ``n_below`` rows with a smaller value, ``n_total`` of the group.

    With ``weight`` a row stands for so many rows. Equal values are counted before the shuffle, so ties cost nothing.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*group, value).agg(rows.alias("n_equal"))
    return _prefix_ranks(counts, group, value, "n_below", "n_equal", "n_total").select(
        *group, value, "n_equal", "n_below", "n_total"
    )


#: Bits of a value's code: those of a double's fraction, and how many one histogram looks at.
_FRACTION, _DIGIT = 52, 16
#: Smallest power of two told apart; smaller values share codes.
_LEAST_POWER = -960


def sortable_code(value: Column) -> Column:
    """A long that ascends with a double: its power of two, then its fraction, negated for negative values.

    Values of 2^-960 and more have a code of their own. Infinity comes after all finite values, NaN after that.
    The power is a rounded logarithm; where that is one off, the fraction is below 0 or reaches 1 and carries over.
    """
    size = F.abs(value)
    power = F.greatest(F.floor(F.log2(size)), F.lit(_LEAST_POWER)).cast("bigint")
    fraction = F.floor((size * F.pow(F.lit(2.0), -power) - 1) * float(1 << _FRACTION)).cast("bigint")
    code = (power - _LEAST_POWER + 1) * (1 << _FRACTION) + fraction
    finite = F.when(size == 0, F.lit(0).cast("bigint")).when(value < 0, -code).otherwise(code)
    return (
        F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value == float("inf"), F.lit((1 << 63) - 2))
        .when(value == float("-inf"), F.lit(2 - (1 << 63))).otherwise(finite)
    )


def _in_bucket(found: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``__below``, the rows of the keys' bucket in smaller buckets. A bucket has at most 2^16 parts, or few rows."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def quantiles(df: DataFrame, group: Sequence[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per group with linear interpolation, one column per name, and ``n_total`` rows.

    With ``weight`` a row stands for so many rows. A group without rows has no quantiles. ``df`` is read once for
    the histogram and once for the buckets that hold a wanted rank; further rounds follow only while such a
    bucket holds more than ``SMALL_BUCKET`` rows, and read what is left.
    """
    keys = list(group)
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    carried = [] if weight is None else [weight]
    rows = df.select(*keys, value, *carried).where(F.col(value).isNotNull()).withColumn("__code", sortable_code(F.col(value).cast("double")))
    shift = 64 - _DIGIT
    prefix = lambda bits: F.shiftright("__code", bits).alias("__prefix")
    place = {name: F.lit(float(q)) * (F.col("n_total") - 1) for name, q in wanted.items()}
    sides = [
        F.struct(F.lit(f"{side}_{name}").alias("which"), end(p).cast("bigint").alias("rank"))
        for name, p in place.items() for side, end in (("lo", F.floor), ("hi", F.ceil))
    ]

    def hit(found: DataFrame) -> DataFrame:
        """Parts that hold a wanted rank of their bucket, with the rank within the part."""
        inside = (F.col("rank") >= F.col("__below")) & (F.col("rank") < F.col("__below") + F.col("__n"))
        return found.where(inside).withColumn("rank", F.col("rank") - F.col("__below"))

    histogram = _in_bucket(rows.groupBy(*keys, prefix(shift)).agg(counted.alias("__n")), keys, "__prefix").withColumn(
        "n_total", F.sum("__n").over(Window.partitionBy(*keys))
    )
    targets = histogram.select(*keys, "n_total", "__prefix", "__n", "__below", F.inline(F.array(*sides)))
    chosen = cut_lineage(hit(targets).select(*keys, "n_total", "__prefix", "__n", "which", "rank"))
    while True:
        # Two ranks per quantile and group.
        buckets = chosen.select(*keys, "__prefix").distinct()
        rows = rows.withColumn("__prefix", prefix(shift)).join(buckets, [*keys, "__prefix"])
        if shift == 0 or (chosen.agg(F.max("__n")).first()[0] or 0) <= SMALL_BUCKET:
            break
        rows = cut_lineage(rows)
        shift -= _DIGIT
        parts = _in_bucket(
            rows.groupBy(*keys, "__prefix", F.shiftright("__code", shift).alias("__next")).agg(counted.alias("__n")),
            [*keys, "__prefix"], "__next",
        )
        nearer = hit(parts.join(chosen.drop("__n"), [*keys, "__prefix"])).drop("__prefix").withColumnRenamed("__next", "__prefix")
        chosen = cut_lineage(nearer.select(*keys, "n_total", "__prefix", "__n", "which", "rank"))
        rows = rows.drop("__prefix")
    values = _in_bucket(rows.groupBy(*keys, "__prefix", value).agg(counted.alias("__n")), [*keys, "__prefix"], value)
    found = hit(values.join(chosen.drop("__n"), [*keys, "__prefix"]))
    picked = lambda which: F.max(F.when(F.col("which") == which, F.col(value)))
    ends = found.groupBy(*keys).agg(
        F.max("n_total").alias("n_total"), *(picked(f"{side}_{name}").alias(f"__{side}_{name}") for name in wanted for side in ("lo", "hi")),
    )
    if not keys:
        ends = ends.where(F.col("n_total").isNotNull())
    return ends.select(*keys, "n_total", *[
        (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (p - F.floor(p))).alias(name)
        for name, p in place.items()
    ])


def quantiles_of(
    df: DataFrame, group: Sequence[str], wanted: dict[str, tuple[str, float]], weight: str | None = None
) -> DataFrame:
    """Exact quantiles of several columns in one pass: ``{name: (column, quantile)}``, one row per group."""
    columns = sorted({column for column, _ in wanted.values()})
    asked = {f"__q{i}": q for i, q in enumerate(sorted({q for _, q in wanted.values()}))}
    name_of = {q: name for name, q in asked.items()}
    kept = [*group, *([weight] if weight else [])]
    long = df.unpivot(kept, columns, "__column", "__value")
    found = quantiles(long, [*group, "__column"], "__value", asked, weight)
    return found.groupBy(*group).agg(*[
        F.max(F.when(F.col("__column") == column, F.col(name_of[q]))).alias(name)
        for name, (column, q) in wanted.items()
    ])


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group, with their 1-based ``rank``.

    With a literal ``k`` Spark keeps at most ``k`` rows per group in every task before the shuffle,
    so a hot group ships ``k`` rows per task and not all of its rows.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= F.lit(k))
