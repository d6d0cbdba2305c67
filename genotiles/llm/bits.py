"""Bit tables of a fixed size over 64-bit hashes: a filter that lets all members through, and a few others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_table(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """2^bits bits, those of the hashes' leading bits set; at most 2^bits / 64 rows reach the driver.

    More hashes fill the table and make it let more through, never less.
    """
    place = f"shiftrightunsigned({column}, {64 - bits})"
    words = hashes.groupBy(F.expr(f"shiftright({place}, 6)").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 as int)))").alias("bits")
    ).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) have their bit set."""
    bits = (len(table) * 64).bit_length() - 1
    place = h >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def maybe_in(hashes: DataFrame, h: Column, bits: int = 25) -> Column:
    """Whether h may be among hashes (a column h): true for all members, and for few others. Only h leaves the JVM."""
    table = bit_table(hashes, "h", bits)

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return pd.Series(has(table, values.to_numpy().view(np.uint64)))

    return found(h)


def without_ids(documents: DataFrame, dropped: DataFrame, bits: int = 25) -> DataFrame:
    """The documents whose doc_id is not in dropped (doc_id); null ids stay unless dropped has a null.

    Only documents whose bit is set are shuffled for the exact comparison; the others, nearly all, stay where they are.
    """
    ids = dropped.select(F.col("doc_id").alias("dropped_id")).distinct()
    marked = maybe_in(ids.select(F.xxhash64("dropped_id").alias("h")), F.xxhash64("doc_id"), bits)
    compared = documents.where(marked).join(ids, F.equal_null("doc_id", "dropped_id"), "left_anti")
    return documents.where(~marked).unionByName(compared)
