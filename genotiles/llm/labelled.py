"""Labelled training rows: a bounded sample, chosen by the hash of doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLOTS = 1 << 20


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text has the remainder; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, max_rows: int
) -> DataFrame:
    """(doc_id, text, label) of labelled rows that are not held out, about max_rows of them at most.

    With more labelled rows than max_rows, ids are kept by their hash at the rate max_rows / rows, so the
    sample is the same in every run. Null ids and null labels teach nothing; of several labels of one id the
    largest counts. The sampled ids are broadcast: 12 bytes each, max_rows bounds them.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS)) < int(_SLOTS * max_rows / total))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
