"""Packing of token sequences: cutting stock by column generation over the histogram of piece lengths.

A document's ids end with an end id. It is cut into pieces of the full sequence length and a rest; the rests
are packed. Their lengths are counted in units of `unit` ids, rounded up, so the linear program sees at most
capacity / unit numbers, whatever the corpus. Its patterns, rounded, say how many sequences hold how many rests
of each length. Documents are ranked within their length, and a rank says which sequence and place are theirs.
Ranks come from counts by hash bucket, so a length that a third of all documents share is many small windows.

Cases: null and empty texts are the end id alone; a document longer than a sequence has several pieces; repeated
rows are packed each; an empty table packs to an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genotiles.llm.cutting_stock import patterns
from genotiles.llm.encoding import encoder
from genotiles.llm.tables import lean, tasks_for, written
from genotiles.llm.tokens import column_of, pieces


@dataclass(frozen=True)
class PackingOptions:
    #: File of the tokenizer, at the same path on all executors.
    tokenizer: str
    capacity: int = 2048
    end_id: int = 1
    unit: int = 8
    #: Whether a special token's string in a text is plain text; the tokenizer's own way is to make it that token.
    special_as_text: bool = False
    #: Bytes of text whose words are looked up together, about.
    piece_bytes: int = 4 << 20
    #: Rows ranked by one window, about.
    bucket_rows: int = 50_000


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lean
def _pieces(options: PackingOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(options.tokenizer, options.special_as_text)
        end, step = np.array([options.end_id], "<u4").tobytes(), 4 * options.capacity
        for batch in batches:
            for low, high, _, _ in pieces(column_of(batch, "text"), options.piece_bytes):
                docs = column_of(batch, "doc_id").slice(low, high - low)
                ids, starts = encode.many(column_of(batch, "text").slice(low, high - low))
                out: list[tuple] = []
                for row, doc_id in enumerate(docs.to_pylist()):
                    own = ids[starts[row] : starts[row + 1]].tobytes() + end
                    out += [
                        (doc_id, at // 4, (min(len(own), at + step) - at) // 4, zlib.crc32(own[at : at + step]), len(own) // 4)
                        for at in range(0, len(own), step)
                    ]
                columns = zip(*out, strict=True) if out else [[]] * 5
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
    return run


def _places(counts: dict[int, int], options: PackingOptions) -> list[tuple]:
    """(units, low, high, per sequence, first sequence, order): ranks low..high-1 of a length, and where they go."""
    room = options.capacity // options.unit
    full = counts.get(room + 1, 0)
    rows = [(room + 1, 0, full, 1, 0, 0)] if full else []
    demand = np.array([counts.get(u, 0) for u in range(1, room + 1)], dtype=np.int64)
    taken, sequence = np.zeros(room + 1, dtype=np.int64), full
    for content, bins in patterns(demand, room):
        for order, units in enumerate(np.flatnonzero(content)[::-1] + 1):
            per = int(content[units - 1])
            low = int(taken[units])
            rows.append((int(units), low, low + per * bins, per, sequence, order))
            taken[units] += per * bins
        sequence += bins
    return rows


def pack(documents: DataFrame, options: PackingOptions) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset in the sequence."""
    spark = documents.sparkSession
    pieces = written(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(options), _PIECE), "pieces")
    # Pieces of the full length have a class of their own beyond the units.
    units = F.when(F.col("length") == options.capacity, options.capacity // options.unit + 1).otherwise(
        F.ceil(F.col("length") / options.unit)
    ).cast("int")
    buckets = tasks_for(pieces.count(), options.bucket_rows)
    classed = pieces.withColumns({"units": units, "bucket": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))})
    in_bucket = classed.groupBy("units", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = written(in_bucket.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "ahead")
    counts = {r["units"]: r["n"] for r in ahead.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    place = spark.createDataFrame(
        _places(counts, options), "units int, low long, high long, per long, first_sequence long, order int"
    )
    ordered = Window.partitionBy("units", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        classed.withColumn("number", F.row_number().over(ordered))
        .join(ahead.drop("n"), ["units", "bucket"])
        .withColumn("rank", F.col("ahead") + F.col("number") - 1)
    )
    # One row per length and pattern that holds it: bounded by the units, not by the corpus.
    seated = ranked.join(F.broadcast(place), "units").where("rank >= low AND rank < high").withColumn(
        "sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("per"))
    )
    earlier = Window.partitionBy("sequence_id").orderBy("order", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return seated.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )
