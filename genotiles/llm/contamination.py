"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles.

An item is found in a document that holds at least percent of the item's distinct word shingles. Documents
may be any number of times longer, so items are partitioned by size: of a class whose items have at most u
shingles, the u - ceil(percent * u / 100) + 1 shingles of least hash are an item's sketch. A document that
holds enough of an item's shingles cannot miss all of its sketch, so looking for sketches loses nothing.

Documents are read once, against two bit tables of fixed size (sketches; all item shingles). A document
without a sketch bit sends nothing; others send the shingles whose bits are set, as text. More items fill the
tables and let more shingles through, never fewer. Candidates (a sketch shingle in common, by text) are
verified by counting the item's shingles in the document, also by text.

Cases: null, empty and blank items and texts have no shingles and match nothing; an item of fewer words than a
shingle is one shingle, found where a document consists of just these words; equal item ids or equal
document ids (null too) count as one; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genotiles.llm.bits import bit_table, has, without_ids
from genotiles.llm.tables import lean, written
from genotiles.llm.tokens import column_of, pieces, shingles, signed, windows, words

#: 2^BITS bits of a bit table.
BITS = 24


@dataclass(frozen=True)
class ContaminationOptions:
    size: int = 5
    percent: int = 80


def _texts_of(data: np.ndarray, found, row: int, at: int, size: int) -> str:
    """The words of a shingle, lower-cased A-Z, one space between."""
    start = found.start[at : at + size]
    end = found.end[at : at + size]
    stop = int(np.searchsorted(found.row[at : at + size], row, side="right"))
    return b" ".join(bytes(data[i:j]).lower() for i, j in zip(start[:stop], end[:stop], strict=True)).decode("utf-8", "replace")


def _places(found, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word's number of every shingle."""
    h, row = shingles(found, size)
    _, at = windows(found, size)
    return h, row, np.concatenate((at, found.first()[row[len(at) :]]))


@lean
def _item_shingles(options: ContaminationOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_of(batch, "item_id")
            for low, _, data, starts in pieces(column_of(batch, "text")):
                found = words(data, starts)
                h, row, at = _places(found, options.size)
                texts = [_texts_of(data, found, r, a, options.size) for r, a in zip(row, at, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + low)), pa.array(signed(h)), pa.array(texts, pa.string())],
                    names=["item_id", "hash", "shingle"],
                )
    return run


def _document_shingles(sketch: np.ndarray, every: np.ndarray, options: ContaminationOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_of(batch, "doc_id")
            for low, high, data, starts in pieces(column_of(batch, "text")):
                found = words(data, starts)
                h, row, at = _places(found, options.size)
                hit = has(every, h)
                h, row, at = h[hit], row[hit], at[hit]
                sketched = np.zeros(high - low, dtype=bool)
                sketched[row[has(sketch, h)]] = True
                use = sketched[row]
                h, row, at = h[use], row[use], at[use]
                if len(h):
                    texts = [_texts_of(data, found, r, a, options.size) for r, a in zip(row, at, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row + low)), pa.array(texts, pa.string())], names=["doc_id", "shingle"]
                    )
    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, options: ContaminationOptions | None = None) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the items found in documents, their shingles and how many are there."""
    options = options or ContaminationOptions()
    item_id = benchmark.schema["item_id"].dataType.simpleString()
    items = (
        benchmark.select("item_id", "text")
        .mapInArrow(_item_shingles(options), f"item_id {item_id}, hash long, shingle string").distinct()
    )
    of_item = Window.partitionBy("item_id")
    sized = items.withColumn("n_item", F.count(F.lit(1)).over(of_item)).withColumn(
        "rank", F.row_number().over(of_item.orderBy("hash", "shingle"))
    )
    # Size classes grow by a quarter; a sketch is as long as the largest item of its class needs.
    upper = F.greatest(F.col("n_item"), F.floor(F.pow(F.lit(1.25), F.ceil(F.log(1.25, "n_item")))).cast("long"))
    ranked = written(sized.withColumn("n_sketch", upper - F.ceil(upper * options.percent / 100) + 1), "items")
    sketch = ranked.where("rank <= n_sketch")
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    hits = written(
        documents.select("doc_id", "text").mapInArrow(
            _document_shingles(bit_table(sketch, "hash", BITS), bit_table(ranked, "hash", BITS), options), f"doc_id {doc_id}, shingle string"
        ).distinct(), "hits",
    )
    candidates = hits.join(sketch, "shingle").select("doc_id", "item_id").distinct()
    held = hits.withColumnsRenamed({"doc_id": "d", "shingle": "s"})
    known = ranked.select(F.col("item_id").alias("i"), F.col("shingle").alias("s"), "n_item")
    counted = (
        candidates.join(held, F.equal_null("doc_id", "d"))
        .join(known, F.equal_null("item_id", "i") & (held["s"] == known["s"]))
        .groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    )
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * options.percent)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, options: ContaminationOptions | None = None) -> DataFrame:
    """The documents in which no item was found."""
    return without_ids(documents, written(contaminated(documents, benchmark, options).select("doc_id").distinct(), "found"))
