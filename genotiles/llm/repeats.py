"""Repeated byte strings: a depth-limited radix sort of suffixes, most significant digit first.

Every suffix of at least `length` bytes is sorted through its first `length` bytes only, and a group that
has one member is dropped after each digit; what is left in a group after the last digit is a repeated string.

The digits are cut so that a shuffle carries runs of suffixes, not single ones:

1. First digit: the least hash among the `gram`-byte strings inside the suffix's first `length` bytes. Equal
   strings have equal digits, and neighbouring suffixes mostly share theirs, so a run of suffixes travels as
   one row (digit, digest of the bytes that the run covers). A digit that one run holds alone is done.
2. Second digit: the digest. Runs of equal digits and digests repeat in all their suffixes, without being
   looked at again. A copied passage, however often it occurs, ends here.
3. Last digit: runs that share the first digit but differ in the second bring their bytes, one run for each
   different content, and all their suffixes are ordered through `length` bytes within the group. Groups
   of more than `group` runs are ordered by Spark, a row for each suffix.

Removed are all bytes that a repeated string covers, in all places where it occurs.

Cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; strings of one text may
overlap (a text of 300 equal bytes goes as a whole); repeated rows and ids: every row is a place of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from genotiles.llm.groups import complete_groups
from genotiles.llm.tables import lean, written
from genotiles.llm.tokens import BYTE, column_of, mix, signed, text_bytes

_FACTOR = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1
#: Bytes of one text hashed at once.
_CHUNK = 1 << 21


@dataclass(frozen=True)
class RepeatOptions:
    #: Bytes of a string that counts as repeated.
    length: int = 200
    #: Bytes of the strings whose least hash is the first digit.
    gram: int = 64
    #: Different runs of one first digit that are ordered in one task.
    group: int = 20_000


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every string of gram bytes, by doubling."""
    h = BYTE[data]
    done, factor, out, out_len = 1, _FACTOR, None, 0
    while True:
        if gram & done:
            if out is None:
                out, out_len = h, done
            else:
                n = len(data) - out_len - done + 1
                out = out[:n] * np.uint64(pow(_FACTOR, done, 1 << 64)) + h[out_len : out_len + n]
                out_len += done
        if done * 2 > gram:
            return mix(out)
        h = h[: len(h) - done] * np.uint64(factor) + h[done:]
        factor = factor * factor & _WORD
        done *= 2


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every width neighbours, in one pass each way over blocks of width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, values[-1], dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = best.accumulate(grid, axis=1).ravel()
    back = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, options: RepeatOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first digit, first suffix, end suffix, digit occurs twice) of the runs of a text of enough bytes."""
    width = options.length - options.gram + 1
    hashes = gram_hashes(data, options.gram)
    least = _sliding(hashes, width, np.minimum)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    end = np.append(first[1:], len(least))
    # A gram is an anchor where some suffix has chosen it; a run may hold two anchors of its own digit.
    reach = np.concatenate((np.repeat(least[:1], width - 1), least, np.repeat(least[-1:], width - 1)))
    anchors = np.flatnonzero(_sliding(reach, width, np.maximum) == hashes)
    low = np.searchsorted(anchors, first)
    count = np.searchsorted(anchors, end - 1 + width) - low
    begin = np.cumsum(count) - count
    inside = hashes[anchors[np.arange(int(count.sum())) - np.repeat(begin - low, count)]]
    several = np.add.reduceat(inside == np.repeat(least[first], count), begin) > 1
    return least[first], first, end, several


def _run_batches(options: RepeatOptions):
    """(digit, digest, doc, twin, first, suffixes, several) of every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _CHUNK - options.length + 1
        for batch in batches:
            parts, digests, rows = [], [], []
            for row, text in enumerate(column_of(batch, "text").cast(pa.binary())):
                buffer = text.as_buffer()
                for at in range(0, 0 if buffer is None else max(0, buffer.size - options.length + 1), step):
                    view = memoryview(buffer)[at : at + _CHUNK]
                    digit, first, end, several = runs(np.frombuffer(view, np.uint8), options)
                    stop = end + (options.length - 1)
                    digests += [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)]
                    parts.append((digit, first + at, end - first, several))
                    rows.append(np.full(len(first), row))
            if not parts:
                continue
            digit, first, suffixes, several = (np.concatenate(p) for p in zip(*parts, strict=True))
            place = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(digit)), pa.array(signed(np.array(digests, np.uint64))),
                    column_of(batch, "doc").take(place), column_of(batch, "twin").take(place),
                    pa.array(first, pa.int64()), pa.array(suffixes, pa.int32()), pa.array(several),
                ],
                names=["digit", "digest", "doc", "twin", "first", "suffixes", "several"],
            )
    return run


@lean
def _bring_bytes(options: RepeatOptions):
    """For each asked run of a text its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            columns: dict[str, list] = {"digit": [], "digest": [], "bytes": []}
            for packed, asked in zip(column_of(batch, "packed"), column_of(batch, "asked").to_pylist(), strict=True):
                text = reader.decompress(packed.as_py())
                columns["digit"] += [r["digit"] for r in asked]
                columns["digest"] += [r["digest"] for r in asked]
                columns["bytes"] += [text[r["first"] : r["first"] + r["suffixes"] + options.length - 1] for r in asked]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in columns.items()], names=list(columns)
            )
    return run


def _ordered(table: pa.Table, options: RepeatOptions) -> pa.RecordBatch:
    """Of complete groups: the suffixes that occur twice, as ranges within their run."""
    data, starts = text_bytes(table["bytes"])
    spans = np.diff(starts) - (options.length - 1)
    run = np.repeat(np.arange(len(spans)), spans)
    at = np.arange(len(run)) - np.repeat(np.cumsum(spans) - spans, spans)
    string = gram_hashes(data, options.length)[starts[run] + at]
    digit = table["digit"].to_numpy()
    order = np.lexsort((digit[run], string))
    same = (string[order][1:] == string[order][:-1]) & (digit[run][order][1:] == digit[run][order][:-1])
    hit = np.zeros(len(run), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    new_run = np.concatenate(([True], run[1:] != run[:-1]))
    before = np.concatenate(([False], hit[:-1])) & ~new_run
    after = np.concatenate((hit[1:] & ~new_run[1:], [False]))
    low, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    return pa.RecordBatch.from_arrays(
        [pa.array(digit[run[low]]), pa.array(table["digest"].to_numpy()[run[low]]), pa.array(at[low]), pa.array(at[last] + 1)],
        names=["digit", "digest", "low", "high"],
    )


@lean
def _order_groups(options: RepeatOptions):
    """Rows sorted by digit, many groups at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, ("digit",)):
            yield _ordered(table, options)
    return run


@lean
def _single_suffixes(options: RepeatOptions):
    """A row for each suffix of runs in groups too large for a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digit, digest, text in zip(*(column_of(batch, c).to_pylist() for c in ("digit", "digest", "bytes")), strict=True):
                n = len(text) - options.length + 1
                strings = [xxhash.xxh3_128_digest(text[i : i + options.length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digit] * n, pa.int64()), pa.array([digest] * n, pa.int64()),
                        pa.array(range(n), pa.int64()), pa.array(strings, pa.binary()),
                    ],
                    names=["digit", "digest", "low", "string"],
                )
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: half the bytes of a shuffle."""
    writer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = column_of(batch, "text").cast(pa.binary()).fill_null(b"")
        packed = pa.array([writer.compress(t.as_buffer()) for t in texts], pa.binary())
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in others), packed], names=[*others, "packed"])


def merged(low: list[int], high: list[int], limit: int) -> list[tuple[int, int]]:
    """The union of byte ranges, ascending and apart."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(zip(low, high, strict=True)):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], min(j, limit)))
        else:
            out.append((i, min(j, limit)))
    return out


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes, kept, spans = [], [], []
        for packed, ranges in zip(column_of(batch, "packed"), column_of(batch, "ranges").to_pylist(), strict=True):
            text = reader.decompress(packed.as_py())
            cut = merged([r["low"] for r in ranges or ()], [r["high"] for r in ranges or ()], len(text))
            edges = [0, *(x for span in cut for x in span), len(text)]
            kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(text))
            spans.append([{"low": i, "high": j} for i, j in cut])
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                column_of(batch, "rest"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
            ],
            names=["rest", "n_bytes", "spans", "kept", "kept_sha256", "kept_text"],
        )


#: A row's identity: its id and the hash of its text. Equal rows share it, and all else that is computed.
_PLACE = ("doc", "twin")
_GROUP = "digit long, digest long, low long, high long"


def _placed(documents: DataFrame) -> DataFrame:
    """doc, twin, rest (all columns but the text) and text."""
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("twin"), F.struct(*others).alias("rest"), "text",
    )


def _repeated_ranges(texts: DataFrame, options: RepeatOptions) -> DataFrame:
    """(doc, twin, low, high): byte ranges that repeated strings cover; they may overlap."""
    found = texts.select(*_PLACE, "text").mapInArrow(
        _run_batches(options), "digit long, digest long, doc long, twin long, first long, suffixes int, several boolean"
    )
    digits = found.groupBy("digit").agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"), F.max("several").alias("within"),
    ).where("n > 1 OR within")
    alike = (F.col("least") == F.col("most")) & ~F.col("within")
    met = written(found.drop("several").join(digits.select("digit", alike.alias("alike")), "digit"), "runs")
    high = F.col("first") + F.col("suffixes") + (options.length - 1)
    whole = met.where("alike").select(*_PLACE, F.col("first").alias("low"), high.alias("high"))

    open_runs = met.where("NOT alike")
    contents = open_runs.groupBy("digit", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE, "first", "suffixes")).alias("at")
    )
    asked = contents.select("digit", "digest", "at.*").groupBy(*_PLACE).agg(
        F.collect_list(F.struct("digit", "digest", "first", "suffixes")).alias("asked")
    )
    packed = texts.select(*_PLACE, "text").mapInArrow(_pack, "doc long, twin long, packed binary")
    brought = written(
        packed.join(asked, list(_PLACE)).select("packed", "asked")
        .mapInArrow(_bring_bytes(options), "digit long, digest long, bytes binary").dropDuplicates(["digit", "digest"]), "bytes",
    )
    large = brought.groupBy("digit").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > options.group).select("digit")
    small = (
        brought.join(large, "digit", "left_anti").repartition("digit").sortWithinPartitions("digit")
        .mapInArrow(_order_groups(options), _GROUP)
    )
    single = brought.join(large, "digit").mapInArrow(_single_suffixes(options), "digit long, digest long, low long, string binary")
    twice = single.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    rest = single.join(twice, "string").select("digit", "digest", "low", (F.col("low") + 1).alias("high"))
    copied = contents.where("n > 1").select("digit", "digest")
    again = open_runs.join(copied, ["digit", "digest"], "left_semi").select(*_PLACE, F.col("first").alias("low"), high.alias("high"))
    shifted = open_runs.join(small.union(rest), ["digit", "digest"]).select(
        *_PLACE, (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + (options.length - 1)).alias("high")
    )
    return whole.union(again).union(shifted)


def without_repeats(documents: DataFrame, options: RepeatOptions | None = None) -> DataFrame:
    """rest (a struct of all columns but the text), n_bytes, spans (removed byte ranges, each a maximal run),
    kept (the remaining bytes), kept_sha256 and kept_text (their whole letters) of every document."""
    options = options or RepeatOptions()
    texts = _placed(documents)
    ranges = _repeated_ranges(texts, options).groupBy(*_PLACE).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    packed = texts.mapInArrow(_pack, StructType([*(f for f in texts.schema.fields if f.name != "text"), StructField("packed", BinaryType())]))
    kind = texts.schema["rest"].dataType.simpleString()
    return packed.join(ranges, list(_PLACE), "left").select("rest", "packed", "ranges").mapInArrow(
        _removals, f"rest {kind}, n_bytes long, spans array<struct<low: long, high: long>>, kept binary, kept_sha256 string, kept_text string"
    )


def shortened(documents: DataFrame, options: RepeatOptions | None = None) -> DataFrame:
    """The documents with repeated strings cut out of their texts, and n_chars, where there is one, counted anew.

    A letter that is cut in the middle goes as a whole; a null text becomes empty; no row is dropped.
    """
    result = without_repeats(documents, options).withColumn("text", F.col("kept_text"))
    columns = []
    for c in documents.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.length("text").cast(documents.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("rest").getField(c).alias(c))
    return result.select(*columns)


def repeat_report(documents: DataFrame, options: RepeatOptions | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["high"] - s["low"])
    return without_repeats(documents.select("doc_id", "text"), options).select(
        "rest.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
