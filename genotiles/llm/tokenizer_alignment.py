"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

A is a byte-level tokenizer of the tokenizers library and reads a space and the text; B is a sentencepiece model, which
adds that space itself. Where a token of A and one of B end at the same byte, both sides are cut; tokens between two cuts
are a group, and all pairs of a group are links. Common ends are found by galloping (`end_alignment`).

How it runs: texts are aligned a piece of a batch at a time. A piece becomes one row, a block: its texts' numbers, its
distinct linked id pairs, and which text has which of them how often. Blocks are written once. Each block adds one row per
distinct pair to the corpus-wide count of documents, and gets one row back, so a pair that every document holds costs a row
per block, not per document; the counts are never in one place.

Within a piece equal words are tokenized once. A text whose blanks stand alone between other characters is the sequence of
its words, each with the blank before it: A's pattern never joins across such a blank, and no piece of B has a blank after
another character. Other texts are tokenized whole.

Cases: texts that are null, empty, or not spelled by both sides' tokens (a U+2581 in the text, say) have no tokens: zeros and an
empty string. Rows with the same doc_id are documents of their own. A text longer than a piece is a block of its own. An
empty table gives an empty result. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.end_alignment import align, digit_table, linked_pairs, spelled_groups, within
from genotiles.llm.tables import lean, written
from genotiles.llm.tokens import column_of, pieces


@dataclass(frozen=True)
class AlignOptions:
    #: Files of the two tokenizers, at the same path on all executors.
    byte_level: str
    piece_model: str
    #: Bytes of text in a block, about.
    block_bytes: int = 8 << 20


#: Texts given to a tokenizer at once, and tokens aligned at once.
_CALL, _PART = 4096, 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """A tokenizer as ids of many texts, with every id's bytes."""

    def __init__(self, spelling: list[bytes | None]):
        # An id without bytes of its own (a control or unknown piece) can't be part of any text.
        self.spelling = [b"\xff\xff" if s is None else s for s in spelling]
        self.size = np.array([len(s) for s in self.spelling], np.int64)

    def call(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def many(self, texts: list[str], spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and whether a text's ids spell its bytes."""
        found = []
        for at in range(0, len(texts), _CALL):
            ids, wanted = self.call(texts[at : at + _CALL]), spelled[at : at + _CALL]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
            right = self._bytes(flat, count) == np.fromiter(map(len, wanted), np.int64, len(wanted))
            if not right.all() or b"".join([self.spelling[i] for i in flat.tolist()]) != b"".join(wanted):
                right = np.array([b"".join([self.spelling[i] for i in x]) == w for x, w in zip(ids, wanted, strict=True)], dtype=bool)
            found.append((flat, count, right))
        none = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))
        return tuple(np.concatenate(parts) for parts in zip(none, *found, strict=True))

    def _bytes(self, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.size[flat])))
        end = np.cumsum(count)
        return total[end] - total[end - count]


class _ByteLevel(_Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        spelling: list[bytes | None] = [None] * self.tokenizer.get_vocab_size()
        for entry, number in self.tokenizer.get_vocab().items():
            if all(letter in letters for letter in entry):
                spelling[number] = bytes(letters[letter] for letter in entry)
        super().__init__(spelling)

    def call(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class _Pieces(_Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        spelling: list[bytes | None] = []
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            if self.model.is_control(number) or self.model.is_unknown(number):
                spelling.append(None)
            elif self.model.is_byte(number):
                spelling.append(bytes([int(piece[3:5], 16)]))
            else:
                spelling.append(piece.replace("▁", " ").encode())
        # Texts may be cut before a blank only if no piece goes on with one.
        self.by_words = all(b" " not in s.lstrip(b" ") for s in spelling if s)
        super().__init__(spelling)

    def call(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Both:
    """Tokens of both sides for the texts of a piece."""

    def __init__(self, options: AlignOptions):
        self.a, self.b = _ByteLevel(options.byte_level), _Pieces(options.piece_model)
        self.b_ids = len(self.b.spelling)
        self.bits = (len(self.a.spelling) * self.b_ids - 1).bit_length()
        self.digits = digit_table(max(len(self.a.spelling), self.b_ids))

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which texts have tokens, and for both sides the ids of those texts and the tokens before each text's end."""
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        start = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        place = words.indices.to_numpy().astype(np.int64)
        known = words.dictionary.to_pylist()
        row = np.repeat(np.arange(len(texts)), np.diff(start))
        # Other blanks at a word's end could join with the blank beside them.
        alone = np.array([w != "" and w.strip() == w for w in known], dtype=bool)
        whole = np.zeros(len(texts), dtype=bool)
        whole[row[~alone[place]]] = True
        if not self.b.by_words:
            whole[:] = True
        # Words that only such texts hold are not needed.
        keep = np.zeros(len(known), dtype=bool)
        keep[place[~whole[row]]] = True
        number = np.cumsum(keep) - 1
        entries = [w for w, k in zip(known, keep.tolist(), strict=True) if k]
        n_words = len(entries)
        entries += texts.filter(pa.array(whole)).to_pylist()
        unit = number[place[~whole[row]]]
        unit_row = np.concatenate((row[~whole[row]], np.flatnonzero(whole)))
        unit = np.concatenate((unit, n_words + np.arange(len(entries) - n_words)))
        order = np.argsort(unit_row, kind="stable")
        unit, unit_row = unit[order], unit_row[order]
        spelled = [(" " + e).encode() for e in entries]
        a, b = self.a.many(entries, spelled), self.b.many(entries, spelled)
        right = a[2] & b[2] & np.array([e != "" for e in entries], dtype=bool)
        has = np.ones(len(texts), dtype=bool)
        has[unit_row[~right[unit]]] = False
        unit, unit_row = unit[has[unit_row]], unit_row[has[unit_row]]
        ids, ends = [], []
        for flat, size, _ in (a, b):
            count = size[unit]
            ids.append(flat[np.repeat((np.cumsum(size) - size)[unit], count) + within(count)])
            ends.append(np.cumsum(np.bincount(unit_row, count, len(texts)).astype(np.int64)))
        return has, ids, ends


_sides: dict[AlignOptions, _Both] = {}


def _both(options: AlignOptions) -> _Both:
    """One pair of tokenizers per worker."""
    if options not in _sides:
        _sides[options] = _Both(options)
    return _sides[options]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: pairs: distinct in the block, ascending; documents: how many of the block's texts hold each. ends, steps, times: of each
#: text, its pairs' places in `pairs` (the first, then distances) and how often each is linked.
_BLOCK = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pairs array<long>, documents array<int>, ends binary, steps binary, times binary"
)


def _parts(a_texts: np.ndarray, b_texts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with about _PART tokens."""
    ends, row = a_texts + b_texts, 0
    while row < len(ends):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + _PART, side="right")))
        yield row, stop
        row = stop


def _block(both: _Both, ids: pa.Array, texts: pa.Array) -> dict:
    has, (a, b), (a_texts, b_texts) = both.tokens(texts)
    digests, groups, links, keys, times = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low, high in _parts(a_texts, b_texts):
        a_low, b_low = (int(t[low - 1]) if low else 0 for t in (a_texts, b_texts))
        own_a, own_b = a[a_low : a_texts[high - 1]], b[b_low : b_texts[high - 1]]
        found = align(own_a, own_b, both.a.size[own_a], both.b.size[own_b], a_texts[low:high] - a_low, b_texts[low:high] - b_low)
        text, text_to = spelled_groups(found, both.digits)
        text_from = np.concatenate(([0], text_to[:-1]))
        digests += [
            hashlib.sha256(text[first : last - 1]).hexdigest() if there else ""
            for first, last, there in zip(text_from.tolist(), text_to.tolist(), has[low:high].tolist(), strict=True)
        ]
        upto = np.concatenate(([0], found.groups))
        groups.append(np.diff(upto))
        links.append(np.diff(np.concatenate(([0], np.cumsum(found.a_count * found.b_count)))[upto]))
        key, time = linked_pairs(found, both.b_ids, both.bits)
        keys.append(key + (low << both.bits))
        times.append(time)
    key, times = np.concatenate(keys), np.concatenate(times)
    row, code = key >> both.bits, key & ((1 << both.bits) - 1)
    pairs, place, documents = np.unique(code, return_inverse=True, return_counts=True)
    steps = np.diff(place, prepend=0)
    first = np.searchsorted(row, np.arange(len(has)))
    first = first[(first < len(row)) & has]
    steps[first] = place[first]
    return {
        "block": uuid.uuid4().int >> 65, "doc_id": ids.to_pylist(), "n_a": np.diff(a_texts, prepend=0),
        "n_b": np.diff(b_texts, prepend=0), "n_groups": np.concatenate(groups), "n_links": np.concatenate(links),
        "groups_sha256": digests, "pairs": pairs, "documents": documents.astype(np.int32),
        "ends": _packed(np.searchsorted(row, np.arange(len(has)), side="right")), "steps": _packed(steps), "times": _packed(times),
    }


@lean
def _blocks(options: AlignOptions, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(options)
        for batch in batches:
            ids, texts = column_of(batch, "doc_id"), column_of(batch, "text")
            for low, high, _, _ in pieces(texts, options.block_bytes):
                made = _block(both, ids.slice(low, high - low), texts.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in schema], schema=schema)
    return run


_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _answered(schema: pa.Schema):
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = {name: blocks[name][0] for name in blocks.column_names}
        answers = answers.sort_by("pair")
        count, best = answers["n"].to_numpy(), answers["best"].to_numpy()
        ends, steps, times = (_unpacked(block[c].as_py()) for c in ("ends", "steps", "times"))
        first = np.concatenate(([0], ends[:-1]))
        # Distances start anew with each text.
        place = np.cumsum(steps)
        before = np.concatenate(([0], place))[first]
        place -= np.repeat(before, ends - first)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (times * best[place], times * count[place])]
        out = {c: block[c].values for c in ("doc_id", *_COUNTS, "groups_sha256")}
        out |= {"n_best": pa.array(sums[0][ends] - sums[0][first]), "count_sum": pa.array(sums[1][ends] - sums[1][first])}
        return pa.table([out[f.name] for f in schema], schema=schema)
    return run


def aligned_blocks(documents: DataFrame, options: AlignOptions) -> DataFrame:
    """Blocks of aligned texts, written to the shared folder."""
    spark = documents.sparkSession
    schema = spark.createDataFrame([], _BLOCK).toArrow().schema
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    return written(texts.mapInArrow(_blocks(options, schema), _BLOCK), "aligned")


def pair_counts(blocks: DataFrame, b_ids: int) -> DataFrame:
    """(pair, a, b, n, best): in how many documents each id pair is linked; best: no pair of the same A id has more."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("held"))
    counts = held.groupBy(F.col("held.pairs").alias("pair")).agg(F.sum("held.documents").alias("n"))
    counts = counts.withColumn("a", F.expr(f"pair div {b_ids}")).withColumn("b", F.expr(f"pair % {b_ids}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    return counts.join(highest, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))


def align_tokenizers(documents: DataFrame, options: AlignOptions) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    blocks = aligned_blocks(documents, options)
    counts = written(pair_counts(blocks, len(_Pieces(options.piece_model).spelling)), "pair-counts")
    asked = blocks.select(F.col("block").alias("asker"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts.select("pair", "n", "best"), "pair")
    schema = documents.sparkSession.createDataFrame([], _ALIGNED).toArrow().schema
    return (
        blocks.drop("pairs", "documents").groupBy("block").cogroup(answers.groupBy("asker"))
        .applyInArrow(_answered(schema), _ALIGNED)
    )
