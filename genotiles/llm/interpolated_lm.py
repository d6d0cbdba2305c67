"""Language-model scores by deleted interpolation.

Tokens are words and one end per text. The probability of a token w after v mixes three estimates,

    a0 / (V + 1)  +  a1 * c(w) / N  +  a2 * c(v w) / c(v),

with weights by bucket of c(v) (its number of bits). Counts come from the training texts. The weights are learned
by expectation-maximisation on a slice of the training texts whose counts are deleted: for it, counts come from
the rest of the training texts only. Then all training texts count.

How it runs: texts become blocks of about `block_tokens` tokens, written once with their words as ranks. Each block
asks, by hash range, for the counts of its distinct words and word pairs; a range sums the counts of all
blocks and answers each in its own order. So a word or pair, however common, travels once per block and range,
and no table of the corpus is ever in one place. The slice's tokens meet as counts by (bucket, binned estimates),
whose number the bins bound; only these and the totals reach the driver.

Words and pairs are told apart by 64-bit hashes.

Cases: null and empty texts are the end alone; without training texts N = V = 0 and every token gets a0 = 1;
without a slice the weights are equal; repeated rows are scored, and counted, each; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.labelled import held_out
from genotiles.llm.tables import written
from genotiles.llm.tokens import column_of, combine, pieces, words

#: The end of a text, and what precedes its first word.
END, START = np.uint64(0x1234567887654321), np.uint64(0x8765432112345678)
BUCKETS, _BINS = 41, 128
_WORD, _PAIR = 1, 2


@dataclass(frozen=True)
class LmOptions:
    modulus: int = 5
    remainder: int = 1
    #: One in so many training texts teaches the weights.
    slice_of: int = 10
    block_tokens: int = 1 << 20
    #: Distinct words or pairs that one range answers for, about.
    range_entries: int = 1 << 20
    rounds: int = 200


def _planes(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: leading zeros cost nothing."""
    raw = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _from_planes(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return raw.reshape(size, len(raw) // size).T.copy().view(dtype).ravel()


def _block_batches(options: LmOptions):
    """Texts as blocks; those of the slice and all others in blocks of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(deleted: bool) -> pa.RecordBatch:
            tokens, count, ids, train = (np.concatenate(x) for x in zip(*waiting[deleted], strict=True))
            waiting[deleted], size[deleted] = [], 0
            known, place, often = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            taught = int(count[train].sum())
            return pa.RecordBatch.from_pydict({
                "block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "deleted": [deleted],
                "train_tokens": pa.array([taught], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64())),
                "held": pa.array([(~train).tolist()], pa.list_(pa.bool_())), "counts": [count.astype("<i8").tobytes()],
                "words": [known[order].astype("<u8").tobytes()], "ranks": [_planes(rank[place])],
            })

        for batch in batches:
            role = column_of(batch, "role").to_numpy()
            docs = column_of(batch, "doc_id")
            # A null id has its place in `ids` as null; numpy carries positions, not ids.
            for low, high, data, starts in pieces(column_of(batch, "text")):
                found = words(data, starts)
                per_row = np.diff(found.first()) + 1
                end_at = np.cumsum(per_row) - 1
                tokens = np.full(int(per_row.sum()), END, np.uint64)
                inner = np.ones(len(tokens), dtype=bool)
                inner[end_at] = False
                tokens[inner] = found.hash
                ids = np.array(docs.slice(low, high - low).to_pylist(), dtype=object)
                row_of = np.repeat(np.arange(high - low), per_row)
                for deleted in (False, True):
                    mine = (role[low:high] == 2) == deleted
                    if mine.any():
                        part = tokens[mine[row_of]]
                        waiting[deleted].append((part, per_row[mine], ids[mine], role[low:high][mine] > 0))
                        size[deleted] += len(part)
                        if size[deleted] >= options.block_tokens:
                            yield flush(deleted)
        for deleted in (False, True):
            if waiting[deleted]:
                yield flush(deleted)
    return run


_BLOCK = (
    "block long, deleted boolean, train_tokens long, ids array<long>, held array<boolean>, counts binary, words binary,"
    " ranks binary"
)


@dataclass
class _Block:
    """A block's tokens: row, word's number among the sorted distinct words, pair's among the distinct pairs."""

    row: np.ndarray
    train: np.ndarray
    word: np.ndarray
    known: np.ndarray
    pair: np.ndarray
    pairs: np.ndarray
    context: np.ndarray


def _open(counts: bytes, held: list[bool], known: bytes, ranks: bytes) -> _Block:
    count = np.frombuffer(counts, "<i8")
    by_rank = np.frombuffer(known, "<u8")
    order = np.argsort(by_rank)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    word = number[_from_planes(ranks, np.uint32)]
    known = by_rank[order]
    tokens = known[word]
    first = np.cumsum(count) - count
    before = np.concatenate((tokens[:1], tokens[:-1]))
    before[first] = START
    pairs, pair = np.unique(combine([before, tokens]), return_inverse=True)
    # The number of texts is the count of their ends, so the start's count is the end's.
    end = int(np.searchsorted(known, END))
    context = np.concatenate((word[:1], word[:-1]))
    context[first] = end
    row = np.repeat(np.arange(len(count)), count)
    return _Block(row, ~np.array(held, dtype=bool), word, known, pair, pairs, context)


def _questions(options: LmOptions, bits: int):
    """Per block, kind and hash range: the distinct hashes and how often the block's training texts have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
        for batch in batches:
            for block, deleted, _, _, held, counts, known, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = _open(counts, held, known, ranks)
                taught = b.train[b.row]
                for kind, hashes, place in ((_WORD, b.known, b.word), (_PAIR, b.pairs, b.pair)):
                    number = np.bincount(place[taught], minlength=len(hashes)).astype(np.uint32)
                    cuts = np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))
                    some = np.flatnonzero(np.diff(cuts))
                    gaps = [np.diff(hashes[cuts[p] : cuts[p + 1]], prepend=np.uint64(0)) for p in some]
                    yield pa.RecordBatch.from_pydict({
                        "kind": pa.array([kind] * len(some), pa.int32()), "part": pa.array(some, pa.int32()),
                        "block": pa.array([block] * len(some), pa.int64()), "deleted": [deleted] * len(some),
                        "hashes": [_planes(g) for g in gaps],
                        "counts": [_planes(number[cuts[p] : cuts[p + 1]]) for p in some],
                    })
    return run


def _answer(table: pa.Table) -> pa.Table:
    """All questions of one range: each block's counts over all training texts, and for the slice over the rest.

    The row of block -1 has the number of distinct words with a count.
    """
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    hashes = [np.cumsum(_from_planes(h, np.uint64), dtype=np.uint64) for h in table["hashes"].to_pylist()]
    counts = [_from_planes(c, np.uint32).astype(np.int64) for c in table["counts"].to_pylist()]
    deleted = table["deleted"].to_pylist()
    size = [len(h) for h in hashes]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    number = np.concatenate(counts)
    every = np.bincount(place, number).astype(np.uint64)
    rest = every - np.bincount(place, number * np.repeat(deleted, size)).astype(np.uint64)
    ends = np.cumsum(size)
    out = {"kind": [], "part": [], "block": [], "deleted": [], "every": [], "rest": [], "n_every": [], "n_rest": []}
    for block, gone, start, end in zip(table["block"].to_pylist(), deleted, ends - size, ends, strict=True):
        own = place[start:end]
        reply = (kind, part, block, gone, _planes(every[own]), _planes(rest[own]) if gone else None, 0, 0)
        for name, value in zip(out, reply, strict=True):
            out[name].append(value)
    for name, value in zip(out, (kind, part, -1, False, b"", None, (every > 0).sum(), (rest > 0).sum()), strict=True):
        out[name].append(value)
    return pa.table(out, schema=pa.schema([
        ("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("deleted", pa.bool_()),
        ("every", pa.binary()), ("rest", pa.binary()), ("n_every", pa.int64()), ("n_rest", pa.int64()),
    ]))


_ANSWER = "kind int, part int, block long, deleted boolean, every binary, rest binary, n_every long, n_rest long"


def _estimates(b: _Block, answers: pa.Table, column: str, total: int):
    """Per token: c(w), c(v), and the estimates c(w) / N and c(v w) / c(v)."""
    found = {}
    order = np.argsort(answers["part"].to_numpy(), kind="stable")
    kinds, data = answers["kind"].to_numpy()[order], answers[column].to_pylist()
    for kind in (_WORD, _PAIR):
        found[kind] = np.concatenate([_from_planes(data[i], np.uint64) for i, k in zip(order, kinds, strict=True) if k == kind])
    seen = found[_WORD].astype(float)[b.word]
    before = found[_WORD].astype(float)[b.context]
    both = found[_PAIR].astype(float)[b.pair]
    return seen, before, seen / max(total, 1), both / np.maximum(before, 1)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else the number of bits of the count."""
    return np.minimum(np.frexp(count)[1], BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """Quarters of a power of two; the last bin is zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.floor(-4 * np.log2(p)), _BINS - 1), _BINS).astype(np.int64)


def _slice_cells(total: int):
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"bucket": np.zeros(0, np.int64), "b1": np.zeros(0, np.int64), "b2": np.zeros(0, np.int64)}
        sums = [np.zeros(0)] * 3
        if blocks.num_rows and answers.num_rows:
            b = _open(*(blocks[c][0].as_py() for c in ("counts", "held", "words", "ranks")))
            _, before, p1, p2 = _estimates(b, answers, "rest", total)
            cell = (bucket_of(before) * (_BINS + 1) + _bin(p1)) * (_BINS + 1) + _bin(p2)
            cells, place = np.unique(cell, return_inverse=True)
            out = {"bucket": cells // (_BINS + 1) ** 2, "b1": cells // (_BINS + 1) % (_BINS + 1), "b2": cells % (_BINS + 1)}
            sums = [np.bincount(place, w, len(cells)).astype(float) for w in (np.ones(len(place)), p1, p2)]
        return pa.table(out | dict(zip(("n", "p1", "p2"), sums, strict=True)))
    return run


def learn_weights(
    bucket: np.ndarray, n: np.ndarray, p0: float, p1: np.ndarray, p2: np.ndarray, rounds: int
) -> np.ndarray:
    """Weights by bucket (rows) from n tokens with the estimates p0, p1 and p2, by expectation-maximisation.

    One token's worth of evidence for equal weights keeps every weight above zero. A context never
    seen has no pairs, so the third weight of bucket 0 is zero.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0.5, 0.5, 0)
    p = np.stack([np.full(len(n), p0), p1, p2], axis=1)
    prior = (weights > 0) / (weights > 0).sum(axis=1, keepdims=True)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = prior.copy()
        np.add.at(new, bucket, share)
        new *= weights > 0
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - weights).max() < 1e-9:
            return new
        weights = new
    return weights


def _score_block(weights: np.ndarray, total: int, distinct: int):
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _SCORES.empty_table()
        b = _open(*(blocks[c][0].as_py() for c in ("counts", "held", "words", "ranks")))
        seen, before, p1, p2 = _estimates(b, answers, "every", total)
        mix = weights[bucket_of(before)]
        p = mix[:, 0] / (distinct + 1) + mix[:, 1] * p1 + mix[:, 2] * p2
        base = np.log10((seen + 0.5) / (total + 0.5 * (distinct + 1)))
        rows = len(b.train)
        return pa.table({
            "doc_id": pa.array(blocks["ids"][0].as_py(), pa.int64()), "held_out": pa.array(~b.train),
            "n_tokens": pa.array(np.bincount(b.row, minlength=rows)),
            "n_known": pa.array(np.bincount(b.row, seen > 0, rows).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, total)),
            "base_score": pa.array(np.bincount(b.row, base, rows)), "score": pa.array(np.bincount(b.row, np.log10(p), rows)),
        }, schema=_SCORES)
    return run


_SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])
_SCORES_SQL = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def lm_scores(documents: DataFrame, options: LmOptions | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    options = options or LmOptions()
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    in_slice = F.floor(crc / options.modulus) % options.slice_of == 0
    role = F.when(held_out("doc_id", options.modulus, options.remainder), 0).when(in_slice, 2).otherwise(1)
    texts = documents.select(F.col("doc_id").cast("long"), "text", role.cast("int").alias("role"))
    blocks = written(texts.mapInArrow(_block_batches(options), _BLOCK), "blocks")
    totals = blocks.agg(
        F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("every"),
        F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("train_tokens"))), F.lit(0)).alias("rest"),
        F.count(F.lit(1)).alias("blocks"),
    ).first()
    # Pairs are the larger table: about as many as tokens, of which a block has block_tokens.
    entries = totals["blocks"] * options.block_tokens
    bits = max(0, (entries // options.range_entries).bit_length())
    asked = blocks.mapInArrow(
        _questions(options, bits), "kind int, part int, block long, deleted boolean, hashes binary, counts binary"
    )
    answers = written(asked.groupBy("kind", "part").applyInArrow(_answer, _ANSWER), "answers")
    found = answers.where(f"block = -1 AND kind = {_WORD}").agg(F.sum("n_every").alias("every"), F.sum("n_rest").alias("rest")).first()
    distinct, distinct_rest = found["every"] or 0, found["rest"] or 0
    replies = answers.where("block >= 0").drop("n_every", "n_rest")
    cells = (
        blocks.where("deleted").groupBy("block").cogroup(replies.where("deleted").groupBy("block"))
        .applyInArrow(_slice_cells(totals["rest"]), "bucket long, b1 long, b2 long, n double, p1 double, p2 double")
        .groupBy("bucket", "b1", "b2").agg(*(F.sum(c).alias(c) for c in ("n", "p1", "p2"))).orderBy("bucket", "b1", "b2").toPandas()
    )
    n = cells["n"].to_numpy(float)
    weights = learn_weights(
        cells["bucket"].to_numpy(np.int64), n, 1 / (distinct_rest + 1), cells["p1"].to_numpy(float) / np.maximum(n, 1),
        cells["p2"].to_numpy(float) / np.maximum(n, 1), options.rounds,
    )
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _score_block(weights, totals["every"], distinct), _SCORES_SQL
    )
