"""Words, shingles and hashes of Arrow text columns, whole batches at a time with numpy.

Texts are UTF-8 bytes; only A-Z is lower-cased and only the bytes 0x20 and 0x09-0x0D separate words, so no
text is decoded. Null texts are empty. Hashes are 64-bit and depend on the bytes of one word alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes worked on at once; a longer text is one piece of its own.
PIECE_BYTES = 2 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x2545F4914F6CDD1D

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: One random-looking 64-bit number per byte.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row starts) of runs of rows of about limit bytes."""
    data, starts = text_bytes(column)
    row, end = 0, len(starts) - 1
    while row < end:
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1)
        yield row, stop, data[starts[row] : starts[stop]], starts[row : stop + 1] - starts[row]
        row = stop


@dataclass
class Words:
    """Words of a piece: byte ranges, hash and row (counted from the piece's first row)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    rows: int

    def first(self) -> np.ndarray:
        """Of each row its first word's number, and the number of words after the last row."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


#: Longest run hashed by a polynomial. Modulo 2^64 any base has equal sums for built runs of some 2^10 bytes.
_SHORT_RUN = 64


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of non-empty, disjoint, ascending byte ranges: a polynomial for short ones, XXH3 for the others."""
    long = np.flatnonzero(end - start > _SHORT_RUN)
    if not len(long):
        return _short_hashes(data, start, end)
    short = np.flatnonzero(end - start <= _SHORT_RUN)
    out = np.empty(len(start), np.uint64)
    out[short] = _short_hashes(data, start[short], end[short])
    view = memoryview(np.ascontiguousarray(data))
    out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def _short_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    inside = data[place + np.repeat(start, size)]
    return mix(np.add.reduceat(BYTE[inside] * powers(int(size.max()))[place], first) ^ size.astype(np.uint64))


def words(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> Words:
    """The words of a piece; a row's start always starts a word."""
    rows = len(starts) - 1
    inside = ~SPACE[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), none, rows)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(starts, start, side="right") - 1
    return Words(start, end, run_hashes(LOWER[data] if lower else data, start, end), row, rows)


def combine(columns: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of several, order counts."""
    out = np.full(len(columns[0]), salt + 1, dtype=np.uint64) * _GOLDEN
    for h in columns:
        out = mix(out ^ h) + _GOLDEN
    return out


def windows(found: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's number of every run of size words within a row."""
    n = len(found.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(found.row[:n] == found.row[size - 1 :])
    return combine([found.hash[at + i] for i in range(size)], salt), at


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle: runs of size words, or the whole row where it has fewer words."""
    h, at = windows(found, size)
    row = found.row[at]
    first = found.first()
    count = np.diff(first)
    more_h, more_row = [h], [row]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        more_h.append(combine([found.hash[first[short] + i] for i in range(n)], n))
        more_row.append(short)
    return np.concatenate(more_h), np.concatenate(more_row)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row and hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return h.view(np.int64)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
