"""Array columns: one-hot sequences, crops, reverse complement, track permutation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genotiles.functions.memory import give_back

# Channel order of a one-hot sequence.
BASES = "ACGT"

# The letters' codes; a lower-case letter differs from its capital in this bit only.
_LETTERS = np.array([ord(base) for base in BASES], dtype=np.uint8)
_CASE_BIT = 0x20


def _letter_codes(text: str) -> np.ndarray:
    """One code per character, capitals; characters beyond Latin-1 become a code that no base has."""
    return np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8) & np.uint8(0xFF ^ _CASE_BIT)


def plain_bases(seq: Column) -> Column:
    """Lower-case bases to upper case; every other character stays as it is (length is kept)."""
    return F.translate(seq, BASES.lower(), BASES)


def one_hot(seq: Column) -> Column:
    """4 x L one-hot array by built-in expressions; anything but A, C, G, T is a zero column."""
    letters = F.split(plain_bases(seq), "")

    def channel(base: str) -> Column:
        return F.transform(letters, lambda letter: (letter == F.lit(base)).cast("tinyint"))

    return F.array(*[channel(base) for base in BASES])


def one_hot_numpy(seq: str, length: int | None = None) -> np.ndarray:
    """4 x L int8 matrix of one sequence, for code that runs inside a task."""
    hits = (_letter_codes(seq) == _LETTERS[:, None]).astype(np.int8)
    return hits if length is None else np.pad(hits, ((0, 0), (0, length - hits.shape[1])))


def one_hot_lists(seq: pa.Array) -> pa.Array:
    """4 x L one-hot array for long sequences: one Arrow buffer per batch, no objects per base.

    Letters are compared into the place of their channel, so a batch is in memory once.
    """
    texts = seq.to_pylist()
    lengths = np.array([len(text) for text in texts], dtype=np.int64)
    codes = _letter_codes("".join(texts))
    if len(texts) and (lengths == lengths[0]).all():
        by_row = codes.reshape(len(texts), 1, -1)
        values = (by_row == _LETTERS.reshape(1, -1, 1)).reshape(-1).view(np.int8)
    else:
        hits, end = np.empty(len(BASES) * len(codes), dtype=bool), 0
        for n in lengths:
            for letter in range(len(BASES)):
                at = len(BASES) * end + letter * n
                np.equal(codes[end:end + n], _LETTERS[letter], out=hits[at:at + n])
            end += n
        values = hits.view(np.int8)
    inner_ends = np.concatenate([[0], np.cumsum(np.repeat(lengths, len(BASES)))])
    outer_ends = np.arange(len(lengths) + 1) * len(BASES)
    inner = pa.ListArray.from_arrays(pa.array(inner_ends, pa.int32()), pa.array(values, pa.int8()))
    return pa.ListArray.from_arrays(pa.array(outer_ends, pa.int32()), inner)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ByteType(), False), False))
def one_hot_arrow(seq: pa.Array) -> pa.Array:
    """:func:`one_hot_lists` of a column; what the batch before has freed is given back first."""
    give_back()
    return one_hot_lists(seq)


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of a sequence string; unknown letters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def reverse_both_axes(matrix: Column) -> Column:
    """Reverse rows and columns. On a one-hot matrix this is the reverse complement."""
    return F.reverse(F.transform(matrix, F.reverse))


def reverse_bins(matrix: Column) -> Column:
    return F.transform(matrix, F.reverse)


def permute_rows(matrix: Column, permutation: Column) -> Column:
    """Row ``i`` of the result is row ``permutation[i]`` of the input."""
    return F.transform(permutation, lambda i: F.element_at(matrix, i + 1))


def crop_columns(matrix: Column, offset: Column, length: int) -> Column:
    """Same columns of every row."""
    return F.transform(matrix, lambda row: F.slice(row, offset + 1, length))


def draw(key: Column, seed: int, epoch: int, salt: str) -> Column:
    """Repeatable non-negative pseudo-random BIGINT per key (same value in a retried task)."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(epoch)), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
