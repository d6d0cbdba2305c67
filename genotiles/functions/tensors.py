"""Kernels on nested arrays ``[T][B]``, a batch of rows at a time on the flat Arrow buffers.

Rows of one shape are one block of numbers; a batch may hold several shapes. NULL rows stay NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genotiles.functions.signal import SQUASH_POWER

#: Cells worked on at once: few enough for a core's cache, many enough for small rows.
BLOCK_CELLS = 1 << 18


def blocks(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their values [n][T][B]) for every shape among a column's rows, cut to ``BLOCK_CELLS``.

    A row whose inner arrays differ in length is an error. NULL values of a float column come as NaN.
    """
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    outer = pc.list_value_length(column).drop_null().to_numpy().astype(np.int64)
    inner_lists = column.flatten()
    if inner_lists.null_count:
        raise ValueError("a matrix holds a NULL row")
    inner = pc.list_value_length(inner_lists).to_numpy().astype(np.int64)
    values = inner_lists.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(outer) - outer
    width = np.zeros(len(outer), np.int64)
    filled = outer > 0
    width[filled] = inner[first[filled]]
    if (inner != np.repeat(width, outer)).any():
        raise ValueError("the rows of a matrix differ in length")
    size = outer * width
    start = np.cumsum(size) - size
    out = []
    for shape in np.unique(np.stack([outer, width], axis=1), axis=0):
        alike = np.flatnonzero((outer == shape[0]) & (width == shape[1]))
        step = max(1, BLOCK_CELLS // max(1, int(shape.prod())))
        for at in range(0, len(alike), step):
            part = alike[at : at + step]
            if part[-1] - part[0] + 1 == len(part):
                flat = values[start[part[0]] : start[part[-1]] + size[part[-1]]]
            else:
                flat = np.concatenate([values[start[i] : start[i] + size[i]] for i in part])
            out.append((rows[part], flat.reshape(len(part), *shape)))
    return out


def nested(n: int, found: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """The float column of n rows whose values are given by :func:`blocks`; rows not given are NULL."""
    outer, inner = np.zeros(n, np.int64), np.zeros(n, np.int64)
    valid = np.zeros(n, dtype=bool)
    place: list[np.ndarray | None] = [None] * n
    for rows, values in found:
        valid[rows], outer[rows], inner[rows] = True, values.shape[1], values.shape[2]
        for row, value in zip(rows.tolist(), values, strict=True):
            place[row] = value
    one = len(found) == 1 and (np.diff(found[0][0]) == 1).all()
    parts = [v.reshape(-1) for v in place if v is not None]
    flat = found[0][1].reshape(-1) if one else np.concatenate(parts) if parts else np.zeros(0, np.float32)
    inner_ends = np.concatenate(([0], np.cumsum(np.repeat(inner, outer)))).astype(np.int32)
    outer_ends = np.concatenate(([0], np.cumsum(outer))).astype(np.int32)
    lists = pa.ListArray.from_arrays(inner_ends, pa.array(flat.astype(np.float32, copy=False)))
    return pa.ListArray.from_arrays(outer_ends, lists, mask=None if valid.all() else pa.array(~valid))


def cropped(values: np.ndarray, start: np.ndarray, length: int | None) -> np.ndarray:
    """Columns ``start`` to ``start + length`` of every row's matrix; a crop past the end is an error."""
    if length is None:
        return values
    if len(start) and start.max() + length > values.shape[2]:
        raise ValueError("a crop reaches past the end of a matrix")
    if len(start) and (start == start[0]).all():
        return values[:, :, start[0] : start[0] + length]
    return np.stack([matrix[:, at : at + length] for matrix, at in zip(values, start.tolist(), strict=True)])


def signal_values(
    values: np.ndarray, scale: np.ndarray, soft: np.ndarray, hard: np.ndarray, *,
    apply_scale: bool = True, apply_squash: bool = True, apply_clip: bool = True,
) -> np.ndarray:
    """:func:`genotiles.functions.signal.transform_value` on ``[n][T][B]`` with a vector entry per track."""
    x = values.astype(np.float64)
    x[~(np.isfinite(x) & (x > 0))] = 0.0
    by_track = lambda vector: vector[None, :, None]
    if apply_scale:
        x *= by_track(scale)
    if apply_clip:
        np.minimum(x, by_track(hard), out=x)
    if not apply_squash:
        return x
    x += 1.0
    np.power(x, SQUASH_POWER, out=x)
    x -= 1.0
    if apply_clip:
        knee = by_track(np.power(soft + 1.0, SQUASH_POWER) - 1.0)
        over = x > knee
        if over.any():
            at = np.broadcast_to(knee, x.shape)[over]
            x[over] = at - 1.0 + np.sqrt(np.maximum(x[over] - at + 1.0, 0.0))
    return x


_MATRIX = T.ArrayType(T.ArrayType(T.FloatType()))


def _kernel(work: Callable[[np.ndarray, np.ndarray], np.ndarray], turn: Callable[[np.ndarray], np.ndarray], length: int | None):
    """Arrow function of (matrix, start, flip): crop, work on the values, turn the rows that flip."""

    @F.arrow_udf(_MATRIX)
    def run(matrix: pa.Array, start: pa.Array, flip: pa.Array) -> pa.Array:
        starts, flips = start.to_numpy(zero_copy_only=False), flip.to_numpy(zero_copy_only=False).astype(bool)
        found = []
        for rows, values in blocks(matrix):
            out = np.ascontiguousarray(work(cropped(values, starts[rows], length), rows), dtype=np.float32)
            turned = flips[rows]
            if turned.any():
                out[turned] = turn(out[turned])
            found.append((rows, out))
        return nested(len(matrix), found)

    return run


def label_kernel(
    scale: Sequence[float], soft: Sequence[float], hard: Sequence[float], *,
    length: int | None, mates: Sequence[int] | None = None, **steps: bool,
) -> Callable[[Column, Column, Column], Column]:
    """Function of (labels, start, flip): crop, signal transform, and for rows that flip bins reversed and strands swapped."""
    vectors = [np.array(v, np.float64) for v in (scale, soft, hard)]
    order = None if mates is None else np.array(mates, np.int64)

    def work(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if values.shape[1] != len(vectors[0]):
            raise ValueError(f"labels of {values.shape[1]} tracks, vectors of {len(vectors[0])}")
        return signal_values(values, *vectors, **steps)

    def turn(values: np.ndarray) -> np.ndarray:
        reverse = values[:, :, ::-1]
        return reverse if order is None else reverse[:, order]

    return _kernel(work, turn, length)


def sequence_kernel(length: int | None) -> Callable[[Column, Column, Column], Column]:
    """Function of (one-hot sequence, start, flip): crop, and the reverse complement for rows that flip."""
    return _kernel(lambda values, rows: values, lambda values: values[:, ::-1, ::-1], length)


def top_places(target: np.ndarray, k: int) -> np.ndarray:
    """Of each row ``[n][B]`` the places of the k largest values, ties to the smaller place; NaN comes last."""
    n, width = target.shape
    if k >= width:
        return np.broadcast_to(np.arange(width), target.shape)
    low = -target
    if np.isnan(low).any():
        return np.argsort(low, axis=1, kind="stable")[:, :k]
    last = np.partition(low, k - 1, axis=1)[:, k - 1 : k]
    before, equal = low < last, low == last
    room = k - before.sum(axis=1, keepdims=True)
    chosen = before | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(chosen)[1].reshape(n, k)


#: Sums of one (example, track) over its bins, then over its top bins.
ROW_SUMS = tuple(f"{name}_{part}" for part in ("all", "top") for name in ("sum_p", "sum_t", "sum_pt", "sum_p2", "sum_t2"))


def row_sums(k: int) -> Callable[[Column, Column], Column]:
    """Function of (pred, target), arrays of one length: struct of :data:`ROW_SUMS`, ``n_all`` and ``n_top``.

    A row with a NULL value has NULL sums.
    """
    fields = [T.StructField(name, T.DoubleType()) for name in ROW_SUMS]
    counts = [T.StructField(name, T.LongType()) for name in ("n_all", "n_top")]

    @F.arrow_udf(T.StructType([*fields, *counts]))
    def run(pred: pa.Array, target: pa.Array) -> pa.Array:
        n = len(target)
        sums = np.full((len(ROW_SUMS), n), np.nan)
        size = pc.fill_null(pc.list_value_length(target), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        both = pc.and_(pred.is_valid(), target.is_valid())
        has_null = np.zeros(n, dtype=bool)
        for column in (pred, target):
            flat, parents = column.flatten(), pc.list_parent_indices(column)
            if flat.null_count:
                has_null[parents.filter(flat.is_null()).to_numpy()] = True
        known = both.to_numpy(zero_copy_only=False)
        if (pc.fill_null(pc.list_value_length(pred), 0).to_numpy(zero_copy_only=False)[known] != size[known]).any():
            raise ValueError("predictions and targets differ in length")
        wrap = lambda column: pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), column, mask=pc.invert(both))
        for (rows, p), (_, t) in zip(blocks(wrap(pred)), blocks(wrap(target)), strict=True):
            p, t = (x[:, 0, :].astype(np.float64) for x in (p, t))
            top = top_places(t, k)
            for part, (a, b) in enumerate(((p, t), (np.take_along_axis(p, top, 1), np.take_along_axis(t, top, 1)))):
                forms = (a, b, a * b, a * a, b * b)
                for i, form in enumerate(forms):
                    sums[5 * part + i, rows] = form.sum(axis=1)
        missing = pa.array(has_null | ~known)
        columns = [pc.if_else(missing, pa.scalar(None, pa.float64()), pa.array(s)) for s in sums]
        return pa.StructArray.from_arrays(
            [*columns, pa.array(size), pa.array(np.minimum(size, k))], names=[*ROW_SUMS, "n_all", "n_top"]
        )

    return run
