"""Kernels on nested arrays against plain numpy, row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genotiles.functions import tensors
from genotiles.functions.signal import transform_value

SHAPES = st.lists(st.one_of(st.none(), st.tuples(st.integers(0, 3), st.integers(0, 4))), max_size=8)


@settings(max_examples=200, deadline=None)
@given(SHAPES, st.integers(0, 3), st.sampled_from([1, 7, 1 << 18]))
def test_blocks_hold_every_row_and_nest_again(shapes, skip, cells):
    rng = np.random.default_rng(0)
    rows = [None if s is None else rng.normal(size=s).astype(np.float32).tolist() for s in shapes]
    column = pa.array([[[9.0]]] * skip + rows, pa.list_(pa.list_(pa.float32()))).slice(skip)
    before, tensors.BLOCK_CELLS = tensors.BLOCK_CELLS, cells
    try:
        found = tensors.blocks(column)
    finally:
        tensors.BLOCK_CELLS = before
    again = tensors.nested(len(rows), found).to_pylist()
    assert [r is None for r in again] == [r is None for r in rows]
    for a, b in zip(again, rows):
        if b and b[0]:
            np.testing.assert_array_equal(np.array(a, np.float32), np.array(b, np.float32))
        else:
            assert a == b


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.0, 1.0, 2.0, -1.0, float("nan"), float("inf")]), min_size=6, max_size=6), min_size=1, max_size=5), st.integers(1, 8))
def test_top_places_are_those_of_a_stable_sort(rows, k):
    target = np.array(rows)
    want = [sorted(range(6), key=lambda i: (np.isnan(r[i]), -r[i] if not np.isnan(r[i]) else 0, i))[:k] for r in target]
    assert [sorted(x) for x in tensors.top_places(target, k).tolist()] == [sorted(x) for x in want]


def test_ragged_matrices_and_wrong_shapes_are_errors():
    with pytest.raises(ValueError):
        tensors.blocks(pa.array([[[1.0], [1.0, 2.0]]]))
    with pytest.raises(ValueError):
        tensors.cropped(np.zeros((1, 2, 5)), np.array([3]), 4)


@pytest.mark.parametrize("steps", [{}, {"apply_scale": False}, {"apply_squash": False}, {"apply_clip": False}])
def test_signal_of_a_batch_equals_the_expression(spark, steps):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=60) * 30, [np.nan, np.inf, -np.inf, 0.0]])
    scale, soft, hard = 1.7, 4.0, 25.0
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    want = [r["x"] for r in frame.select("i", transform_value(F.col("v"), scale, soft, hard, **steps).alias("x")).orderBy("i").collect()]
    got = tensors.signal_values(values[None, None, :], *(np.array([x]) for x in (scale, soft, hard)), **steps)
    np.testing.assert_allclose(got[0, 0], want, rtol=1e-13)


def test_rows_with_nulls_have_null_sums(spark):
    frame = spark.createDataFrame(
        [(0, [1.0, 2.0], [3.0, 4.0]), (1, [1.0, None], [3.0, 4.0]), (2, None, [1.0]), (3, [], []), (4, [5.0], [6.0])],
        "i int, p array<double>, t array<double>",
    )
    got = {r["i"]: r["s"] for r in frame.select("i", tensors.row_sums(1)("p", "t").alias("s")).collect()}
    assert got[0]["sum_pt_all"] == 11.0 and got[0]["sum_p_top"] == 2.0 and (got[0]["n_all"], got[0]["n_top"]) == (2, 1)
    assert got[1]["sum_p_all"] is None and got[1]["sum_t_top"] is None and got[2]["sum_t_all"] is None
    assert got[3]["sum_t_all"] == 0.0 and got[3]["n_top"] == 0 and got[4]["sum_p2_top"] == 25.0
