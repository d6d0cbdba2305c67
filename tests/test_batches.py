"""Task functions that work on Arrow batches do not depend on where a batch ends."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genotiles.functions.arrays import one_hot_arrow, one_hot_numpy
from genotiles.operators import collapse, examples

CELLS = st.lists(
    st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 2), st.integers(0, 2), st.integers(0, 3)),
    min_size=1, max_size=40, unique=True,
)


def expected_tiles(cells, tracks, tile_bins):
    out = {}
    for value, (chrom, tile, track, at) in enumerate(cells, 1):
        out.setdefault((chrom, tile), np.zeros((tracks, tile_bins)))[track, at] = value
    return out


@settings(max_examples=80, deadline=None)
@given(CELLS, st.integers(1, 9), st.sampled_from([1, 12, 1 << 24]))
def test_tiles_over_batch_ends(cells, batch_rows, max_cells):
    tracks, tile_bins = 3, 4
    expected = expected_tiles(cells, tracks, tile_bins)
    value = {cell: i for i, cell in enumerate(cells, 1)}
    ordered = sorted(cells, key=lambda c: c[:2])
    table = pa.table({
        "chrom": [c[0] for c in ordered], "tile": pa.array([c[1] for c in ordered], pa.int64()),
        "track": pa.array([c[2] for c in ordered], pa.int64()),
        "bin": pa.array([c[1] * tile_bins + c[3] for c in ordered], pa.int64()),
        "mean": pa.array([value[c] for c in ordered], pa.float32()),
        "n_tracks": pa.array([tracks] * len(ordered), pa.int64()),
    }).combine_chunks()
    before, examples.MAX_BATCH_CELLS = examples.MAX_BATCH_CELLS, max_cells
    try:
        batches = list(examples._fill_tiles(tile_bins)(iter(table.to_batches(max_chunksize=batch_rows))))
    finally:
        examples.MAX_BATCH_CELLS = before
    found = [(r["chrom"], r["tile"], np.array(r["vals"])) for b in batches for r in b.to_pylist()]
    assert [(c, t) for c, t, _ in found] == sorted(expected)
    for chrom, tile, matrix in found:
        np.testing.assert_array_equal(matrix, expected[(chrom, tile)])


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield spark
    spark.conf.set(key, before)


def test_arrow_functions_with_small_batches(small_batches):
    spark = small_batches
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ACGTNé"), n)) for n in [5, 5, 5, 0, 3, 9, 9, 9, 9, 1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    for r in frame.select("s", one_hot_arrow("s").alias("x")).collect():
        np.testing.assert_array_equal(np.array(r["x"]).reshape(4, -1), one_hot_numpy(r["s"]))
    values = [rng.integers(0, 3, n).astype(float).tolist() for n in [0, 4, 4, 1, 7, 0, 2, 9]]
    lists = spark.createDataFrame(list(enumerate(values)), "i int, v array<double>").coalesce(1)
    for r in lists.select("v", collapse.runs(F.col("v"), 0.0).alias("runs")).collect():
        assert [x for run in r["runs"] for x in [run["total"] / run["n"]] * run["n"]] == r["v"]
        assert [run["at"] for run in r["runs"]] == list(np.cumsum([0] + [run["n"] for run in r["runs"]])[:-1])


def test_runs_of_lists_behind_nulls_and_slices(spark):
    frame = spark.createDataFrame([(0, None, [1.0, 1.0, 2.0]), (1, [3.0], None)], "i int, a array<double>, b array<double>")
    both = frame.select("i", F.coalesce("a", F.slice("b", 2, 2)).alias("v"))
    found = {r["i"]: [(x["at"], x["n"], x["total"]) for x in r["runs"]] for r in both.select("i", collapse.runs(F.col("v"), 0.0).alias("runs")).collect()}
    assert found == {0: [(0, 1, 1.0), (1, 1, 2.0)], 1: [(0, 1, 3.0)]}


def test_one_hot_holds_a_batch_about_once():
    texts = pa.array(["ACGTn" * n for n in range(200, 1200)])
    size = sum(map(len, texts.to_pylist()))
    tracemalloc.start()
    try:
        made = one_hot_arrow.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == 1000 and len(made.flatten().flatten()) == 4 * size
    # Letters as text, joined and as codes, and four bytes of result for each.
    assert peak < 9 * size


def test_one_hot_rows_hold_no_nulls(spark):
    kind = spark.createDataFrame([("acGT",)], "s string").select(one_hot_arrow("s").alias("x")).schema["x"].dataType
    assert not kind.containsNull and not kind.elementType.containsNull
