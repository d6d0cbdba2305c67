"""Sums of intervals over bins, from profiles, against arrays with an entry per base."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genotiles.operators import binning, examples, profiles as P

SIGNAL = "track int, chrom string, start_pos bigint, end_pos bigint, value double"
BIN, TILE = 4, 3
SPAN = BIN * TILE
VALUES = st.sampled_from([0.0, -0.0, 1.0, -2.5, 1e9, 1e-6, 0.1, float("inf"), float("-inf")])
PIECES = st.lists(
    st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 1), st.integers(0, 2), st.integers(0, SPAN - 1), st.integers(1, SPAN), VALUES).filter(
        lambda p: p[3] < p[4]
    ),
    min_size=1, max_size=40,
)


def sums(pieces, edges):
    """(total, covered) between edges, base by base."""
    total, covered = [0.0] * (len(edges) - 1), [0] * (len(edges) - 1)
    for lo, hi, value in pieces:
        for b, (start, end) in enumerate(zip(edges, edges[1:])):
            n = min(hi, end) - max(lo, start)
            if n > 0:
                total[b] += value * n
                covered[b] += n
    return total, covered


def close(got, want, scale):
    if math.isnan(want) or math.isinf(want):
        return (math.isnan(got) and math.isnan(want)) or got == want
    return abs(got - want) <= 1e-12 * scale


def arrow(pieces):
    chrom, tile, track, lo, hi, value = zip(*pieces)
    return pa.table({
        "chrom": chrom, "tile": pa.array(tile, pa.int64()), "track": pa.array(track, pa.int32()),
        "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "value": pa.array(value, pa.float64()),
    })


def combined(pieces, batch, rows, monkeypatch):
    monkeypatch.setattr(P, "COMBINED_ROWS", rows)
    found = list(P._combine(SPAN)(iter(arrow(pieces).to_batches(max_chunksize=batch))))
    return pa.Table.from_batches(found).combine_chunks().sort_by([(k, "ascending") for k in P.KEYS])


@pytest.fixture(scope="module")
def patch():
    with pytest.MonkeyPatch.context() as m:
        yield m


@settings(max_examples=200, deadline=None)
@given(PIECES, st.integers(1, 9), st.integers(1, 12), st.integers(1, 5), st.sampled_from([1, 6, 1 << 20]))
def test_bins_over_batch_ends(patch, pieces, batch, rows, out_batch, waiting):
    patch.setattr(P, "WAITING_ENTRIES", waiting)
    found = combined(pieces, batch, rows, patch)
    got = {}
    for out in P._sparse(BIN, TILE)(iter(found.to_batches(max_chunksize=out_batch))):
        for r in out.to_pylist():
            assert (r["chrom"], r["tile"], r["track"]) not in got
            got[r["chrom"], r["tile"], r["track"]] = r
    want = {}
    for chrom, tile, track, *piece in pieces:
        want.setdefault((chrom, tile, track), []).append(piece)
    assert got.keys() == want.keys()
    for (chrom, tile, track), own in want.items():
        total, covered = sums(own, [b * BIN for b in range(TILE + 1)])
        r = got[chrom, tile, track]
        assert r["bins"] == [tile * TILE + b for b in range(TILE) if covered[b]]
        assert r["covered"] == [c for c in covered if c]
        means = [t / c for t, c in zip(total, covered) if c]
        finite = [abs(p[2]) for p in own if math.isfinite(p[2])]
        assert all(close(g, w, max(finite, default=0) * len(own)) for g, w in zip(r["means"], means))
        assert r["negative"] == sum(m < 0 for m in r["means"]) and r["nonzero"] == sum(m != 0 for m in r["means"])


@settings(max_examples=100, deadline=None)
@given(PIECES, st.integers(1, 9), st.integers(1, 12), st.sampled_from([1, 20, 1 << 24]))
def test_matrices_hold_the_same_means(patch, pieces, batch, rows, cells):
    patch.setattr(P, "MAX_BATCH_CELLS", cells)
    found = combined(pieces, batch, rows, patch)
    sparse = [r for out in P._sparse(BIN, TILE)(iter(found.to_batches())) for r in out.to_pylist()]
    wide = found.append_column("n_tracks", pa.array([3] * found.num_rows))
    dense = [r for out in P._dense(BIN, TILE)(iter(wide.to_batches(max_chunksize=2))) for r in out.to_pylist()]
    assert [(r["chrom"], r["tile"]) for r in dense] == sorted({(r["chrom"], r["tile"]) for r in sparse})
    at = {(r["chrom"], r["tile"]): r for r in dense}
    filled = {k: np.zeros((3, TILE), np.float32) for k in at}
    for r in sparse:
        for b, mean in zip(r["bins"], r["means"]):
            filled[r["chrom"], r["tile"]][r["track"], b - r["tile"] * TILE] = mean
        assert at[r["chrom"], r["tile"]]["negative"][r["track"]] == r["negative"]
        assert at[r["chrom"], r["tile"]]["nonzero"][r["track"]] == r["nonzero"]
    for key, r in at.items():
        np.testing.assert_array_equal(np.array(r["vals"], np.float32), filled[key])


@settings(max_examples=200, deadline=None)
@given(PIECES, st.lists(st.integers(0, SPAN), min_size=2, max_size=6))
def test_region_sums_by_search(patch, pieces, edges):
    pieces = [("a", 0, 0, *p[3:]) for p in pieces]
    table = combined(pieces, 7, 9, patch)
    index = P._Index(P._profile_entries(table, np.zeros(table.num_rows, np.int64), SPAN), SPAN)
    total, covered = index.sums(np.zeros(1, np.int64), np.array([sorted(edges)]))
    want_total, want_covered = sums([p[3:] for p in pieces], sorted(edges))
    assert covered[0].tolist() == want_covered
    scale = max((abs(p[5]) for p in pieces if math.isfinite(p[5])), default=0) * SPAN * len(pieces)
    for got, want, n in zip(total[0].astype(float), want_total, want_covered):
        assert not n or close(got, want, scale)


def test_values_of_any_size_side_by_side_are_exact(spark):
    values = [1e300, 1e-300, 3.0, 0.0, -1e15, 0.1]
    made = spark.createDataFrame([(0, "c", 4 * i, 4 * i + 4, v) for i, v in enumerate(values)], SIGNAL)
    contigs = spark.createDataFrame([("c", 24)], "chrom string, len bigint")
    rows = binning.signal_bins(made, contigs, 4, 3).orderBy("bin").collect()
    assert [r["mean"] for r in rows] == values


def test_a_pile_of_intervals_and_regions_in_one_tile(spark):
    rng = np.random.default_rng(1)
    low = rng.integers(0, 5000, 3000)
    high = low + rng.integers(1, 5000, 3000)
    value = rng.normal(size=3000)
    made = spark.createDataFrame([(i % 2, "c", int(a), int(b), float(v)) for i, (a, b, v) in enumerate(zip(low, high, value))], SIGNAL)
    places = rng.integers(0, 4000, 300)
    regions = spark.createDataFrame(
        [(i, "c", int(s), int(s) + 997) for i, s in enumerate(places)], "index bigint, chrom string, sig_start bigint, sig_end bigint"
    )
    before, P.BLOCK_REGIONS = P.BLOCK_REGIONS, 50
    try:
        got = {(r["index"], r["track"], r["bin"]): r["mean"] for r in binning.exact_bins(regions, made, 10, 700).collect()}
    finally:
        P.BLOCK_REGIONS = before
    base = np.zeros((2, 2, 10001))
    for i, (a, b, v) in enumerate(zip(low, high, value)):
        base[i % 2, 0, a:b] += v
        base[i % 2, 1, a:b] += 1
    for i, s in enumerate(places):
        edges = [int(s) + int(b * 99.7) for b in range(10)] + [int(s) + 997]
        for track in range(2):
            for b, (x, y) in enumerate(zip(edges, edges[1:])):
                total, covered = base[track, :, x:y].sum(axis=1)
                assert np.isclose(got[i, track, b], total / covered, atol=1e-10)


def test_regions_of_a_track_of_huge_values_and_one_of_tiny_ones(spark):
    made = spark.createDataFrame([
        (t, c, 4 * i, 4 * i + 4, size * (i + 1)) for t, size in enumerate((1e300, 1e-300, 0.0)) for c in "ab" for i in range(20)
    ], SIGNAL)
    regions = spark.createDataFrame([(0, "a", 4, 44), (1, "b", 4, 44)], "index bigint, chrom string, sig_start bigint, sig_end bigint")
    got = {(r["index"], r["track"], r["bin"]): r["mean"] for r in binning.exact_bins(regions, made, 5, 25).collect()}
    assert len(got) == 30
    for (_, t, b), mean in got.items():
        assert np.isclose(mean, (1e300, 1e-300, 0.0)[t] * (2 * b + 2.5), rtol=1e-12, atol=0)


def test_signs_of_dense_and_sparse_grids_agree(spark):
    rng = np.random.default_rng(2)
    rows = [
        (t, c, 8 * b, 8 * b + 8, float(-abs(v) if rng.random() < share else abs(v)))
        for t, share in enumerate((0.9, 0.5, 0.95)) for c in ("x", "y") for b, v in enumerate(rng.normal(size=100))
    ]
    made, contigs = spark.createDataFrame(rows, SIGNAL), spark.createDataFrame([("x", 800), ("y", 790)], "chrom string, len bigint")
    minus = spark.createDataFrame([(0,), (1,)], "track int")
    sparse = binning.fix_minus_rows(binning.grid_rows(made, contigs, 8, 16), minus)
    want = {(r["chrom"], r["track"], r["bin"]): r["mean"] for r in binning.bins_of(sparse).collect()}
    long = binning.fix_minus_sign(binning.signal_bins(made, contigs, 8, 16), minus)
    assert {(r["chrom"], r["track"], r["bin"]): r["mean"] for r in long.collect()} == want
    tiles = binning.grid_tiles(made, contigs, F.lit(3), 8, 16)
    regions = spark.createDataFrame([(0, "x", 0), (1, "y", 0)], "index bigint, chrom string, sig_start bigint")
    windows = regions.join(binning.flipped_tracks(tiles, minus), "chrom", "left")
    for r in examples.nested_labels(windows, tiles, F.lit(3), 100, 8, 16).collect():
        got = np.array(r["labels"], np.float32)
        chrom = "xy"[r["index"]]
        expected = [[want.get((chrom, t, b), 0.0) for b in range(100)] for t in range(3)]
        np.testing.assert_array_equal(got, np.array(expected, np.float32))
    assert all(v > 0 for (_, t, _), v in want.items() if t == 0 and v > 5) and any(v < 0 for (_, t, _), v in want.items() if t == 2)


def test_the_signal_is_scanned_and_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(0, "c", 0, 100, 1.0)], SIGNAL).write.parquet(str(tmp_path / "signal"))
    made = spark.read.parquet(str(tmp_path / "signal"))
    contigs = spark.createDataFrame([("c", 96)], "chrom string, len bigint")
    regions = spark.createDataFrame([(0, "c", 8)], "index bigint, chrom string, sig_start bigint")
    labels = examples.nested_labels(regions, binning.grid_tiles(made, contigs, F.lit(1), 8, 4), F.lit(1), 4, 8, 4)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert np.array(labels.first()["labels"]).tolist() == [[1.0] * 4]


def test_profiles_without_infinities_have_no_null_lists(monkeypatch):
    pieces = [("a", 0, 0, 0, 4, 1.0), ("a", 1, 0, 2, 6, -2.0), ("b", 0, 1, 0, 3, 0.0)]
    found = combined(pieces, 2, 2, monkeypatch)
    assert found["odd"].null_count == 0 and found["odd"].to_pylist() == [[], [], []]
    mixed = pa.concat_tables([found, combined([("a", 0, 0, 1, 3, float("inf"))], 1, 1, monkeypatch)])
    group, _ = P._groups(mixed, P.KEYS)
    _, lo, hi, rate, _ = P._profile_entries(mixed, group, SPAN).stretches()
    infinite = np.isinf(rate)
    assert list(zip(lo[infinite], hi[infinite])) == [(1, 3)] and np.isfinite(rate[~infinite]).all()
