from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from genotiles.functions import memory
from genotiles.operators import binning, examples, profiles, regions as R

SIGNAL = "track int, chrom string, start_pos bigint, end_pos bigint, value double"
CONTIGS = "chrom string, len bigint"


def signal(spark, *intervals):
    return spark.createDataFrame([(0, "c", *i) for i in intervals], SIGNAL)


def contigs(spark, length=40):
    return spark.createDataFrame([("c", length)], CONTIGS)


def grid(spark, *intervals, length=40, size=10):
    bins = binning.signal_bins(signal(spark, *intervals), contigs(spark, length), size, 2)
    return {r["bin"]: r["mean"] for r in bins.collect()}


def test_interval_ending_on_a_bin_edge_stays_out_of_the_next_bin(spark):
    assert grid(spark, (0, 10, 3.0)) == {0: 3.0}


def test_zero_values_cover_but_gaps_do_not(spark):
    assert grid(spark, (0, 5, 0.0), (5, 10, 4.0), (10, 15, 4.0)) == {0: 2.0, 1: 4.0}


def test_nan_intervals_and_the_last_partial_bin_are_left_out(spark):
    assert grid(spark, (0, 10, float("nan")), (10, 50, 2.0), length=38) == {1: 2.0, 2: 2.0}


def test_contig_shorter_than_a_bin_has_no_grid(spark):
    assert grid(spark, (0, 8, 1.0), length=9) == {}


def test_long_interval_spans_tiles(spark):
    assert grid(spark, (3, 36, 1.5)) == {0: 1.5, 1: 1.5, 2: 1.5, 3: 1.5}


def test_last_interval_wins_where_intervals_overlap(spark):
    overlapping = signal(spark, (0, 10, 2.0), (5, 10, 6.0))
    found = binning.last_wins_bins(overlapping, contigs(spark), 10).collect()
    assert [(r["bin"], r["mean"]) for r in found] == [(0, 4.0)]
    apart = signal(spark, (0, 4, 2.0), (4, 12, 6.0))
    same = rows(binning.last_wins_bins(apart, contigs(spark), 10), "bin", "mean")
    assert same == rows(binning.signal_bins(apart, contigs(spark), 10), "bin", "mean")


def test_overlap_with_a_range(spark):
    found = binning.in_range(signal(spark, (0, 10, 1.0), (10, 20, 2.0), (20, 30, 3.0)), "c", 10, 20)
    assert [r["value"] for r in found.collect()] == [2.0]


def segmented(seed=7, chroms=("chrA", "chrB"), tracks=3, length=4096):
    """Intervals with gaps, several lengths, per chromosome and track."""
    rng = np.random.default_rng(seed)
    out = []
    for chrom in chroms:
        for track in range(tracks):
            at = 0
            while at < length:
                at += int(rng.choice([0, 3, 7, 11]))
                end = min(at + int(rng.choice([5, 13, 29, 61, 97])), length)
                if at < end:
                    out.append((track, chrom, at, end, float(np.float32(rng.normal()))))
                at = end
    return out


def brute_force(intervals, lo, hi, n_bins):
    """Mean over covered bases of each bin of [lo, hi), edges at whole bases."""
    total, covered = np.zeros(n_bins), np.zeros(n_bins)
    step = (hi - lo) / n_bins
    edges = [lo + int(b * step) for b in range(n_bins)] + [hi]
    for start, end, value in intervals:
        start, end = max(start, lo), min(end, hi)
        if start >= end:
            continue
        first, last = int((start - lo) / step), min(int(np.ceil((end - lo) / step)), n_bins)
        for b in range(first, last):
            n = end - start if last == first + 1 else min(end, edges[b + 1]) - max(start, edges[b])
            if n > 0:
                total[b] += value * n
                covered[b] += n
    return np.divide(total, covered, out=np.zeros(n_bins), where=covered > 0)


@pytest.mark.parametrize("n_bins", [64, 60, 7])
def test_exact_bins_equal_brute_force(spark, n_bins):
    data = segmented()
    regions = [(i, "chrA" if i % 2 else "chrB", 97 * i, 97 * i + 512) for i in range(12)]
    frame = spark.createDataFrame(regions, "index bigint, chrom string, sig_start bigint, sig_end bigint")
    found = binning.exact_bins(frame, spark.createDataFrame(data, SIGNAL), n_bins, 300).collect()
    got = {(r["index"], r["track"], r["bin"]): r["mean"] for r in found}
    for index, chrom, lo, hi in regions:
        for track in range(3):
            own = [i[2:] for i in data if i[0] == track and i[1] == chrom]
            expected = brute_force(own, lo, hi, n_bins)
            mine = [got.get((index, track, b), 0.0) for b in range(n_bins)]
            np.testing.assert_allclose(mine, expected, atol=1e-12)


def build_labels(spark, regions, data, n_bins, size, partitions=8):
    frame = spark.createDataFrame(regions, "index bigint, chrom string, sig_start bigint")
    intervals = spark.createDataFrame(data, SIGNAL).repartition(partitions)
    lengths = spark.createDataFrame([("chrA", 4096), ("chrB", 4096)], CONTIGS)
    bins = binning.signal_bins(intervals, lengths, size, 16)
    tiles = examples.signal_tiles(bins, F.lit(3), 16)
    found = examples.nested_labels(frame, tiles, F.lit(3), n_bins, size, 16).collect()
    return {r["index"]: np.array(r["labels"], dtype=np.float32) for r in found}


def test_grid_equals_exact_on_aligned_regions_and_differs_off_the_grid(spark):
    data = segmented()
    regions = [(0, "chrA", 0), (1, "chrB", 1024), (2, "chrA", 3072), (3, "chrA", 1029), (4, "chrB", 3800)]
    labels = build_labels(spark, regions, data, 64, 8)
    frame = spark.createDataFrame(
        [(i, c, s, s + 512) for i, c, s in regions], "index bigint, chrom string, sig_start bigint, sig_end bigint"
    )
    exact = np.zeros((5, 3, 64), dtype=np.float32)
    for r in binning.exact_bins(frame, spark.createDataFrame(data, SIGNAL), 64, 512).collect():
        exact[r["index"], r["track"], r["bin"]] = r["mean"]
    for i in (0, 1, 2):
        assert labels[i].shape == (3, 64)
        np.testing.assert_array_equal(labels[i], exact[i])
    assert not np.array_equal(labels[3], exact[3])
    assert (labels[4][:, 37:] == 0).all(), "bins past the contig end read as 0"


def test_labels_do_not_depend_on_partitioning(spark):
    data = segmented(3)
    regions = [(i, "chrA", 40 * i) for i in range(20)]
    one, many = build_labels(spark, regions, data, 20, 8, 1), build_labels(spark, regions, data[::-1], 20, 8, 13)
    for i in one:
        np.testing.assert_array_equal(one[i], many[i])


def test_region_without_any_signal_is_zero(spark):
    labels = build_labels(spark, [(0, "chrA", 0), (1, "other", 64)], segmented(chroms=("chrA",)), 10, 8)
    assert labels[0].any() and not labels[1].any() and labels[1].shape == (3, 10)


@pytest.mark.parametrize("negatives, flipped", [(4, True), (3, False)])
def test_minus_track_is_negated_from_four_fifths_on(spark, negatives, flipped):
    values = [-1.0] * negatives + [1.0] * (5 - negatives) + [0.0]
    bins = spark.createDataFrame([("c", 0, 0, b, v) for b, v in enumerate(values)],
                                 "chrom string, track int, tile bigint, bin bigint, mean double")
    minus = spark.createDataFrame([(0,)], "track int")
    found = [r["mean"] for r in binning.fix_minus_sign(bins, minus).orderBy("bin").collect()]
    assert found == ([-v for v in values] if flipped else values)
    untouched = binning.fix_minus_sign(bins, minus.where("track > 0")).orderBy("bin").collect()
    assert [r["mean"] for r in untouched] == values


def test_signal_window_near_the_start_keeps_its_width(spark):
    frame = spark.createDataFrame([(0, "c", 10, 30, "f")], "index int, chrom string, start_pos bigint, end_pos bigint, fold string")
    row = R.with_signal_window(frame, 8, 10).first()
    assert (row["sig_start"], row["sig_end"]) == (0, 80)
    row = R.with_signal_window(frame, 8, 10, clamp=False).first()
    assert (row["sig_start"], row["sig_end"]) == (-20, 60)
    with pytest.raises(ValueError):
        R.with_signal_window(frame, 8, 10, shift_max_bp=15)


def test_more_regions_make_more_tasks_of_exact_bins(spark, monkeypatch):
    regions = spark.range(60).selectExpr("id AS index", "'c' AS chrom", "id * 7 AS sig_start", "id * 7 + 40 AS sig_end")
    signal = spark.range(90).selectExpr(
        "id % 2 AS track", "'c' AS chrom", "id * 5 AS start_pos", "id * 5 + 8 AS end_pos", "double(id) AS value"
    )
    found = lambda: binning.exact_bins(regions, signal, 4, 64)
    wanted = sorted(found().collect())
    monkeypatch.setattr(binning, "TASK_BINS", 8)
    assert found().rdd.getNumPartitions() == 60 * 4 // 8
    assert sorted(found().collect()) == wanted


def test_workers_give_back_what_profiles_freed(monkeypatch):
    given = []
    monkeypatch.setattr(memory, "give_back", lambda: given.append(1))
    for task in (profiles._combine(8), profiles._sparse(2, 4), profiles._dense(2, 4), profiles._region_sums(8, 2)):
        assert list(task(iter(()))) == []
    assert len(given) == 4
