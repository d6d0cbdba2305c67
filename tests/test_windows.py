from __future__ import annotations

import hashlib
import sys

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from genotiles.functions import arrays as A
from genotiles.operators import collapse, examples, inference, sampling, windows as W
from genotiles.plans.build import Geometry
from genotiles.plans.predict import predict_regions, predict_signal

# The models below live in this module, which tasks cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BED = "index bigint, chrom string, start_pos bigint, end_pos bigint"


def contigs(spark, *sizes):
    return spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate(sizes)], "chrom string, chrom_rank bigint, len bigint")


def runs_of(spark, values, pred_start=0, length=10**6, rtol=0.01):
    frame = spark.createDataFrame([("c", length, pred_start, 0, values)],
                                  "chrom string, len bigint, pred_start bigint, track int, vals array<float>")
    found = collapse.collapse(frame, 10, rtol).orderBy("start_pos").collect()
    return [(r["start_pos"], r["end_pos"], r["value"]) for r in found]


def test_collapse_merges_equal_and_close_values(spark):
    assert runs_of(spark, [1.0, 1.0, 1.0, 1.0], rtol=0.0) == [(0, 40, 1.0)]
    assert runs_of(spark, [0.0, 0.0, 0.0]) == [(0, 30, 0.0)]
    assert runs_of(spark, [1.0, 1.0, 5.0, 5.0]) == [(0, 20, 1.0), (20, 40, 5.0)]
    assert runs_of(spark, [100.0, 100.5]) == [(0, 20, 100.25)]


def test_collapse_clamps_to_the_contig(spark):
    assert runs_of(spark, [1.0, 1.0, 1.0, 1.0], length=25) == [(0, 25, 1.0)]
    assert runs_of(spark, [1.0, 2.0, 2.0], pred_start=-15) == [(0, 15, 2.0)]
    assert runs_of(spark, [1.0, 2.0], pred_start=30, length=25) == []


def fold(values, rtol):
    """The rule, one value at a time."""
    found = []
    for at, value in enumerate(values):
        if found:
            first, n, total = found[-1]
            if abs(value - total / n) <= rtol * max(abs(value), abs(total / n)):
                found[-1] = (first, n + 1, total + value)
                continue
        found.append((at, 1, value))
    return found


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([0.0, 1.0, 1.005, 1.02, -3.0, 100.0, float("nan")]), max_size=12), min_size=1, max_size=5),
    st.sampled_from([0.0, 0.01, 0.5]),
)
def test_fold_of_many_rows_equals_the_rule(lists, rtol):
    lengths = np.array([len(v) for v in lists])
    matrix = np.zeros((len(lists), max(1, lengths.max())))
    for i, v in enumerate(lists):
        matrix[i, : len(v)] = v
    row, at, n, total = collapse.fold_runs(matrix, lengths, rtol)
    for i, v in enumerate(lists):
        mine = list(zip(at[row == i], n[row == i], total[row == i]))
        np.testing.assert_array_equal(np.array(mine).reshape(-1, 3), np.array(fold(v, rtol)).reshape(-1, 3))


def test_tiling_and_targets(spark):
    sizes = contigs(spark, ("chr1", 1000), ("chr2", 500))
    tiled = W.prediction_windows(sizes, 4, 10, 100, whole_genome=True)
    assert {r["chrom"]: r["count"] for r in tiled.groupBy("chrom").count().collect()} == {"chr1": 25, "chr2": 13}
    bed = spark.createDataFrame([(0, "chr2", 95, 105), (1, "chr1", 490, 510)], BED)
    found = W.in_genome_order(W.prediction_windows(sizes, 4, 10, 100, regions=bed)).collect()
    assert [(r["chrom"], r["pred_start"], r["pred_end"], r["ctx_start"], r["ctx_end"]) for r in found] == [
        ("chr1", 480, 520, 450, 550), ("chr2", 80, 120, 50, 150)]
    with pytest.raises(ValueError):
        W.prediction_windows(sizes, 4, 10, 100)
    with pytest.raises(ValueError):
        W.prediction_windows(sizes, 4, 10, 100, regions=bed, whole_genome=True)
    unknown = spark.createDataFrame([(0, "chr9", 95, 105)], BED)
    with pytest.raises(Exception, match="chromosome not in chrom sizes"):
        W.targeted_windows(unknown, sizes, 4, 10, 100).collect()


def test_overlapping_windows_are_found_across_slots(spark):
    sizes = contigs(spark, ("chr1", 1000))
    bed = lambda *centres: spark.createDataFrame([(i, "chr1", c, c) for i, c in enumerate(centres)], BED)
    at = lambda *centres: W.targeted_windows(bed(*centres), sizes, 4, 10, 100)
    assert rows(W.overlapping_neighbours(at(500, 510, 510), 40)) == [("chr1", 480, 490, 1), ("chr1", 490, 490, 1)]
    assert rows(W.overlapping_neighbours(at(500, 539), 40)) == [("chr1", 480, 519, 1)]
    W.check_disjoint(at(500, 540, 20), 40)
    with pytest.raises(ValueError, match="overlapping"):
        W.check_disjoint(at(500, 510), 40)


def test_overlaps_equal_sorted_neighbours(spark):
    rng = np.random.default_rng(0)
    starts = np.sort(rng.integers(-50, 5000, 400))
    frame = spark.createDataFrame([("c", int(s)) for s in starts], "chrom string, pred_start bigint")
    expected = {}
    for a, b in zip(starts, starts[1:]):
        if b - a < 40:
            expected[("c", int(a), int(b))] = expected.get(("c", int(a), int(b)), 0) + 1
    assert rows(W.overlapping_neighbours(frame, 40)) == sorted((*k, n) for k, n in expected.items())


def test_one_hot_pads_and_ignores_unknown_letters(spark):
    chunks = examples.chunk_sequences(spark.createDataFrame([("c", "ACGT" * 25)], "chrom string, seq string"), 7)
    window = spark.createDataFrame([(0, "c", 0, 20, 10), (1, "c", 90, 100, 0), (2, "x", 0, 0, 5)],
                                   "index bigint, chrom string, read_start bigint, read_end bigint, left_pad bigint")
    found = {r["index"]: r["seq"] for r in examples.fetch_sequence(window, chunks, 30, chunk=7).collect()}
    assert found == {0: "N" * 10 + "ACGT" * 5, 1: "GTACGTACGT" + "N" * 20, 2: "N" * 30}
    frame = spark.createDataFrame([(s,) for s in ("ACGTacgtN", "ßé", "", "TTT")], "s string")
    for encode in (A.one_hot, A.one_hot_arrow):
        for r in frame.select("s", encode(F.col("s")).alias("x")).collect():
            matrix = np.array(r["x"])
            if r["s"]:
                np.testing.assert_array_equal(matrix.reshape(4, -1), A.one_hot_numpy(r["s"]))


def test_reverse_complement(spark):
    frame = spark.createDataFrame([("ACGTN",)], "s string")
    row = frame.select(A.reverse_complement(F.col("s")).alias("rc"), A.one_hot(F.col("s")).alias("x"),
                       A.reverse_both_axes(A.one_hot(F.col("s"))).alias("y")).first()
    assert row["rc"] == "NACGT"
    np.testing.assert_array_equal(np.array(row["y"]), np.array(row["x"])[::-1, ::-1])
    np.testing.assert_array_equal(np.array(row["y"]), A.one_hot_numpy("NACGT"))


GEOMETRY = Geometry(context_length=60, n_pred_bins=4, bin_size=10)


def load_counter():
    """Track 0 counts A per bin, track 1 is constant, track 2 the window's own mean of A."""
    def model(x):
        middle = x[:, :, 10:50].reshape(x.shape[0], 4, 4, 10).sum(-1)
        ones = np.ones_like(middle[:, 0])
        return np.stack([middle[:, 0], ones, ones * middle[:, 0].mean(-1, keepdims=True)], axis=1)
    return model


def load_failing():
    good = load_counter()

    def model(x):
        if x[:, 0].sum(axis=1).max() == 0:
            raise RuntimeError("no A in the batch")
        return good(x)
    return model


def test_region_prediction_and_records(spark):
    sizes, chunks = contigs(spark, ("c", 400)), spark.createDataFrame([("c", 0, "A" * 200 + "C" * 200)], "chrom string, chunk_no bigint, seq string")
    bed = spark.createDataFrame([(7, "c", 190, 210)], BED)
    row = predict_regions(bed, sizes, chunks, GEOMETRY, load_counter, tracks=[1, 0]).first()
    assert (row["pred_start"], row["pred_end"], row["ctx_start"], row["ctx_end"]) == (180, 220, 170, 230)
    assert row["values"] == [[1.0] * 4, [10.0, 10.0, 0.0, 0.0]] and "input" not in row.asDict()
    row = predict_regions(bed, sizes, chunks, GEOMETRY, load_counter, include_input=True).first()
    np.testing.assert_array_equal(np.array(row["input"]), A.one_hot_numpy("A" * 30 + "C" * 30))
    out = predict_regions(bed, sizes, chunks, GEOMETRY, load_counter)
    records = W.long_records(out, 10).where("track = 0").orderBy("start_pos").collect()
    assert [(r["start_pos"], r["end_pos"], r["value"]) for r in records] == [
        (180, 190, 10.0), (190, 200, 10.0), (200, 210, 0.0), (210, 220, 0.0)]
    with pytest.raises(Exception, match="invalid region"):
        predict_regions(spark.createDataFrame([(0, "c", 9, 3)], BED), sizes, chunks, GEOMETRY, load_counter).collect()


def test_failing_windows_are_skipped_only_on_request(spark):
    sizes, chunks = contigs(spark, ("c", 400)), spark.createDataFrame([("c", 0, "A" * 200 + "C" * 200)], "chrom string, chunk_no bigint, seq string")
    bed = spark.createDataFrame([(0, "c", 90, 110), (1, "c", 300, 320)], BED)
    with pytest.raises(Exception, match="no A in the batch"):
        predict_regions(bed, sizes, chunks, GEOMETRY, load_failing, batch_size=1).collect()
    kept = predict_regions(bed, sizes, chunks, GEOMETRY, load_failing, batch_size=2, on_error="skip").collect()
    assert sorted(r["index"] for r in kept) in ([0], [0, 1])
    alone = predict_regions(bed, sizes, chunks, GEOMETRY, load_failing, batch_size=1, on_error="skip").collect()
    assert [r["index"] for r in alone] == [0]


def test_inverse_squash_of_predictions(spark):
    frame = spark.createDataFrame([(0, "ACGT")], "index int, seq string")
    out = inference.predict_windows(frame, lambda: lambda x: np.full((len(x), 1, 2), 7.0), inverse_squash=True)
    np.testing.assert_allclose(out.first()["values"], [[15.0, 15.0]], rtol=1e-6)


def test_predicted_signal_tiles_and_names(spark, tmp_path):
    sizes = contigs(spark, ("c", 100))
    chunks = spark.createDataFrame([("c", 0, "A" * 50 + "C" * 50)], "chrom string, chunk_no bigint, seq string")
    names = spark.createDataFrame([(0, "a"), (1, "one"), (2, "m")], "track_index int, track_name string")
    out = predict_signal(sizes, chunks, GEOMETRY, load_counter, names, whole_genome=True,
                         wanted=["one", "0"], folder=str(tmp_path / "signal"))
    assert rows(out, "track_name", "start_pos", "end_pos", "value") == [
        ("a", 0, 40, 10.0), ("a", 40, 50, 10.0), ("a", 50, 80, 0.0), ("a", 80, 100, 0.0),
        ("one", 0, 40, 1.0), ("one", 40, 80, 1.0), ("one", 80, 100, 1.0)]
    written = spark.read.csv(str(tmp_path / "signal"), sep="\t")
    assert written.where("track_name = 'a'").count() == 4


def test_samples_are_repeatable_and_whole(spark):
    frame = spark.range(1000).select(F.col("id").alias("index"), F.col("id").alias("local_index"))
    once = [r["index"] for r in sampling.random_sample(frame, 50, 1).collect()]
    again = [r["index"] for r in sampling.random_sample(frame.repartition(7), 50, 1).collect()]
    assert once == again == sorted(once) and len(set(once)) == 50
    assert once != [r["index"] for r in sampling.random_sample(frame, 50, 2).collect()]
    order = [r["index"] for r in sampling.shuffled(frame, 3).collect()]
    assert sorted(order) == list(range(1000)) and order != list(range(1000))
    assert order == sorted(order, key=lambda i: hashlib.md5(f"{i}:3".encode()).hexdigest())
    assert [r["index"] for r in sampling.stride_sample(frame, 300).collect()] == list(range(0, 900, 3))
    assert sampling.stride_sample(frame, 2000).count() == 1000


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda x: x.sum(axis=2, keepdims=True)

    windows = spark.range(400).repartition(40).selectExpr("id AS index", "'ACGT' AS seq")
    found = inference.predict_windows(windows, load)
    assert found.count() == 400
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 40
