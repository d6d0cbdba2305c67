from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from genotiles.functions import signal as G
from genotiles.operators import metrics as M, scores as S
from genotiles.plans.evaluate import pairs_from_nested

PAIRS = "index int, track int, bin int, pred double, target double"


def batch(seed, shape=(3, 4, 24)):
    rng = np.random.default_rng(seed)
    return rng.uniform(0.1, 10, shape), rng.uniform(0.1, 10, shape)


def long(spark, pred, target):
    data = [(*map(int, at), float(p), float(target[at])) for at, p in np.ndenumerate(pred)]
    return spark.createDataFrame(data, PAIRS)


def average_ranks(x):
    values, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - n + (n + 1) / 2)[inverse]


def by_track(frame, column):
    return {r["track"]: r[column] for r in frame.collect()}


def test_per_track_metrics_equal_numpy(spark):
    pred, target = batch(0)
    target = np.round(target)  # ties
    frame = long(spark, pred, target)
    pearson, spearman = by_track(M.pearson(frame, ["track"]), "pearson"), by_track(M.spearman(frame, ["track"]), "spearman")
    ratio, errors = by_track(M.amplitude_calibration(frame), "amplitude_calibration"), M.track_errors(frame)
    for t in range(4):
        p, y = pred[:, t].ravel(), target[:, t].ravel()
        assert pearson[t] == pytest.approx(np.corrcoef(p, y)[0, 1])
        assert spearman[t] == pytest.approx(np.corrcoef(average_ranks(p), average_ranks(y))[0, 1])
        assert ratio[t] == pytest.approx(np.percentile(p, 99) / np.percentile(y, 99))
        assert by_track(errors, "mse")[t] == pytest.approx(((p - y) ** 2).mean())
        assert by_track(errors, "mae")[t] == pytest.approx(np.abs(p - y).mean())


def test_undefined_metrics_are_null(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame([
        (0, 0, 0, 1.0, 1.0), (0, 0, 1, 1.0, 2.0), (0, 0, 2, 1.0, 3.0),  # flat prediction
        (0, 1, 0, 1.0, 1.0), (0, 1, 1, nan, 2.0), (0, 1, 2, 2.0, inf),  # one finite pair
        (0, 2, 0, None, 1.0), (0, 2, 1, nan, 2.0),                      # none
        (0, 3, 0, 1.0, 0.0), (0, 3, 1, 2.0, 0.0),                       # zero target
    ], PAIRS)
    assert by_track(M.pearson(frame, ["track"]), "pearson") == {0: None, 1: None, 2: None, 3: None}
    assert by_track(M.spearman(frame, ["track"]), "spearman") == {0: None, 1: None, 2: None, 3: None}
    assert by_track(M.amplitude_calibration(frame), "amplitude_calibration") == {
        0: pytest.approx(1 / 2.98), 1: None, 2: None, 3: None}
    assert by_track(M.track_errors(frame), "mse") == {0: pytest.approx(5 / 3), 1: 0.0, 2: None, 3: 2.5}


def sums_by_numpy(pred, target, k):
    out = []
    for e in range(pred.shape[0]):
        for t in range(pred.shape[1]):
            p, y = pred[e, t], target[e, t]
            top = np.argsort(-y, kind="stable")[:k]
            six = lambda p, y: [p.sum(), y.sum(), (p * y).sum(), (p * p).sum(), (y * y).sum(), len(p)]
            sp, sy = p.sum(), y.sum()
            out.append([e, t, *six(p, y), *six(p[top], y[top]), sp, sy, sp * sy, sp * sp, sy * sy, 1])
    return np.array(out)


def test_statistics_equal_numpy_in_both_layouts(spark):
    pred, target = batch(1)
    names = ["index", "track"] + [f"{n}_{s}" for s in ("all", "top", "total") for n in M.SUMS]
    expected = sums_by_numpy(pred, target, 5)
    flat = M.example_statistics(long(spark, pred, target), 5).select(*names).orderBy("index", "track").collect()
    np.testing.assert_allclose(np.array(flat, dtype=float), expected)
    nested = spark.createDataFrame(
        [(e, t, pred[e, t].tolist(), target[e, t].tolist()) for e in range(3) for t in range(4)],
        "index int, track int, pred array<double>, target array<double>",
    )
    inside = M.nested_statistics(nested, 5).select(*names).orderBy("index", "track").collect()
    np.testing.assert_allclose(np.array(inside, dtype=float), expected)


def test_median_correlations_over_batches(spark):
    parts = [batch(s, (4, 6, 24)) for s in range(5)]
    pred, target = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    target[:, 5] = 2.0  # a flat track is left out
    frame = long(spark, pred, target)
    whole = M.accumulate_statistics(M.example_statistics(frame, 8))
    row = M.median_correlations(whole, 8).first()
    r = [np.corrcoef(pred[:, t].ravel(), target[:, t].ravel())[0, 1] for t in range(5)]
    totals = [np.corrcoef(pred[:, t].sum(-1), target[:, t].sum(-1))[0, 1] for t in range(5)]
    assert row["pearson_bin_median"] == pytest.approx(np.median(r))
    assert row["pearson_total_median"] == pytest.approx(np.median(totals))
    assert "pearson_top8_median" in row.asDict()
    perfect = M.accumulate_statistics(M.example_statistics(long(spark, target[:, :5], target[:, :5]), 8))
    assert M.median_correlations(perfect, 8).first()["pearson_bin_median"] == pytest.approx(1.0)


def test_states_of_parts_add_up(spark):
    pred, target = batch(2)
    frame = long(spark, pred, target)
    parts = M.reconstruction_state(frame.withColumn("part", F.col("bin") % 3), ["part"])
    merged, whole = M.merge_states(parts).first(), M.reconstruction_state(frame).first()
    np.testing.assert_allclose(np.array(merged, dtype=float), np.array(whole, dtype=float))
    empty = M.finalize_state(M.reconstruction_state(frame.where("index < 0"))).first()
    assert list(empty) == [None, None, None]


def test_fold_change_metrics(spark):
    changes = spark.createDataFrame([(0.0, 0.1), (1.0, 0.9), (2.0, 2.1)], "pred_lfc double, meas_lfc double")
    row = M.fold_change_report(changes).first()
    assert row["pearson"] == pytest.approx(np.corrcoef([0, 1, 2], [0.1, 0.9, 2.1])[0, 1])
    assert row["spearman"] == pytest.approx(1.0) and row["top_variance_pearson"] is None
    flat = M.fold_change_report(changes.withColumn("pred_lfc", F.lit(1.0))).first()
    assert list(flat) == [None, None, None]


def paired(spark, pred, target, conditions, groups):
    frame = long(spark, pred, target)
    tracks = spark.createDataFrame([(t, c, g) for t, (c, g) in enumerate(zip(conditions, groups))],
                                   "track int, condition_id int, group_id int")
    return frame.join(tracks, "track")


def test_paired_fold_changes_average_before_the_log(spark):
    pred, target = batch(3, (2, 5, 8))
    frame = paired(spark, pred, target, [0, 0, 1, 1, 0], [0, 0, 0, 0, 1])
    found = {(r["index"], r["group_id"], r["bin"]): (r["pred_lfc"], r["meas_lfc"]) for r in M.paired_fold_changes(frame).collect()}
    assert {g for _, g, _ in found} == {0}, "a group without a perturbed track drops out"
    change = lambda x: np.log2(x[:, 2:4].mean(1) + 1) - np.log2(x[:, :2].mean(1) + 1)
    gap = change(pred) - change(target)
    for (e, _, b), (p, m) in found.items():
        assert (p, m) == (pytest.approx(change(pred)[e, b]), pytest.approx(change(target)[e, b]))
    huber = np.where(np.abs(gap) <= 0.5, gap**2 / 2, 0.5 * (np.abs(gap) - 0.25)).mean()
    assert S.paired_fold_change_score(frame).first()["score"] == pytest.approx(huber)
    one = M.paired_fold_changes(paired(spark, pred, target, [0, 0, 1, 1, 2], [0] * 5).drop("group_id"))
    assert rows(one, "index", "bin") == sorted((e, b) for e, _, b in found)
    none = paired(spark, pred, target, [0] * 5, [0] * 5)
    assert S.paired_fold_change_score(none).first()["score"] == 0.0


def test_best_run(spark):
    runs = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", float("nan")), ("d", 3.0), ("e", None)], "run string, m double")
    assert tuple(M.best_run(runs, "run", "m").first()) == ("b", 3.0)
    assert tuple(M.best_run(runs, "run", "m", larger_is_better=False).first()) == ("a", 1.0)


EPS = 1e-6


def pm(pred, target, w=0.2):
    y, p = target + EPS, pred + EPS
    sy, sp = y.sum(-1), p.sum(-1)
    n = pred.shape[-1]
    return (-(y * np.log(p / sp[..., None])).sum(-1) / n + w * (sp - sy * np.log(sp)).mean() / n).mean()


def huber(x, d):
    return np.where(np.abs(x) <= d, x * x / 2, d * (np.abs(x) - d / 2))


def top(x, by, k):
    at = np.argsort(-by, axis=-1, kind="stable")[..., :k]
    return np.take_along_axis(x, at, -1)


def reweighted(pred, target, k, weight):
    y, p = target + EPS, pred + EPS
    ce = -(y * np.log(np.maximum(p / p.sum(-1, keepdims=True), EPS)))
    extra = top(ce, target, k).sum(-1) * (weight - 1)
    sp, sy, n = p.sum(-1), y.sum(-1), pred.shape[-1]
    return ((ce.sum(-1) + extra) / n).mean() + 0.2 * (sp - sy * np.log(sp)).mean() / n


def transfer(pred, target, k):
    y, p = target + EPS, pred + EPS
    n = pred.shape[-1]
    profile = -(y * np.log(np.maximum(p / p.sum(-1, keepdims=True), EPS))).sum(-1).mean() / n
    total = ((np.log1p(p.sum(-1)) - np.log1p(y.sum(-1))) ** 2).mean()
    bins = ((np.log1p(p) - np.log1p(y)) ** 2).mean()
    peak = huber(np.log1p(top(p, y, k)) - np.log1p(top(y, y, k)), 1.0).mean()
    return 0.05 * profile + 0.5 * total + 2.0 * bins + 1.0 * peak


def log_gap(pred, target):
    return np.log1p(np.maximum(pred, 0) + EPS) - np.log1p(np.maximum(target, 0) + EPS)


def nll(pred, target):
    p = np.maximum(pred, EPS)
    return (p - target * np.log(p + 1e-8)).mean()


L, K = 128, 5
CASES = {
    "poisson_multinomial": ({}, pm),
    "mse": ({}, lambda p, t: ((p - t) ** 2).mean()),
    "log1p_huber": ({"delta": 0.3}, lambda p, t: huber(log_gap(p, t), 0.3).mean()),
    "poisson_nll": ({}, nll),
    "topk_additive": ({"topk_weight": 2.0}, lambda p, t: pm(p, t) + 2.0 * pm(top(p, t, K), top(t, t, K))),
    "topk_reweight": ({"topk_weight": 4.0}, lambda p, t: reweighted(p, t, K, 4.0)),
    "transfer_calibration": (
        {"profile_weight": 0.05, "bin_weight": 2.0, "topk_bin_weight": 1.0, "topk_bin_count": 20},
        lambda p, t: transfer(p, t, 20)),
}


@pytest.mark.parametrize("name", CASES)
def test_scores_equal_numpy(spark, name):
    options, expected = CASES[name]
    pred, target = batch(4, (2, 4, L))
    score = lambda p, t: S.mean_score(S.scorer({"name": name, **options}, n_bins=L)(long(spark, p, t))).first()["score"]
    assert score(pred, target) == pytest.approx(expected(pred, target), rel=1e-9)
    assert score(target, target) < score(pred, target)
    assert math.isfinite(score(pred, np.zeros_like(target)))


def test_scaled_score(spark):
    pred, target = batch(5, (2, 3, 16))
    frame = long(spark, pred, target)
    plain = S.mean_score(S.poisson_multinomial(frame)).first()["score"]
    unit = spark.createDataFrame([(t, 1.0, 1e9) for t in range(3)], "track int, scale_factor double, clip_hard double")
    score = lambda tracks, **o: S.mean_score(S.scorer({"name": "scaled_poisson_multinomial"}, tracks=tracks, **o)(frame)).first()["score"]
    assert score(unit) == pytest.approx(plain)
    tracks = spark.createDataFrame([(t, 2.0 + t, 4.0) for t in range(3)], "track int, scale_factor double, clip_hard double")
    scale = np.array([2.0, 3.0, 4.0])[None, :, None]
    y, p = np.minimum(target + EPS, 4.0) * scale, (pred + EPS) * scale
    sy, sp = y.sum(-1), p.sum(-1)
    expected = (-(y * np.log(p / sp[..., None])).sum(-1) / 16).mean() + 0.2 * (sp - sy * np.log(sp)).mean() / 16
    assert score(tracks) == pytest.approx(expected)
    assert score(tracks, already_scaled=True) == pytest.approx(plain)
    rescaled = S.mean_score(S.poisson_multinomial(frame, rescale=True)).first()["score"]
    assert rescaled == pytest.approx(plain * 2 / 1.2)


def test_unknown_scores_and_transforms_are_errors(spark):
    with pytest.raises(ValueError):
        S.scorer({"name": "nope"})
    with pytest.raises(ValueError):
        S.scorer({"name": "topk_additive"})
    for name in ("nope", "power"):
        with pytest.raises(ValueError):
            G.target_transform(name)
    assert S.peak_count(6144, 0.04) == 246 and S.peak_count(10, 0.25) == 2 and S.peak_count(10, 0.01) == 1


def values(spark, column, *xs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    return [r[0] for r in frame.select(column(F.col("x"))).collect()]


def test_signal_transform_and_inverse(spark):
    full = lambda x: G.transform_value(x, 2.0, 8.0, 30.0)
    knee = 9.0**0.75 - 1
    got = values(spark, full, float("nan"), -1.0, 0.0, float("inf"), None, 1.0, 6.0, 100.0)
    soft = lambda v: knee - 1 + math.sqrt((v + 1) ** 0.75 - 1 - knee + 1)
    assert got == pytest.approx([0, 0, 0, 0, 0, 3**0.75 - 1, soft(12.0), soft(30.0)])
    assert values(spark, lambda x: G.transform_value(x, 2.0, 8.0, 30.0, apply_clip=False), 100.0) == pytest.approx([201**0.75 - 1])
    assert values(spark, lambda x: G.transform_value(x, 2.0, 8.0, 30.0, apply_squash=False), 100.0, 3.0) == [30.0, 6.0]
    assert values(spark, lambda x: G.transform_value(x, 2.0, 8.0, 30.0, apply_scale=False), 7.0) == pytest.approx([8**0.75 - 1])
    back = lambda x: G.inverse_value(full(x), 2.0)
    assert values(spark, back, 0.0, 1.0, 3.9) == pytest.approx([0.0, 1.0, 3.9])
    assert values(spark, lambda x: G.inverse_value(x, 0.0, apply_squash=False), -5.0, 1.0) == pytest.approx([0.0, 1e8])
    for name, power in (("identity", None), ("log1p", None), ("power", 0.5), ("power_0_75", None)):
        t = G.target_transform(name, power)
        assert values(spark, lambda x: t.inverse(t.forward(x)), 0.0, 0.5, 30.0) == pytest.approx([0.0, 0.5, 30.0])
    assert values(spark, G.signed_sqrt, -3.0, 0.0, 3.0) == pytest.approx([-1.03, 0.0, 1.03])


def test_pairs_from_nested_rows(spark):
    predictions = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]])], "index int, values array<array<float>>")
    examples = spark.createDataFrame([(0, [[5.0, 6.0], [7.0, 8.0]])], "index int, labels array<array<float>>")
    assert rows(pairs_from_nested(predictions, examples), "track", "bin", "pred", "target") == [
        (0, 0, 1.0, 5.0), (0, 1, 2.0, 6.0), (1, 0, 3.0, 7.0), (1, 1, 4.0, 8.0)]


def test_hot_example_and_hot_value(spark):
    """One (example, track) holds most bins and a third of the targets are the same value."""
    rng = np.random.default_rng(6)
    n = 6000
    index = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 300, n))
    pred, target = rng.gamma(2.0, 5.0, n), np.where(rng.random(n) < 0.33, 0.0, np.round(rng.gamma(2.0, 5.0, n), 1))
    data = [(int(e), 0, i, float(p), float(y)) for i, (e, p, y) in enumerate(zip(index, pred, target))]
    frame = spark.createDataFrame(data, PAIRS).repartition(16)
    statistics = {r["index"]: r for r in M.example_statistics(frame, 20).collect()}
    own = index == 0
    top = np.lexsort((np.arange(n)[own], -target[own]))[:20]
    assert statistics[0]["n_all"] == own.sum() and statistics[0]["n_top"] == 20
    assert statistics[0]["sum_pt_top"] == pytest.approx((pred[own][top] * target[own][top]).sum())
    assert sum(r["n_all"] for r in statistics.values()) == n
    expected = np.corrcoef(average_ranks(pred), average_ranks(target))[0, 1]
    assert M.spearman(frame, ["track"]).first()["spearman"] == pytest.approx(expected)
    score = {r["index"]: r["score"] for r in S.topk_reweight(frame, n_bins=500, topk_fraction=0.04).collect()}
    y, p = target[own] + EPS, pred[own] + EPS
    ce = -(y * np.log(np.maximum(p / p.sum(), EPS)))
    whole = (ce.sum() + 3.0 * ce[top].sum()) / 500 + 0.2 * (p.sum() - y.sum() * np.log(p.sum())) / 500
    assert score[0] == pytest.approx(whole)
