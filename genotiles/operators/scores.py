"""Scores of a prediction against its target, as table aggregates.

Each scorer takes long ``pairs(index, track, bin, pred, target)`` and returns one row per (index, track)
with its terms and ``score``; :func:`mean_score` gives the value over the whole table. ``n_bins`` is the
number of bins of an example; without it the rows of the group are counted. Both sides get ``epsilon``
added unless noted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genotiles.functions.numeric import huber
from genotiles.operators.metrics import paired_fold_changes
from genotiles.operators.ordering import top_k

KEYS = ["index", "track"]

# Parameters of the scores, as the loss configurations set them.
EPSILON = 1e-6
NLL_EPSILON = 1e-8
POISSON_WEIGHT = 0.2
TOPK_FRACTION = 0.04
HUBER_DELTA = 1.0
FOLD_CHANGE_DELTA = 0.5


def _length(n_bins: int | None) -> Column:
    return F.lit(float(n_bins)) if n_bins else F.count(F.lit(1)).cast("double")


def mean_score(scored: DataFrame) -> DataFrame:
    """One row: the mean over all (index, track) rows."""
    return scored.agg(F.avg("score").alias("score"))


def peak_count(n_bins: int, fraction: float) -> int:
    """Number of top bins: the rounded share (halves to even), at least one."""
    return max(1, round(fraction * n_bins))


def _peaks(pairs: DataFrame, k: int) -> DataFrame:
    return top_k(pairs, KEYS, [F.desc("target"), F.asc("bin"), F.asc("pred")], k)


def _poisson(sum_pred: Column, sum_true: Column) -> Column:
    return sum_pred - sum_true * F.ln(sum_pred)


def _profile_and_total(pairs: DataFrame, n_bins: int | None, epsilon: float, suffix: str = "") -> DataFrame:
    """Multinomial and Poisson term per row from three sums, in a single pass.

    ``sum(y * ln(p / S)) = sum(y * ln p) - sum(y) * ln S``, so the normaliser need not be known first.
    """
    y, p = F.col("target") + epsilon, F.col("pred") + epsilon
    sums = pairs.groupBy(*KEYS).agg(
        F.sum(y).alias("__y"), F.sum(p).alias("__p"), F.sum(y * F.ln(p)).alias("__ylnp"),
        _length(n_bins).alias("__l"),
    )
    sy, sp = F.col("__y"), F.col("__p")
    return sums.select(
        *KEYS,
        (-(F.col("__ylnp") - sy * F.ln(sp)) / F.col("__l")).alias(f"multinomial{suffix}"),
        (_poisson(sp, sy) / F.col("__l")).alias(f"poisson{suffix}"),
    )


def poisson_multinomial(
    pairs: DataFrame,
    *,
    n_bins: int | None = None,
    poisson_weight: float = POISSON_WEIGHT,
    epsilon: float = EPSILON,
    rescale: bool = False,
) -> DataFrame:
    """Cross-entropy of the profile plus a weighted Poisson term of the total."""
    factor = 2.0 / (1.0 + poisson_weight) if rescale else 1.0
    terms = _profile_and_total(pairs, n_bins, epsilon)
    score = (F.col("multinomial") + poisson_weight * F.col("poisson")) * F.lit(factor)
    return terms.withColumn("score", score)


def _with_row_sum(pairs: DataFrame, value: Column) -> DataFrame:
    """Add ``row_sum``, the sum of ``value`` over the row's (index, track).

    A grouped sum joined back and not a window: the join may split a hot group, a window may not.
    """
    return pairs.join(_row_sums(pairs, value), KEYS)


def _row_sums(pairs: DataFrame, value: Column) -> DataFrame:
    return pairs.groupBy(*KEYS).agg(F.sum(value).alias("row_sum"))


def _clamped_log_share(pred: Column, epsilon: float) -> Column:
    share = pred / F.greatest(F.col("row_sum"), F.lit(epsilon))
    return F.ln(F.greatest(share, F.lit(epsilon)))


def scaled_poisson_multinomial(
    pairs: DataFrame,
    tracks: DataFrame | None = None,
    *,
    n_bins: int | None = None,
    poisson_weight: float = POISSON_WEIGHT,
    epsilon: float = EPSILON,
    rescale: bool = False,
) -> DataFrame:
    """The same with targets hard-clipped and both sides scaled per track, shares floored at epsilon.

    ``tracks`` carries ``track, scale_factor, clip_hard``; without it nothing is clipped or scaled.
    """
    y, p = F.col("target") + epsilon, F.col("pred") + epsilon
    rows = pairs
    if tracks is not None:
        rows = pairs.join(tracks.select("track", "scale_factor", "clip_hard"), "track")
        y = F.least(y, F.col("clip_hard")) * F.col("scale_factor")
        p = p * F.col("scale_factor")
    prepared = rows.select(*KEYS, y.alias("__y"), p.alias("__p"))
    sums = _with_row_sum(prepared, F.col("__p")).groupBy(*KEYS).agg(
        F.sum(F.col("__y") * _clamped_log_share(F.col("__p"), epsilon)).alias("__ylnp"),
        F.sum("__y").alias("__sy"), F.first("row_sum").alias("__sp"), _length(n_bins).alias("__l"),
    )
    factor = 2.0 / (1.0 + poisson_weight) if rescale else 1.0
    multinomial = -F.col("__ylnp") / F.col("__l")
    poisson = _poisson(F.col("__sp"), F.col("__sy")) / F.col("__l")
    return sums.select(
        *KEYS, multinomial.alias("multinomial"), poisson.alias("poisson"),
        ((multinomial + poisson_weight * poisson) * F.lit(factor)).alias("score"),
    )


def transfer_calibration(
    pairs: DataFrame,
    *,
    n_bins: int | None = None,
    profile_weight: float = 1.0,
    total_weight: float = 0.5,
    bin_weight: float = 0.1,
    topk_bin_weight: float = 0.0,
    topk_bin_count: int = 0,
    topk_huber_delta: float = 1.0,
    epsilon: float = EPSILON,
) -> DataFrame:
    """Profile cross-entropy, squared error of log totals and of log bins, Huber on the top bins.

    The last three read ``raw_pred`` and ``raw_target`` where ``pairs`` has them.
    """
    raw = "raw_target" in pairs.columns
    rows = pairs if raw else pairs.withColumns({"raw_pred": F.col("pred"), "raw_target": F.col("target")})
    y, p = F.col("target") + epsilon, F.col("pred") + epsilon
    ry, rp = F.col("raw_target") + epsilon, F.col("raw_pred") + epsilon
    gap = F.log1p(rp) - F.log1p(ry)
    sums = _with_row_sum(rows, p).groupBy(*KEYS).agg(
        F.sum(y * _clamped_log_share(p, epsilon)).alias("__ylnp"),
        F.sum(ry).alias("__sy"), F.sum(rp).alias("__sp"),
        F.avg(gap * gap).alias("bin_term"), _length(n_bins).alias("__l"),
    )
    total = F.log1p("__sp") - F.log1p("__sy")
    terms = sums.select(
        *KEYS, (-F.col("__ylnp") / F.col("__l")).alias("profile_term"), (total * total).alias("total_term"), "bin_term"
    )
    if topk_bin_weight > 0 and topk_bin_count > 0:
        peaks = top_k(rows, KEYS, [F.desc("raw_target"), F.asc("bin"), F.asc("raw_pred")], topk_bin_count)
        top = peaks.groupBy(*KEYS).agg(F.avg(huber(gap, topk_huber_delta)).alias("topk_term"))
        terms = terms.join(top, KEYS)
    else:
        terms = terms.withColumn("topk_term", F.lit(0.0))
    return terms.withColumn(
        "score",
        profile_weight * F.col("profile_term") + total_weight * F.col("total_term")
        + bin_weight * F.col("bin_term") + topk_bin_weight * F.col("topk_term"),
    )


def topk_additive(
    pairs: DataFrame,
    *,
    n_bins: int,
    topk_fraction: float = TOPK_FRACTION,
    topk_weight: float = 1.0,
    poisson_weight: float = POISSON_WEIGHT,
    epsilon: float = EPSILON,
) -> DataFrame:
    """:func:`poisson_multinomial` plus a weighted second one over the top bins alone."""
    k = peak_count(n_bins, topk_fraction)
    base = _profile_and_total(pairs, n_bins, epsilon, "_base")
    top = _profile_and_total(_peaks(pairs, k), k, epsilon, "_top")
    score = lambda suffix: F.col(f"multinomial{suffix}") + poisson_weight * F.col(f"poisson{suffix}")
    return base.join(top, KEYS).select(
        *KEYS, score("_base").alias("base"), score("_top").alias("peak"),
        (score("_base") + topk_weight * score("_top")).alias("score"),
    )


def topk_reweight(
    pairs: DataFrame,
    *,
    n_bins: int,
    topk_fraction: float = TOPK_FRACTION,
    topk_weight: float = 4.0,
    poisson_weight: float = POISSON_WEIGHT,
    epsilon: float = EPSILON,
) -> DataFrame:
    """Cross-entropy with the top bins counted ``topk_weight`` times, plus the Poisson term.

    The weighted sum is the sum over all bins plus ``topk_weight - 1`` times the sum over the top bins.
    """
    y, p = F.col("target") + epsilon, F.col("pred") + epsilon
    entropy = F.sum(y * _clamped_log_share(p, epsilon))
    whole = _with_row_sum(pairs, p).groupBy(*KEYS).agg(
        entropy.alias("__all"), F.sum(y).alias("__sy"), F.first("row_sum").alias("__sp")
    )
    # The top bins are cut out first; only they are joined to the row sums, whose shuffle is reused.
    peaks = _peaks(pairs, peak_count(n_bins, topk_fraction)).join(_row_sums(pairs, p), KEYS)
    top = peaks.groupBy(*KEYS).agg(entropy.alias("__top"))
    length = float(n_bins)
    multinomial = -(F.col("__all") + (topk_weight - 1.0) * F.col("__top")) / length
    poisson = _poisson(F.col("__sp"), F.col("__sy")) / length
    return whole.join(top, KEYS).select(
        *KEYS, multinomial.alias("multinomial"), poisson.alias("poisson"),
        (multinomial + poisson_weight * poisson).alias("score"),
    )


def _per_bin(pairs: DataFrame, value: Column) -> DataFrame:
    return pairs.groupBy(*KEYS).agg(F.avg(value).alias("score"))


def log1p_huber(pairs: DataFrame, *, delta: float = HUBER_DELTA, epsilon: float = EPSILON, **_: Any) -> DataFrame:
    """Huber of log values, negatives counted as 0."""
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0)) + epsilon)
    return _per_bin(pairs, huber(log("pred") - log("target"), delta))


def poisson_nll(pairs: DataFrame, *, epsilon: float = EPSILON, **_: Any) -> DataFrame:
    """Poisson negative log-likelihood per bin; the log has its own 1e-8."""
    p = F.greatest(F.col("pred"), F.lit(epsilon))
    return _per_bin(pairs, p - F.col("target") * F.ln(p + NLL_EPSILON))


def squared_error(pairs: DataFrame, **_: Any) -> DataFrame:
    e = F.col("pred") - F.col("target")
    return _per_bin(pairs, e * e)


def paired_fold_change_score(
    pairs: DataFrame, *, pseudocount: float = 1.0, delta: float = FOLD_CHANGE_DELTA
) -> DataFrame:
    """One row: mean Huber of paired per-bin fold changes, 0 without any pair."""
    changes = paired_fold_changes(pairs, pseudocount)
    gap = F.col("pred_lfc") - F.col("meas_lfc")
    return changes.agg(F.coalesce(F.avg(huber(gap, delta)), F.lit(0.0)).alias("score"))


# Defaults of the named configurations.
SCORE_DEFAULTS = {
    "transfer_calibration": {
        "profile_weight": 0.05, "total_weight": 0.5, "bin_weight": 2.0,
        "topk_bin_weight": 1.0, "topk_bin_count": 20, "topk_huber_delta": 1.0,
    },
    "topk_reweight": {"poisson_weight": 0.2, "topk_fraction": 0.04, "topk_weight": 4.0},
    "topk_additive": {"poisson_weight": 0.2, "topk_fraction": 0.04, "topk_weight": 1.0},
}


def scorer(
    config: Mapping[str, Any],
    *,
    n_bins: int | None = None,
    tracks: DataFrame | None = None,
    already_scaled: bool = False,
) -> Callable[[DataFrame], DataFrame]:
    """Scorer for a loss configuration ``{'name': ..., options}``; an unknown name is an error.

    Options left out have the defaults of the configuration of that name, which are not those of the
    function it calls.
    """
    name = config.get("name", "poisson_multinomial")
    given = {**SCORE_DEFAULTS.get(name, {}), **config}
    option = lambda *names: {n: given[n] for n in names if n in given}
    if name == "poisson_multinomial":
        return lambda pairs: poisson_multinomial(pairs, n_bins=n_bins, **option("poisson_weight"))
    if name == "scaled_poisson_multinomial":
        dimension = None if already_scaled else tracks
        return lambda pairs: scaled_poisson_multinomial(pairs, dimension, n_bins=n_bins, **option("poisson_weight"))
    if name == "transfer_calibration":
        chosen = option(
            "profile_weight", "total_weight", "bin_weight", "topk_bin_weight", "topk_bin_count", "topk_huber_delta"
        )
        return lambda pairs: transfer_calibration(pairs, n_bins=n_bins, **chosen)
    if name in ("topk_additive", "topk_reweight"):
        if n_bins is None:
            raise ValueError(f"{name} needs n_bins")
        chosen = option("topk_fraction", "topk_weight", "poisson_weight")
        form = topk_additive if name == "topk_additive" else topk_reweight
        return lambda pairs: form(pairs, n_bins=n_bins, **chosen)
    if name == "log1p_huber":
        return lambda pairs: log1p_huber(pairs, **option("delta"))
    if name == "poisson_nll":
        return poisson_nll
    if name == "mse":
        return squared_error
    raise ValueError(f"unknown loss name {name!r}")
