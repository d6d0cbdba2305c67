"""Evaluation metrics over long ``pairs(index, track, bin, pred, target)``.

An undefined metric is NULL. Everything is built from sums that merge, so partial aggregation does
most of the work before any shuffle; ranks are parallel prefix sums, quantiles a selection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genotiles.functions.numeric import finite_pair, ratio
from genotiles.functions.stats import (
    MIN_STD,
    pearson_guard_product,
    pearson_guard_std,
    pearson_guard_terms,
)
from genotiles.functions.tensors import row_sums
from genotiles.operators.ordering import ordered_counts, quantiles, quantiles_of, top_k
from genotiles.session import cut_lineage

AMPLITUDE_QUANTILE = 0.99
FOLD_CHANGE_QUANTILE = 0.80

# The statistics of one (example, track), three groups of six.
SUMS = ("sum_p", "sum_t", "sum_pt", "sum_p2", "sum_t2", "n")


def _finite(pairs: DataFrame, x: str = "pred", y: str = "target") -> DataFrame:
    return pairs.where(finite_pair(F.col(x), F.col(y)))


def _pearson(x: str, y: str) -> Column:
    """Aggregate: Pearson over finite pairs; NULL with fewer than two or a flat side."""
    both = finite_pair(F.col(x), F.col(y))
    return pearson_guard_std(F.when(both, F.col(x)), F.when(both, F.col(y)))


def _errors() -> tuple[Column, Column]:
    """Aggregates: mean squared and mean absolute error over finite pairs."""
    error = F.when(finite_pair(F.col("pred"), F.col("target")), F.col("pred") - F.col("target"))
    return F.avg(error * error), F.avg(F.abs(error))


def _spread(x: str, y: str) -> list[Column]:
    """Aggregates that say whether ranks and high quantiles of a group are defined: finite pairs, spread of both sides.

    Over all pairs, so that a group without a finite pair keeps its row.
    """
    known = finite_pair(F.col(x), F.col(y))
    sides = [F.stddev_pop(F.when(known, F.col(c))) for c in (x, y)]
    return [F.count_if(known).alias("__count"), sides[0].alias("__sx"), sides[1].alias("__sy")]


def pearson(pairs: DataFrame, by: Sequence[str], x: str = "pred", y: str = "target") -> DataFrame:
    """Pearson per group; NULL with fewer than two finite pairs or a flat side."""
    return pairs.groupBy(*by).agg(_pearson(x, y).alias("pearson"))


def track_errors(pairs: DataFrame, by: Sequence[str] = ("track",)) -> DataFrame:
    """Mean squared and mean absolute error per group."""
    mse, mae = _errors()
    return pairs.groupBy(*by).agg(mse.alias("mse"), mae.alias("mae"))


def joint_counts(pairs: DataFrame, by: Sequence[str], x: str = "pred", y: str = "target") -> DataFrame:
    """``(by..., x, y, __n)``: equal finite pairs counted, written down. Ranks, quantiles and sums come from these."""
    return cut_lineage(_finite(pairs, x, y).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__n")))


def _rank_correlation(joint: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``(by..., __r)`` with average ranks for ties, of every group with two different values on both sides.

    Ranks are parallel prefix sums and are centred before they are multiplied, so the sums stay
    exact for very long tracks.
    """
    centred = F.col("n_below") + (F.col("n_equal") - F.col("n_total")) / F.lit(2.0)
    both = ordered_counts(
        joint.unpivot([*by, "__n"], [x, y], "__column", "__value"), [*by, "__column"], "__value", weight="__n"
    )

    def ranks(column: str, out: str) -> DataFrame:
        return both.where(F.col("__column") == column).select(*by, F.col("__value").alias(column), centred.alias(out))

    placed = joint.join(ranks(x, "__rx"), [*by, x]).join(ranks(y, "__ry"), [*by, y])
    weighted = lambda a, b: F.sum(F.col("__n") * F.col(a) * F.col(b))
    sums = placed.groupBy(*by).agg(
        weighted("__rx", "__ry").alias("__xy"),
        weighted("__rx", "__rx").alias("__xx"), weighted("__ry", "__ry").alias("__yy"),
    )
    return sums.select(*by, ratio(F.col("__xy"), F.sqrt(F.col("__xx") * F.col("__yy"))).alias("__r"))


def _spearman() -> Column:
    defined = (F.col("__count") >= 2) & (F.col("__sx") >= MIN_STD) & (F.col("__sy") >= MIN_STD)
    return F.when(defined, F.col("__r")).alias("spearman")


def spearman(pairs: DataFrame, by: Sequence[str], x: str = "pred", y: str = "target") -> DataFrame:
    """Spearman per group with average ranks for ties; NULL with fewer than two finite pairs or a flat side."""
    by = list(by)
    found = _rank_correlation(joint_counts(pairs, by, x, y), by, x, y)
    spread = pairs.groupBy(*by).agg(*_spread(x, y))
    # Without groups both sides are one row.
    both_sides = spread.join(found, by, "left") if by else spread.withColumn("__r", found.select("__r").scalar())
    return both_sides.select(*by, _spearman())


def _high_values(rows: DataFrame, by: list[str], quantile: float, weight: str | None = None) -> DataFrame:
    """``(by..., high_pred, high_target)``: a high quantile of the sizes on either side."""
    carried = [weight] if weight else []
    sizes = rows.select(*by, F.abs("pred").alias("__p"), F.abs("target").alias("__t"), *carried)
    return quantiles_of(sizes, by, {"high_pred": ("__p", quantile), "high_target": ("__t", quantile)}, weight)


def _amplitude() -> Column:
    defined = (F.col("__count") >= 2) & (F.col("high_target") > MIN_STD)
    return F.when(defined, ratio(F.col("high_pred"), F.col("high_target"))).alias("amplitude_calibration")


def amplitude_calibration(
    pairs: DataFrame, by: Sequence[str] = ("track",), quantile: float = AMPLITUDE_QUANTILE
) -> DataFrame:
    """Ratio of high quantiles of ``|pred|`` and ``|target|`` per group."""
    by = list(by)
    high = _high_values(_finite(pairs), by, quantile)
    return pairs.groupBy(*by).agg(*_spread("pred", "target")).join(high, by, "left").select(*by, _amplitude())


def group_report(pairs: DataFrame, by: Sequence[str], quantile: float = AMPLITUDE_QUANTILE) -> DataFrame:
    """Pearson, Spearman, amplitude calibration and errors per group, from two passes over the pairs.

    All plain sums are one aggregate; ranks and quantiles come from the counts of equal pairs, written by the other.
    """
    by = list(by)
    mse, mae = _errors()
    sums = pairs.groupBy(*by).agg(
        _pearson("pred", "target").alias("pearson"), mse.alias("mse"), mae.alias("mae"), *_spread("pred", "target")
    )
    joint = joint_counts(pairs, by)
    ranked, high = _rank_correlation(joint, by, "pred", "target"), _high_values(joint, by, quantile, "__n")
    return sums.join(ranked, by, "left").join(high, by, "left").select(*by, "pearson", _spearman(), _amplitude(), "mse", "mae")


def _six_sums(p: Column, t: Column, suffix: str) -> list[Column]:
    sums = (F.sum(p), F.sum(t), F.sum(p * t), F.sum(p * p), F.sum(t * t), F.count(F.lit(1)))
    return [c.alias(f"{name}_{suffix}") for name, c in zip(SUMS, sums)]


def example_statistics(pairs: DataFrame, topk_bins: int) -> DataFrame:
    """18 statistics per (index, track): six sums over all bins, six over the ``topk_bins`` bins with
    the largest target, six of the example's totals.

    The top bins are cut to ``topk_bins`` rows per task and group before they are shuffled; the sums
    over all bins are combined before theirs.
    """
    keys = ["index", "track"]
    p, t = F.col("pred"), F.col("target")
    whole = pairs.groupBy(*keys).agg(*_six_sums(p, t, "all"))
    peaks = top_k(pairs, keys, [F.desc("target"), F.asc("bin"), F.asc("pred")], topk_bins)
    top = peaks.groupBy(*keys).agg(*_six_sums(p, t, "top"))
    sp, st = F.col("sum_p_all"), F.col("sum_t_all")
    totals = (sp, st, sp * st, sp * sp, st * st, F.lit(1).cast("bigint"))
    return whole.join(top, keys).select(
        "*", *[c.alias(f"{name}_total") for name, c in zip(SUMS, totals)]
    )


def nested_statistics(examples: DataFrame, topk_bins: int) -> DataFrame:
    """The same 18 statistics from nested rows ``(index, track, pred, target)`` of equal-length arrays.

    Everything happens inside the row, so it also runs on a stream without keyed state. Top bins are a partial selection,
    and all sums one pass over a batch's buffers. A row with a NULL value has NULL sums.
    """
    rows = examples.select("index", "track", row_sums(topk_bins)(F.col("pred"), F.col("target")).alias("s"))
    part = lambda suffix: [F.col(f"s.{name}_{suffix}").alias(f"{name}_{suffix}") for name in SUMS]
    rows = rows.select("index", "track", *part("all"), *part("top"))
    sp, st = F.col("sum_p_all"), F.col("sum_t_all")
    totals = (sp, st, sp * st, sp * sp, st * st, F.lit(1).cast("bigint"))
    return rows.select("*", *[c.alias(f"{name}_total") for name, c in zip(SUMS, totals)])


def accumulate_statistics(statistics: DataFrame) -> DataFrame:
    """Sums of the 18 statistics per track; additive over batches, streams and partitions."""
    names = [f"{name}_{suffix}" for suffix in ("all", "top", "total") for name in SUMS]
    return statistics.groupBy("track").agg(*[F.sum(name).alias(name) for name in names])


def track_correlations(accumulated: DataFrame) -> DataFrame:
    """Per track the three correlations that the accumulated sums give."""
    def from_sums(suffix: str) -> Column:
        column = {name: F.col(f"{name}_{suffix}") for name in SUMS}
        return pearson_guard_product(
            column["n"], column["sum_p"], column["sum_t"], column["sum_p2"], column["sum_t2"], column["sum_pt"]
        )
    return accumulated.select(
        "track", from_sums("all").alias("r_bin"), from_sums("top").alias("r_top"), from_sums("total").alias("r_total")
    )


def median_correlations(accumulated: DataFrame, topk_bins: int) -> DataFrame:
    """One row: medians over tracks; tracks without variance are left out."""
    return track_correlations(accumulated).agg(
        F.percentile("r_bin", 0.5).alias("pearson_bin_median"),
        F.percentile("r_top", 0.5).alias(f"pearson_top{topk_bins}_median"),
        F.percentile("r_total", 0.5).alias("pearson_total_median"),
    )


# Fold changes ---------------------------------------------------------------------------------

def log2_fold_change(
    pairs: DataFrame, baseline: Column, perturbed: Column, pseudocount: float = 1.0
) -> DataFrame:
    """Per example ``log2(b + ps) - log2(a + ps)`` of predictions and measurements.

    Signals are averaged over the tracks of a side per bin, then summed over bins. A side is a
    predicate on the track columns.
    """
    def of(column: str) -> tuple[Column, Column]:
        return F.avg(F.when(baseline, F.col(column))), F.avg(F.when(perturbed, F.col(column)))

    (pa, pb), (ta, tb) = of("pred"), of("target")
    per_bin = pairs.groupBy("index", "bin").agg(pa.alias("pa"), pb.alias("pb"), ta.alias("ta"), tb.alias("tb"))
    change = lambda a, b: F.log2(F.sum(b) + pseudocount) - F.log2(F.sum(a) + pseudocount)
    return per_bin.groupBy("index").agg(
        change("pa", "pb").alias("pred_lfc"), change("ta", "tb").alias("meas_lfc")
    )


def paired_groups(tracks: DataFrame, group: str | None = "group_id") -> DataFrame:
    """Groups of tracks that have both a baseline (condition 0) and a perturbed (condition 1) track."""
    grouped = tracks if group else tracks.withColumn("group_id", F.lit(0))
    return grouped.groupBy(group or "group_id").agg(
        F.count_if(F.col("condition_id") == 0).alias("n_baseline"),
        F.count_if(F.col("condition_id") == 1).alias("n_perturbed"),
    ).where((F.col("n_baseline") > 0) & (F.col("n_perturbed") > 0))


def paired_fold_changes(pairs: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """Per (index, group, bin) log2 fold change between the mean perturbed and mean baseline track.

    ``pairs`` carries ``condition_id`` and, unless all tracks are one group, ``group_id``. Tracks are
    averaged before the log. Groups that lack a side drop out.
    """
    if "group_id" not in pairs.columns:
        pairs = pairs.withColumn("group_id", F.lit(0))
    side = lambda condition, column: F.avg(F.when(F.col("condition_id") == condition, F.col(column)))
    change = lambda column: (
        F.log2(side(1, column) + pseudocount) - F.log2(side(0, column) + pseudocount)
    )
    return (
        pairs.groupBy("index", "group_id", "bin")
        .agg(change("pred").alias("pred_lfc"), change("target").alias("meas_lfc"))
        .where(F.col("pred_lfc").isNotNull() & F.col("meas_lfc").isNotNull())
    )


def fold_change_report(changes: DataFrame) -> DataFrame:
    """One row: Pearson, Spearman, and Pearson over the rows with the largest measured changes.

    "Largest" is ``|meas| >=`` its 80th percentile; that part needs two rows and a prediction that is
    not flat there.
    """
    rows = cut_lineage(_finite(changes, "pred_lfc", "meas_lfc").select("pred_lfc", "meas_lfc", F.abs("meas_lfc").alias("size")))
    threshold = quantiles(rows, [], "size", {"threshold": FOLD_CHANGE_QUANTILE}).select("threshold").scalar()
    large = F.col("size") >= threshold
    top_pred, top_meas = F.when(large, F.col("pred_lfc")), F.when(large, F.col("meas_lfc"))
    linear = rows.agg(
        pearson_guard_std(F.col("pred_lfc"), F.col("meas_lfc")).alias("pearson"),
        F.when(
            (F.count(top_pred) >= 2) & (F.stddev_pop(top_pred) > MIN_STD),
            ratio(F.covar_pop(top_pred, top_meas), F.stddev_pop(top_pred) * F.stddev_pop(top_meas)),
        ).alias("top_variance_pearson"),
    )
    ranked = spearman(rows, [], "pred_lfc", "meas_lfc").select("spearman").scalar()
    defined = F.col("pearson").isNotNull()
    return linear.select(
        "pearson", ranked.alias("spearman"), F.when(defined, F.col("top_variance_pearson")).alias("top_variance_pearson")
    )


# Mergeable reconstruction state ------------------------------------------------------------------

STATE = ("n", "sum_pred", "sum_target", "sum_pred_sq", "sum_target_sq", "sum_cross", "sum_abs_error", "sum_sq_error")


def reconstruction_state(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The eight sums over finite pairs. States of disjoint inputs add up."""
    p, t = F.col("pred"), F.col("target")
    e = p - t
    sums = (F.count(F.lit(1)), F.sum(p), F.sum(t), F.sum(p * p), F.sum(t * t), F.sum(p * t), F.sum(F.abs(e)), F.sum(e * e))
    return _finite(pairs).groupBy(*by).agg(*[c.alias(name) for name, c in zip(STATE, sums)])


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(*[F.sum(name).alias(name) for name in STATE])


def finalize_state(state: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw Pearson, MAE and RMSE from the eight sums."""
    c = {name: F.col(name) for name in STATE}
    return state.select(
        *keep,
        pearson_guard_terms(
            c["n"], c["sum_pred"], c["sum_target"], c["sum_pred_sq"], c["sum_target_sq"], c["sum_cross"]
        ).alias("raw_pearson"),
        ratio(c["sum_abs_error"], c["n"]).alias("raw_mae"),
        F.sqrt(ratio(c["sum_sq_error"], c["n"])).alias("raw_rmse"),
    )


def final_report(state: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row: reconstruction metrics, fold-change metrics, balanced score.

    The balanced score is the mean of fold-change and raw Pearson where both are defined, the raw one
    where only that is.
    """
    raw = finalize_state(state)
    if changes is None:
        return raw.withColumn("balanced_score", F.col("raw_pearson"))
    delta = fold_change_report(changes)
    names = ("pearson", "spearman", "top_variance_pearson")
    joined = raw.withColumns({f"delta_{name}": delta.select(name).scalar() for name in names})
    both = F.when(
        F.col("delta_pearson").isNotNull(), 0.5 * (F.col("delta_pearson") + F.col("raw_pearson"))
    ).otherwise(F.col("raw_pearson"))
    return joined.withColumn("balanced_score", both)


def best_run(runs: DataFrame, run: str, metric: str, *, larger_is_better: bool = True) -> DataFrame:
    """One row: the run with the best defined value of a metric, first by name on ties."""
    value = F.col(metric) if larger_is_better else -F.col(metric)
    scored = runs.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    best = scored.agg(F.min_by(F.struct(run, metric), F.struct(-value, F.col(run))).alias("best"))
    return best.select(f"best.{run}", f"best.{metric}")
