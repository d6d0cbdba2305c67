"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.operators import metrics as M
from genotiles.operators.ordering import top_k
from genotiles.plans.evaluate import evaluate, track_report
from genotiles.queries import views as V
from genotiles.queries.base import Query, rounded, rounded_sql
from genotiles.queries.score_queries import mean_score_sql

TOP = 8
N_BINS = 10

LOSSES = (
    {"name": "poisson_multinomial"}, {"name": "mse"}, {"name": "log1p_huber"}, {"name": "poisson_nll"},
    {"name": "topk_reweight", "topk_fraction": 0.25, "topk_weight": 4.0},
)


def by_track(metric, *columns: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(V.pairs(spark, sf_dir), ["track"]).select("track", *[rounded(c).alias(c) for c in columns])
    return build


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in which some values are missing, NaN or infinite."""
    rows = V.pairs(spark, sf_dir)
    kind = F.pmod("bin", F.lit(50))
    pred = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind != 2, F.col("pred"))
    return rows.withColumn("pred", pred)


def finite_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pearson(_holed(spark, sf_dir), ["track"]).select("track", rounded("pearson").alias("pearson"))


def example_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.pearson(V.pairs(spark, sf_dir), ["index", "track"])
    return rows.select("index", "track", rounded("pearson").alias("pearson"))


def global_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pearson(V.pairs(spark, sf_dir), []).select(rounded("pearson").alias("pearson"))


def top_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_k(V.pairs(spark, sf_dir), ["index", "track"], [F.desc("target"), F.asc("bin"), F.asc("pred")], TOP)
    return rows.select("index", "track", "bin", F.col("rank").cast("bigint").alias("rank"), "target", rounded("pred").alias("pred"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.example_statistics(V.pairs(spark, sf_dir), TOP)
    counts = [c for c in rows.columns if c.startswith("n_")]
    sums = [c for c in rows.columns if c.startswith("sum_")]
    return rows.select("index", "track", *[F.col(c).cast("bigint").alias(c) for c in counts], *[rounded(c, 3).alias(c) for c in sums])


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    accumulated = M.accumulate_statistics(M.example_statistics(V.pairs(spark, sf_dir), TOP))
    row = M.median_correlations(accumulated, TOP)
    return row.select(*[rounded(c).alias(c) for c in row.columns])


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    accumulated = M.accumulate_statistics(M.example_statistics(V.pairs(spark, sf_dir), TOP))
    rows = M.track_correlations(accumulated)
    return rows.select("track", *[rounded(c).alias(c) for c in ("r_bin", "r_top", "r_total")])


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per track and line count class, merged to one per track."""
    partial = M.reconstruction_state(
        V.pairs(spark, sf_dir).withColumn("part", F.pmod("bin", F.lit(16))), ["track", "part"]
    )
    merged = M.merge_states(partial, ["track"])
    return merged.select("track", F.col("n").cast("bigint").alias("n"), *[rounded(c, 2).alias(c) for c in M.STATE[1:]])


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.finalize_state(M.reconstruction_state(V.pairs(spark, sf_dir), ["track"]), ["track"])
    return rows.select("track", *[rounded(c).alias(c) for c in ("raw_pearson", "raw_mae", "raw_rmse")])


def fold_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.log2_fold_change(V.cond_pairs(spark, sf_dir), F.col("condition_id") == 0, F.col("condition_id") == 1)
    return rows.select("index", rounded("pred_lfc").alias("pred_lfc"), rounded("meas_lfc").alias("meas_lfc"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.paired_fold_changes(V.cond_pairs(spark, sf_dir))
    return rows.select(
        "index", "group_id", F.col("bin").cast("bigint").alias("bin"),
        rounded("pred_lfc").alias("pred_lfc"), rounded("meas_lfc").alias("meas_lfc"),
    )


def paired_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of suppliers by nation that have tracks of both conditions."""
    tracks = V.tracks(spark, sf_dir).withColumnRenamed("cell_line_id", "group_id")
    return M.paired_groups(tracks)


def fold_change_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.pearson(M.paired_fold_changes(V.cond_pairs(spark, sf_dir)), [], "pred_lfc", "meas_lfc")
    return rows.select(rounded("pearson").alias("pearson"))


def _steady_changes(cond_pairs: DataFrame) -> DataFrame:
    """Fold changes to nine digits, so that equal changes rank as ties in every engine."""
    rows = M.paired_fold_changes(cond_pairs)
    return rows.withColumns({c: F.round(c, 9) for c in ("pred_lfc", "meas_lfc")})


def fold_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = M.fold_change_report(_steady_changes(V.cond_pairs(spark, sf_dir)))
    return row.select(*[rounded(c).alias(c) for c in row.columns])


def final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = V.cond_pairs(spark, sf_dir)
    row = M.final_report(M.reconstruction_state(cond), _steady_changes(cond))
    return row.select(*[rounded(c).alias(c) for c in row.columns])


def best_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a run, its error over all lines the metric; the smallest error wins."""
    runs = M.track_errors(V.pairs(spark, sf_dir), ["index"]).withColumn("mse", F.round("mse", 6))
    return M.best_run(runs, "index", "mse", larger_is_better=False)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track_report(V.pairs(spark, sf_dir))
    return rows.select("track", *[rounded(c).alias(c) for c in rows.columns if c != "track"])


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate(V.pairs(spark, sf_dir), TOP, N_BINS, LOSSES)
    return rows.select("metric", rounded("value").alias("value"))


def pearson_sql(x: str, y: str) -> str:
    return (f"CASE WHEN count(*) >= 2 AND stddev_pop({x}) >= 1e-8 AND stddev_pop({y}) >= 1e-8 "
            f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")


def _ranks(by: str, x: str, y: str, source: str) -> str:
    def rank(c: str) -> str:
        return (f"rank() OVER (PARTITION BY {by} ORDER BY {c}) "
                f"+ (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0")
    return f"ranks AS (SELECT {by}, ({rank(x)})::DOUBLE AS rx, ({rank(y)})::DOUBLE AS ry FROM {source})"


_P = V.with_views("pairs")
_TOP_SQL = f"""tops AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index, track ORDER BY target DESC, bin, pred) AS rank
                   FROM pairs) WHERE rank <= {TOP})"""


def _six(suffix: str) -> str:
    return (f"sum(pred) AS sum_p_{suffix}, sum(target) AS sum_t_{suffix}, sum(pred * target) AS sum_pt_{suffix}, "
            f"sum(pred * pred) AS sum_p2_{suffix}, sum(target * target) AS sum_t2_{suffix}, count(*) AS n_{suffix}")


_STATS = f"""{_TOP_SQL},
    whole AS (SELECT index, track, {_six('all')} FROM pairs GROUP BY index, track),
    top_sums AS (SELECT index, track, {_six('top')} FROM tops GROUP BY index, track),
    stats AS (SELECT *, sum_p_all AS sum_p_total, sum_t_all AS sum_t_total, sum_p_all * sum_t_all AS sum_pt_total,
                     sum_p_all * sum_p_all AS sum_p2_total, sum_t_all * sum_t_all AS sum_t2_total,
                     1::BIGINT AS n_total
              FROM whole JOIN top_sums USING (index, track))"""
_NAMES = [f"{n}_{s}" for s in ("all", "top", "total") for n in M.SUMS]


def _r_sql(s: str) -> str:
    n, sp, st, spt, sp2, st2 = (f"sum({c}_{s})" for c in ("n", "sum_p", "sum_t", "sum_pt", "sum_p2", "sum_t2"))
    spread = (f"sqrt(greatest({n} * {sp2} - {sp} * {sp}, 0.0::DOUBLE) "
              f"* greatest({n} * {st2} - {st} * {st}, 0.0::DOUBLE))")
    return f"CASE WHEN {spread} > 0 THEN ({n} * {spt} - {sp} * {st}) / {spread} END"


_CORR = f"""{_STATS},
    corr AS (SELECT track, {_r_sql('all')} AS r_bin, {_r_sql('top')} AS r_top, {_r_sql('total')} AS r_total
             FROM stats GROUP BY track)"""

_FINAL = """
    CASE WHEN n >= 2 AND n * sum_pred_sq - sum_pred * sum_pred > 1e-12
              AND n * sum_target_sq - sum_target * sum_target > 1e-12
         THEN (n * sum_cross - sum_pred * sum_target)
              / sqrt((n * sum_pred_sq - sum_pred * sum_pred) * (n * sum_target_sq - sum_target * sum_target)) END"""
_STATE_SUMS = """count(*) AS n, sum(pred) AS sum_pred, sum(target) AS sum_target, sum(pred * pred) AS sum_pred_sq,
    sum(target * target) AS sum_target_sq, sum(pred * target) AS sum_cross,
    sum(abs(pred - target)) AS sum_abs_error, sum((pred - target) * (pred - target)) AS sum_sq_error"""

_CHANGES = f"""{V.with_views('cond_pairs')},
    sides AS (SELECT index, group_id, bin,
                     avg(pred) FILTER (condition_id = 0) AS p0, avg(pred) FILTER (condition_id = 1) AS p1,
                     avg(target) FILTER (condition_id = 0) AS t0, avg(target) FILTER (condition_id = 1) AS t1
              FROM cond_pairs GROUP BY index, group_id, bin),
    changes AS (SELECT index, group_id, CAST(bin AS BIGINT) AS bin, log2(p1 + 1) - log2(p0 + 1) AS pred_lfc,
                       log2(t1 + 1) - log2(t0 + 1) AS meas_lfc
                FROM sides WHERE p0 IS NOT NULL AND p1 IS NOT NULL)"""
_REPORT = f"""{_CHANGES},
    keyed AS (SELECT 0 AS k, round(pred_lfc, 9) AS pred_lfc, round(meas_lfc, 9) AS meas_lfc FROM changes),
    {_ranks('k', 'pred_lfc', 'meas_lfc', 'keyed')},
    cut AS (SELECT quantile_cont(abs(meas_lfc), 0.8) AS threshold FROM keyed),
    delta AS (SELECT
        (SELECT {pearson_sql('pred_lfc', 'meas_lfc')} FROM keyed) AS pearson,
        (SELECT {pearson_sql('rx', 'ry')} FROM ranks) AS spearman,
        (SELECT {pearson_sql('pred_lfc', 'meas_lfc')} FROM keyed
         WHERE abs(meas_lfc) >= (SELECT threshold FROM cut)) AS top_variance_pearson)"""

_TRACK_REPORT = f"""
    SELECT track, {rounded_sql(pearson_sql('pred', 'target'))} AS pearson,
           {rounded_sql('quantile_cont(abs(pred), 0.99) / quantile_cont(abs(target), 0.99)')} AS amplitude_calibration,
           {rounded_sql('avg((pred - target) * (pred - target))')} AS mse, {rounded_sql('avg(abs(pred - target))')} AS mae
    FROM pairs GROUP BY track"""

QUERIES = [
    Query("pearson_by_track", "MET-1", by_track(M.pearson, "pearson"),
          f"{_P} SELECT track, {rounded_sql(pearson_sql('pred', 'target'))} AS pearson FROM pairs GROUP BY track"),
    Query("pearson_by_example", "MET-1", example_pearson,
          f"{_P} SELECT index, track, {rounded_sql(pearson_sql('pred', 'target'))} AS pearson "
          "FROM pairs GROUP BY index, track"),
    Query("pearson_of_finite_pairs", "MET-1 FLT-9", finite_pearson,
          f"{_P} SELECT track, {rounded_sql(pearson_sql('pred', 'target'))} AS pearson "
          "FROM pairs WHERE bin % 50 > 2 GROUP BY track"),
    Query("pearson_overall", "MET-9", global_pearson,
          f"{_P} SELECT {rounded_sql(pearson_sql('pred', 'target'))} AS pearson FROM pairs"),
    Query("spearman_by_track", "MET-2", by_track(M.spearman, "spearman"),
          f"{_P}, {_ranks('track', 'pred', 'target', 'pairs')} "
          f"SELECT track, {rounded_sql(pearson_sql('rx', 'ry'))} AS spearman FROM ranks GROUP BY track"),
    Query("amplitude_by_track", "MET-3", by_track(M.amplitude_calibration, "amplitude_calibration"),
          f"{_P} SELECT track, {rounded_sql('quantile_cont(abs(pred), 0.99) / quantile_cont(abs(target), 0.99)')} "
          "AS amplitude_calibration FROM pairs GROUP BY track"),
    Query("errors_by_track", "MET-4 MET-5", by_track(M.track_errors, "mse", "mae"),
          f"{_P} SELECT track, {rounded_sql('avg((pred - target) * (pred - target))')} AS mse, "
          f"{rounded_sql('avg(abs(pred - target))')} AS mae FROM pairs GROUP BY track"),
    Query("track_report", "MET-1 MET-2 MET-3 MET-4 MET-5 PIPE-7", report,
          f"{_P}, {_ranks('track', 'pred', 'target', 'pairs')}, rest AS ({_TRACK_REPORT}) "
          f"SELECT rest.*, spearman FROM rest JOIN (SELECT track, {rounded_sql(pearson_sql('rx', 'ry'))} AS spearman "
          "FROM ranks GROUP BY track) USING (track)"),
    Query("top_bins", "TOP-1", top_bins,
          f"{_P}, {_TOP_SQL} SELECT index, track, bin, rank, target, {rounded_sql('pred')} AS pred FROM tops"),
    Query("example_statistics", "MET-7 TOP-1", statistics,
          f"{_P}, {_STATS} SELECT index, track, "
          + ", ".join(n if n.startswith("n_") else f"{rounded_sql(n, 3)} AS {n}" for n in _NAMES) + " FROM stats"),
    Query("track_correlations", "MET-6 MET-8", correlations,
          f"{_P}, {_CORR} SELECT track, " + ", ".join(f"{rounded_sql(c)} AS {c}" for c in ("r_bin", "r_top", "r_total"))
          + " FROM corr"),
    Query("median_correlations", "MET-8", medians,
          f"{_P}, {_CORR} SELECT {rounded_sql('quantile_cont(r_bin, 0.5)')} AS pearson_bin_median, "
          f"{rounded_sql('quantile_cont(r_top, 0.5)')} AS pearson_top{TOP}_median, "
          f"{rounded_sql('quantile_cont(r_total, 0.5)')} AS pearson_total_median FROM corr"),
    Query("reconstruction_state", "AGG-16", state,
          f"{_P}, s AS (SELECT track, {_STATE_SUMS} FROM pairs GROUP BY track) SELECT track, n, "
          + ", ".join(f"{rounded_sql(c, 2)} AS {c}" for c in M.STATE[1:]) + " FROM s"),
    Query("reconstruction_metrics", "AGG-16 MET-6 MET-14", finalized,
          f"{_P}, s AS (SELECT track, {_STATE_SUMS} FROM pairs GROUP BY track) "
          f"SELECT track, {rounded_sql(_FINAL)} AS raw_pearson, {rounded_sql('sum_abs_error / n')} AS raw_mae, "
          f"{rounded_sql('sqrt(sum_sq_error / n)')} AS raw_rmse FROM s"),
    Query("log2_fold_change", "MET-10", fold_changes, f"""{V.with_views('cond_pairs')},
        b AS (SELECT index, bin, avg(pred) FILTER (condition_id = 0) AS pa, avg(pred) FILTER (condition_id = 1) AS pb,
                     avg(target) FILTER (condition_id = 0) AS ta, avg(target) FILTER (condition_id = 1) AS tb
              FROM cond_pairs GROUP BY index, bin)
        SELECT index, {rounded_sql('log2(sum(pb) + 1) - log2(sum(pa) + 1)')} AS pred_lfc,
               {rounded_sql('log2(sum(tb) + 1) - log2(sum(ta) + 1)')} AS meas_lfc FROM b GROUP BY index"""),
    Query("paired_fold_changes", "MET-11 JOIN-12", paired,
          f"{_CHANGES} SELECT index, group_id, bin, {rounded_sql('pred_lfc')} AS pred_lfc, "
          f"{rounded_sql('meas_lfc')} AS meas_lfc FROM changes"),
    Query("paired_groups", "JOIN-12", paired_groups, f"""{V.with_views('tracks')}
        SELECT cell_line_id AS group_id, count(*) FILTER (condition_id = 0) AS n_baseline,
               count(*) FILTER (condition_id = 1) AS n_perturbed
        FROM tracks GROUP BY cell_line_id HAVING n_baseline > 0 AND n_perturbed > 0"""),
    Query("fold_change_pearson", "MET-12", fold_change_pearson,
          f"{_CHANGES} SELECT {rounded_sql(pearson_sql('pred_lfc', 'meas_lfc'))} AS pearson FROM changes"),
    Query("fold_change_report", "MET-13", fold_change_report,
          f"{_REPORT} SELECT " + ", ".join(f"{rounded_sql(c)} AS {c}" for c in ("pearson", "spearman", "top_variance_pearson"))
          + " FROM delta"),
    Query("final_report", "MET-14", final_report, f"""{_REPORT},
        s AS (SELECT {_STATE_SUMS} FROM cond_pairs),
        raw AS (SELECT {_FINAL} AS raw_pearson, sum_abs_error / n AS raw_mae, sqrt(sum_sq_error / n) AS raw_rmse FROM s)
        SELECT {rounded_sql('raw_pearson')} AS raw_pearson, {rounded_sql('raw_mae')} AS raw_mae,
               {rounded_sql('raw_rmse')} AS raw_rmse, {rounded_sql('pearson')} AS delta_pearson,
               {rounded_sql('spearman')} AS delta_spearman,
               {rounded_sql('top_variance_pearson')} AS delta_top_variance_pearson,
               {rounded_sql('0.5 * (pearson + raw_pearson)')} AS balanced_score FROM raw, delta"""),
    Query("best_run", "MET-15", best_part, f"""{_P},
        e AS (SELECT index, round(avg((pred - target) * (pred - target)), 6) AS mse FROM pairs GROUP BY index)
        SELECT index, mse FROM e ORDER BY mse, index LIMIT 1"""),
    Query("evaluation", "PIPE-7 LOSS-10", evaluation, f"""{_P}, {_CORR},
        medians AS (SELECT quantile_cont(r_bin, 0.5) AS b, quantile_cont(r_top, 0.5) AS t,
                           quantile_cont(r_total, 0.5) AS s FROM corr)
        SELECT 'pearson_bin_median' AS metric, {rounded_sql('b')} AS value FROM medians
        UNION ALL SELECT 'pearson_top{TOP}_median', {rounded_sql('t')} FROM medians
        UNION ALL SELECT 'pearson_total_median', {rounded_sql('s')} FROM medians
        """ + " ".join(f"UNION ALL SELECT '{name}', (WITH {sql} SELECT {rounded_sql('avg(score)')} FROM score)"
                       for name, sql in mean_score_sql(N_BINS).items())),
]
