"""Scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.operators import scores as S
from genotiles.queries import views as V
from genotiles.queries.base import Query, rounded, rounded_sql

N_BINS = 10
FRACTION = 0.25
TRANSFER = {
    "profile_weight": 0.05, "total_weight": 0.5, "bin_weight": 2.0,
    "topk_bin_weight": 1.0, "topk_bin_count": 4, "topk_huber_delta": 0.5,
}


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and hard clip per return flag."""
    flags = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("track")).distinct()
    scale = F.when(F.col("track") == "A", 0.5).when(F.col("track") == "N", 1.5).otherwise(2.0)
    return flags.select("track", scale.alias("scale_factor"), (scale * 20.0).alias("clip_hard"))


def per_example(scorer):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scorer(V.pairs(spark, sf_dir))
        return rows.select("index", "track", rounded("score").alias("score"))
    return build


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scaled_poisson_multinomial(V.pairs(spark, sf_dir), dimension(spark, sf_dir))
    return rows.select("index", "track", rounded("score").alias("score"))


def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile on predictions and targets, calibration on raw values three times as large."""
    rows = V.pairs(spark, sf_dir).withColumns({"raw_pred": F.col("pred") * 3, "raw_target": F.col("target") * 3})
    scored = S.transfer_calibration(rows, **TRANSFER)
    return scored.select("index", "track", *[rounded(c).alias(c) for c in ("profile_term", "total_term", "bin_term", "topk_term", "score")])


def mean_of(config: dict):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = S.scorer(config, n_bins=N_BINS, tracks=dimension(spark, sf_dir))(V.pairs(spark, sf_dir))
        return S.mean_score(scored).select(F.lit(config["name"]).alias("name"), rounded("score").alias("score"))
    return build


def fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paired_fold_change_score(V.cond_pairs(spark, sf_dir)).select(rounded("score").alias("score"))


_P = V.with_views("pairs")
_PM = """-(sum((target + 1e-6) * ln((pred + 1e-6) / sp))) / {l}
         + 0.2 * (max(sp) - sum(target + 1e-6) * ln(max(sp))) / {l}"""


def _poisson_multinomial(source: str, length: str, name: str) -> str:
    return (f"{name}_s AS (SELECT *, sum(pred + 1e-6) OVER (PARTITION BY index, track) AS sp FROM {source}), "
            f"{name} AS (SELECT index, track, {_PM.format(l=length)} AS score FROM {name}_s GROUP BY index, track)")


def _peaks(k: int) -> str:
    return ("ranked AS (SELECT *, row_number() OVER (PARTITION BY index, track ORDER BY target DESC, bin, pred) AS rn "
            f"FROM pairs), peaks AS (SELECT * FROM ranked WHERE rn <= {k})")


def _huber(gap: str, delta: float) -> str:
    return (f"CASE WHEN abs({gap}) <= {delta} THEN 0.5 * ({gap}) * ({gap}) "
            f"ELSE {delta} * (abs({gap}) - {0.5 * delta}) END")


_K = S.peak_count(N_BINS, FRACTION)
_LOG_GAP = "(ln(1 + greatest(pred, 0) + 1e-6) - ln(1 + greatest(target, 0) + 1e-6))"
_REWEIGHT = f"""{_peaks(_K)},
    w AS (SELECT *, sum(pred + 1e-6) OVER (PARTITION BY index, track) AS sp FROM ranked),
    score AS (SELECT index, track,
        -sum(CASE WHEN rn <= {_K} THEN 4.0 ELSE 1.0 END * (target + 1e-6)
             * ln(greatest((pred + 1e-6) / sp, 1e-6))) / {N_BINS}
        + 0.2 * (max(sp) - sum(target + 1e-6) * ln(max(sp))) / {N_BINS} AS score
        FROM w GROUP BY index, track)"""
_SCALED = """sizes AS (SELECT index, track, least(target + 1e-6, clip) * scale AS y, (pred + 1e-6) * scale AS p
              FROM (SELECT *, CASE track WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.5 ELSE 2.0 END AS scale,
                           CASE track WHEN 'A' THEN 10.0 WHEN 'N' THEN 30.0 ELSE 40.0 END AS clip FROM pairs)),
    t AS (SELECT *, sum(p) OVER (PARTITION BY index, track) AS sp FROM sizes),
    score AS (SELECT index, track, -sum(y * ln(greatest(p / sp, 1e-6))) / {l}
              + 0.2 * (max(sp) - sum(y) * ln(max(sp))) / {l} AS score FROM t GROUP BY index, track)"""
_TRANSFER = f"""{_peaks(4)},
    s AS (SELECT *, sum(pred + 1e-6) OVER (PARTITION BY index, track) AS sp,
                 ln(1 + pred * 3 + 1e-6) - ln(1 + target * 3 + 1e-6) AS gap FROM ranked),
    terms AS (SELECT index, track,
        -sum((target + 1e-6) * ln(greatest((pred + 1e-6) / sp, 1e-6))) / count(*) AS profile_term,
        pow(ln(1 + sum(pred * 3 + 1e-6)) - ln(1 + sum(target * 3 + 1e-6)), 2) AS total_term,
        avg(gap * gap) AS bin_term, avg({_huber('gap', 0.5)}) FILTER (rn <= 4) AS topk_term
        FROM s GROUP BY index, track)"""

_SCORE = f"SELECT index, track, {rounded_sql('score')} AS score FROM score"
_MEAN = f"{rounded_sql('avg(score)')} AS score FROM score"

_SQL = {
    "poisson_multinomial": _poisson_multinomial("pairs", "count(*)", "score"),
    "rescaled": _poisson_multinomial("pairs", "count(*)", "plain")
    + ", score AS (SELECT index, track, score * 2.0 / 1.2::DOUBLE AS score FROM plain)",
    "scaled": _SCALED.format(l="count(*)"),
    "topk_additive": _peaks(_K) + ", " + _poisson_multinomial("pairs", str(N_BINS), "base") + ", "
    + _poisson_multinomial("peaks", str(_K), "peak")
    + ", score AS (SELECT index, track, base.score + 1.5 * peak.score AS score FROM base JOIN peak USING (index, track))",
    "topk_reweight": _REWEIGHT,
    "log1p_huber": f"score AS (SELECT index, track, avg({_huber(_LOG_GAP, 0.7)}) AS score FROM pairs GROUP BY index, track)",
    "poisson_nll": "score AS (SELECT index, track, avg(greatest(pred, 1e-6) - target * ln(greatest(pred, 1e-6) + 1e-8)) "
    "AS score FROM pairs GROUP BY index, track)",
    "mse": "score AS (SELECT index, track, avg((pred - target) * (pred - target)) AS score FROM pairs GROUP BY index, track)",
}


def mean_score_sql(n_bins: int) -> dict[str, str]:
    """CTEs that end in ``score`` for the scorers of the evaluation, over examples of ``n_bins`` bins."""
    return {
        "poisson_multinomial": _poisson_multinomial("pairs", str(n_bins), "score"), "mse": _SQL["mse"],
        "log1p_huber": f"score AS (SELECT index, track, avg({_huber(_LOG_GAP, 1.0)}) AS score FROM pairs GROUP BY index, track)",
        "poisson_nll": _SQL["poisson_nll"], "topk_reweight": _REWEIGHT,
    }


def _example(name: str, operators: str, scorer, sql: str) -> Query:
    return Query(f"score_{name}", operators, per_example(scorer), f"{_P}, {_SQL[sql]} {_SCORE}")


QUERIES = [
    _example("poisson_multinomial", "LOSS-1", S.poisson_multinomial, "poisson_multinomial"),
    _example("poisson_multinomial_rescaled", "LOSS-1", lambda p: S.poisson_multinomial(p, rescale=True), "rescaled"),
    Query("score_scaled_poisson_multinomial", "LOSS-2", scaled, f"{_P}, {_SQL['scaled']} {_SCORE}"),
    Query("score_transfer_calibration", "LOSS-3 TOP-1", transfer, f"""{_P}, {_TRANSFER}
        SELECT index, track, {rounded_sql('profile_term')} AS profile_term, {rounded_sql('total_term')} AS total_term,
               {rounded_sql('bin_term')} AS bin_term, {rounded_sql('topk_term')} AS topk_term,
               {rounded_sql('0.05 * profile_term + 0.5 * total_term + 2.0 * bin_term + topk_term')} AS score FROM terms"""),
    _example("topk_additive", "LOSS-4 TOP-1",
             lambda p: S.topk_additive(p, n_bins=N_BINS, topk_fraction=FRACTION, topk_weight=1.5), "topk_additive"),
    _example("topk_reweight", "LOSS-5 TOP-1",
             lambda p: S.topk_reweight(p, n_bins=N_BINS, topk_fraction=FRACTION), "topk_reweight"),
    _example("log1p_huber", "LOSS-6", lambda p: S.log1p_huber(p, delta=0.7), "log1p_huber"),
    _example("poisson_nll", "LOSS-7", S.poisson_nll, "poisson_nll"),
    _example("squared_error", "LOSS-8", S.squared_error, "mse"),
    Query("score_paired_fold_change", "LOSS-9", fold_change, f"""{V.with_views('cond_pairs')},
        sides AS (SELECT index, group_id, bin,
                         avg(pred) FILTER (condition_id = 0) AS p0, avg(pred) FILTER (condition_id = 1) AS p1,
                         avg(target) FILTER (condition_id = 0) AS t0, avg(target) FILTER (condition_id = 1) AS t1
                  FROM cond_pairs GROUP BY index, group_id, bin),
        gaps AS (SELECT log2(p1 + 1) - log2(p0 + 1) - (log2(t1 + 1) - log2(t0 + 1)) AS gap
                 FROM sides WHERE p0 IS NOT NULL AND p1 IS NOT NULL)
        SELECT {rounded_sql(f'coalesce(avg({_huber("gap", 0.5)}), 0)')} AS score FROM gaps"""),
    Query("mean_score_mse", "LOSS-8 LOSS-10", mean_of({"name": "mse"}),
          f"{_P}, {_SQL['mse']} SELECT 'mse' AS name, {_MEAN}"),
    Query("mean_score_poisson_nll", "LOSS-7 LOSS-10", mean_of({"name": "poisson_nll"}),
          f"{_P}, {_SQL['poisson_nll']} SELECT 'poisson_nll' AS name, {_MEAN}"),
    Query("mean_score_log1p_huber", "LOSS-6 LOSS-10", mean_of({"name": "log1p_huber", "delta": 0.7}),
          f"{_P}, {_SQL['log1p_huber']} SELECT 'log1p_huber' AS name, {_MEAN}"),
    Query("mean_score_topk_reweight", "LOSS-5 LOSS-10",
          mean_of({"name": "topk_reweight", "topk_fraction": FRACTION, "topk_weight": 4.0}),
          f"{_P}, {_SQL['topk_reweight']} SELECT 'topk_reweight' AS name, {_MEAN}"),
    Query("mean_score_scaled", "LOSS-2 LOSS-10", mean_of({"name": "scaled_poisson_multinomial"}),
          f"{_P}, {_SCALED.format(l=N_BINS)} SELECT 'scaled_poisson_multinomial' AS name, {_MEAN}"),
]
