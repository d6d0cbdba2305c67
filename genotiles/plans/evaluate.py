"""Evaluation verb: sample, transform, metrics and scores of a pairs table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.operators import metrics as M
from genotiles.operators.sampling import random_sample
from genotiles.operators.scores import mean_score, scorer


def track_report(pairs: DataFrame) -> DataFrame:
    """All per-track metrics side by side."""
    return M.group_report(pairs, ["track"])


def evaluate(pairs: DataFrame, topk_bins: int, n_bins: int, losses: Sequence[Mapping[str, Any]]) -> DataFrame:
    """``(metric, value)``: median correlations and the mean of every configured score."""
    medians = M.median_correlations(M.accumulate_statistics(M.example_statistics(pairs, topk_bins)), topk_bins)
    columns = medians.columns
    report = medians.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("m")
    ).select("m.*")
    for config in losses:
        scored = mean_score(scorer(config, n_bins=n_bins)(pairs))
        report = report.unionByName(scored.select(F.lit(config["name"]).alias("metric"), F.col("score").alias("value")))
    return report


def pairs_from_nested(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """Long pairs from ``(index, values)`` and ``(index, labels)``, both ``[T][B]``."""
    joined = predictions.select("index", "values").join(examples.select("index", "labels"), "index")
    rows = joined.select("index", F.posexplode(F.arrays_zip("values", "labels")).alias("track", "r"))
    cells = rows.select(
        "index", "track", F.posexplode(F.arrays_zip(F.col("r.values").alias("p"), F.col("r.labels").alias("t"))).alias("bin", "c")
    )
    return cells.select(
        "index", "track", "bin",
        F.col("c.p").cast("double").alias("pred"), F.col("c.t").cast("double").alias("target"),
    )


def evaluate_examples(
    examples: DataFrame,
    predictions: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    *,
    topk_bins: int,
    n_bins: int,
    losses: Sequence[Mapping[str, Any]],
    max_samples: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Evaluate predictions ``(index, values)`` of stored examples in transformed label space.

    With ``max_samples`` a repeatable random sample of the examples is used, drawn before anything is
    transformed.
    """
    chosen = examples if max_samples is None else random_sample(examples, max_samples, seed)
    return evaluate(pairs_from_nested(predictions, chosen.transform(transform)), topk_bins, n_bins, losses)
