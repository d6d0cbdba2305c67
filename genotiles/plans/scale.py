"""Scale-factor verbs: original scaling, TMM scaling, metadata enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.operators import scaling
from genotiles.operators.examples import example_means
from genotiles.operators.tracks import enrich

DEFAULT_FIELDS = ("scale_factor", "clip_soft", "clip_hard")


def original_scaling(tracks: DataFrame, bin_size: int) -> DataFrame:
    """Factors and clip thresholds for tracks with a ``library_size`` column, one row per track."""
    return scaling.clip_thresholds(scaling.scale_factors(tracks, bin_size))


def tmm_scaling(
    examples: DataFrame, factors: DataFrame, n_bins: int, bin_size: int, **options: float | str
) -> DataFrame:
    """Divide the factors by TMM factors estimated from the examples' region means."""
    for column in ("library_size", "scale_factor"):
        if column not in factors.columns:
            raise ValueError(f"column {column!r} missing from the scale-factor table")
    means = example_means(examples).withColumnRenamed("track", "track_index")
    return tmm_from_means(means, factors, n_bins * bin_size / 1000.0, **options)


def tmm_from_means(
    means: DataFrame, factors: DataFrame, region_length_kb: float, **options: float | str
) -> DataFrame:
    """As :func:`tmm_scaling` with the region means at hand; their tracks must be those of the factors."""
    seen = means.groupBy("track_index").agg(F.lit(True).alias("__seen"))
    both = F.col("__seen").isNotNull() & F.col("library_size").isNotNull()
    # The check sits on the key, which no later step can do without.
    key = F.when(both, F.col("track_index").cast("int")).otherwise(
        F.raise_error(F.lit("track count mismatch")).cast("int")
    )
    libraries = factors.join(seen, "track_index", "full").select(key.alias("track_index"), "library_size")
    return scaling.apply_tmm(factors, scaling.tmm_factors(means, libraries, region_length_kb, **options))


def enrich_tracks(tracks: DataFrame, factors: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    return enrich(tracks, factors, fields)
