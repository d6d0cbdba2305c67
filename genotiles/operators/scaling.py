"""Library-size scale factors, clip thresholds and TMM normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genotiles.operators.ordering import quantiles, quantiles_of
from genotiles.session import cut_lineage

# Clip thresholds in reads per million, and the guards of the TMM estimate.
SOFT_READS_PER_MILLION = 7.0
HARD_READS_PER_MILLION = 16.0
MIN_PAIRED_REGIONS = 10
MIN_KEPT_REGIONS = 5
MIN_WEIGHT = 1e-10

LOG_DIGITS = 12


def scale_factors(tracks: DataFrame, bin_size: int) -> DataFrame:
    """Factor from stored signal to raw counts per bin: ``library_size / 1e9 * bin_size``.

    A track whose library size is not known gets factor 1 (times the bin size) and library size 0.
    """
    per_base = F.coalesce(F.col("library_size") / 1e9, F.lit(1.0))
    return tracks.withColumn("scale_factor", per_base * bin_size).withColumn(
        "library_size", F.coalesce(F.col("library_size").cast("double"), F.lit(0.0))
    )


def clip_thresholds(
    tracks: DataFrame,
    soft_reads_per_million: float = SOFT_READS_PER_MILLION,
    hard_reads_per_million: float = HARD_READS_PER_MILLION,
) -> DataFrame:
    """Add ``clip_soft`` and ``clip_hard``, one decimal, halves to even."""
    scaled = lambda rate: F.bround(F.lit(rate) * F.col("library_size") / 1e6, 1)
    return tracks.withColumns(
        {"clip_soft": scaled(soft_reads_per_million), "clip_hard": scaled(hard_reads_per_million)}
    )


def join_on_path(factors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Give each factor row its ``track_index`` by path; a path kept twice matches its first track."""
    by_path = tracks.groupBy(F.col("resolved_path").alias("path")).agg(F.min("track_index").alias("track_index"))
    return factors.join(by_path, "path", "left")


def pseudo_counts(region_means: DataFrame, libraries: DataFrame, region_length_kb: float) -> DataFrame:
    """``(index, track_index, lib, n)`` with ``n = mean * kb * lib / 1e6``."""
    lib = libraries.select("track_index", F.col("library_size").cast("double").alias("lib"))
    per_mean = F.lit(float(region_length_kb)) * F.col("lib") / 1e6
    return region_means.join(lib, "track_index").select(
        "index", "track_index", "lib", (F.col("mean").cast("double") * per_mean).alias("n")
    )


def reference_track(counts: DataFrame) -> DataFrame:
    """One row: the track whose upper quartile is closest to the mean upper quartile, first on ties."""
    quartiles = quantiles(counts, ["track_index"], "n", {"uq75": 0.75})
    # One row per track.
    centre = F.avg("uq75").over(Window.partitionBy())
    centred = quartiles.select("track_index", F.abs(F.col("uq75") - centre).alias("distance"))
    return centred.agg(F.min_by("track_index", F.struct("distance", "track_index")).alias("track_index"))


def tmm_factors(
    region_means: DataFrame,
    libraries: DataFrame,
    region_length_kb: float,
    *,
    trim_m: float = 0.3,
    trim_a: float = 0.05,
    min_count: float = 1.0,
    weights: str = "variance",
) -> DataFrame:
    """``(track_index, tmm_factor)`` with geometric mean 1.

    Per track against the reference track: log ratios M and mean logs A over regions where both have
    ``min_count``; both tails of M and A are cut at their quantiles (inclusive); the factor is 2 to the
    weighted mean of the M that are left. The default weight of a region is the variance expression of
    a binomial model; ``weights='inverse'`` uses its reciprocal. A track without enough regions has
    factor 1 before normalisation.
    """
    if weights not in ("variance", "inverse"):
        raise ValueError("weights must be 'variance' or 'inverse'")
    # Read several times below: written once as narrow rows instead of being computed again.
    counts = cut_lineage(pseudo_counts(region_means, libraries, region_length_kb))
    chosen = reference_track(counts).scalar()
    reference = counts.where((F.col("track_index") == chosen) & (F.col("n") >= min_count)).select(
        "index", F.col("n").alias("n_ref"), F.col("lib").alias("lib_ref")
    )
    share, share_ref = F.log2(F.col("n") / F.col("lib")), F.log2(F.col("n_ref") / F.col("lib_ref"))
    pairs = cut_lineage(
        counts.where((F.col("track_index") != chosen) & (F.col("n") >= min_count) & (F.col("lib") > 0))
        .join(reference, "index")
        # The JVM log2 is off by a bit or two: without rounding, equal ratios at a cut fall on both sides.
        .withColumn("m", F.round(share - share_ref, LOG_DIGITS))
        .withColumn("a", F.round(0.5 * (share + share_ref), LOG_DIGITS))
    )
    cuts = quantiles_of(pairs, ["track_index"], {
        "m_lo": ("m", trim_m), "m_hi": ("m", 1.0 - trim_m), "a_lo": ("a", trim_a), "a_hi": ("a", 1.0 - trim_a),
    })
    spread = lambda n, lib: (F.col(lib) - F.col(n)) / (F.col(lib) * F.col(n))
    weight = F.greatest(spread("n", "lib") + spread("n_ref", "lib_ref"), F.lit(MIN_WEIGHT))
    if weights == "inverse":
        weight = 1.0 / weight
    kept = F.col("m").between(F.col("m_lo"), F.col("m_hi")) & F.col("a").between(F.col("a_lo"), F.col("a_hi"))
    per_track = (
        pairs.join(cuts, "track_index")
        .withColumn("w", F.when(kept, weight))
        .groupBy("track_index")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"), F.count("w").alias("n_kept"),
            (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("log_ratio"),
        )
    )
    enough = (F.col("n_pairs") >= MIN_PAIRED_REGIONS) & (F.col("n_kept") >= MIN_KEPT_REGIONS)
    raw = libraries.select("track_index").join(per_track, "track_index", "left").select(
        "track_index", F.when(enough, F.col("log_ratio")).otherwise(0.0).alias("log_factor")
    )
    # Dividing by the geometric mean is subtracting the mean of the logs, over one row per track.
    level = F.avg("log_factor").over(Window.partitionBy())
    return raw.select("track_index", F.pow(F.lit(2.0), F.col("log_factor") - level).alias("tmm_factor"))


def apply_tmm(factors: DataFrame, tmm: DataFrame) -> DataFrame:
    """Add ``tmm_factor`` and divide ``scale_factor`` by it; the track sets must be the same."""
    joined = factors.join(tmm.withColumn("__known", F.lit(True)), "track_index", "full")
    mismatch: Column = F.col("__known").isNull() | F.col("scale_factor").isNull()
    checked = F.when(mismatch, F.raise_error(F.lit("track count mismatch")).cast("double")).otherwise(
        F.col("scale_factor") / F.col("tmm_factor")
    )
    return joined.withColumn("scale_factor", checked).drop("__known")
