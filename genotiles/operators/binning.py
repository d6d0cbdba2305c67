"""Value intervals to bins: coverage-weighted means over a chromosome grid or over each region.

The range join "interval overlaps bin" is written as an equi-join key: every interval is cut at the borders of the
tiles it touches, by integer division. Within a tile, sums come from profiles (``operators/profiles.py``), combined
map-side before the shuffle, so no row per (interval, bin) or (region, interval) is made. Only the policy that a later
interval wins looks at such pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genotiles.operators.profiles import binned_tiles, dense_tiles, profiles, region_sums, tile_pieces
from genotiles.session import cut_lineage

# Bins of regions, covered or not, that one task sums per track, about.
TASK_BINS = 1 << 19

# Bins per tile. A tile is the unit in which the grid is stored and joined.
TILE_BINS = 1024


def in_range(signal: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Intervals that overlap ``[start, end)``; plain comparisons, so they reach the scan."""
    return signal.where(
        (F.col("chrom") == chrom) & (F.col("start_pos") < end) & (F.col("end_pos") > start)
    )


def _overlapping(start: Column, end: Column) -> Column:
    return ~F.isnan("value") & F.col("value").isNotNull() & (start < end)


def grid_overlaps(
    signal: DataFrame, contigs: DataFrame, bin_size: int, tile_bins: int = TILE_BINS, keep: Sequence[Column] = ()
) -> DataFrame:
    """One row per (interval, grid bin) that overlap, with the overlap in bases and the columns of ``keep``.

    The grid of a contig has ``len div bin_size`` bins; the last partial bin is not part of it.
    """
    grid = contigs.select(
        "chrom", (F.expr(f"len div {bin_size}") * bin_size).alias("__grid_end")
    ).where(F.col("__grid_end") > 0)
    clipped = (
        signal.join(grid, "chrom")
        .withColumn("__lo", F.greatest(F.col("start_pos"), F.lit(0)))
        .withColumn("__hi", F.least(F.col("end_pos"), F.col("__grid_end")))
        .where(_overlapping(F.col("__lo"), F.col("__hi")))
        .withColumn("__first", F.expr(f"__lo div {bin_size}"))
        .withColumn("__last", F.expr(f"(__hi - 1) div {bin_size}"))
    )
    tiled = clipped.withColumn(
        "tile", F.explode(F.expr(f"sequence(__first div {tile_bins}, __last div {tile_bins})"))
    )
    binned = tiled.withColumn(
        "bin",
        F.explode(F.expr(
            f"sequence(greatest(__first, tile * {tile_bins}), "
            f"least(__last, tile * {tile_bins} + {tile_bins - 1}))"
        )),
    )
    overlap = F.least(F.col("__hi"), (F.col("bin") + 1) * bin_size) - F.greatest(
        F.col("__lo"), F.col("bin") * bin_size
    )
    return binned.select(
        "chrom", "track", "tile", "bin", "start_pos", "end_pos",
        F.col("value").cast("double").alias("value"), overlap.alias("overlap"), *keep,
    )


def covered_mean(value: str = "value", overlap: str = "overlap") -> Column:
    """Aggregate: mean over covered bases. A zero-valued interval covers, a gap does not."""
    return F.sum(F.col(value) * F.col(overlap)) / F.sum(overlap)


def _grid_profiles(signal: DataFrame, contigs: DataFrame, bin_size: int, tile_bins: int) -> DataFrame:
    """Profiles of the signal on the grid; a contig's grid has ``len div bin_size`` bins."""
    grid = contigs.select("chrom", (F.expr(f"len div {bin_size}") * bin_size).alias("__grid_end")).where("__grid_end > 0")
    span = bin_size * tile_bins
    pieces = tile_pieces(signal.join(grid, "chrom"), span, low=F.lit(0), high=F.col("__grid_end"))
    return profiles(pieces, span)


def grid_rows(signal: DataFrame, contigs: DataFrame, bin_size: int, tile_bins: int = TILE_BINS) -> DataFrame:
    """Sparse grid, a row per (chrom, tile, track): arrays ``bins, means, covered``, counts ``negative, nonzero``."""
    return binned_tiles(_grid_profiles(signal, contigs, bin_size, tile_bins), bin_size, tile_bins)


def grid_tiles(
    signal: DataFrame, contigs: DataFrame, n_tracks: Column, bin_size: int, tile_bins: int = TILE_BINS
) -> DataFrame:
    """Dense grid: a matrix ``vals [T][tile_bins]`` per (chrom, tile), with counts ``negative [T], nonzero [T]``.

    ``signal.track`` is the dense track index. The signal is scanned and shuffled once, as profiles.
    """
    return dense_tiles(_grid_profiles(signal, contigs, bin_size, tile_bins), n_tracks, bin_size, tile_bins)


def bins_of(rows: DataFrame, *more: str) -> DataFrame:
    """Long bins ``(chrom, track, tile, bin, mean)`` of grid rows, with columns of ``more`` (such as covered)."""
    cells = rows.select("chrom", "track", "tile", F.inline(F.arrays_zip("bins", "means", "covered")))
    return cells.select("chrom", "track", "tile", F.col("bins").alias("bin"), F.col("means").alias("mean"), *more)


def signal_bins(signal: DataFrame, contigs: DataFrame, bin_size: int, tile_bins: int = TILE_BINS) -> DataFrame:
    """Sparse grid: ``(chrom, track, tile, bin, mean)`` for every bin with covered bases."""
    return bins_of(grid_rows(signal, contigs, bin_size, tile_bins))


def last_wins_bins(
    signal: DataFrame, contigs: DataFrame, bin_size: int, order: str = "start_pos"
) -> DataFrame:
    """Grid means under the policy that a later interval overwrites earlier ones base by base.

    Equal to :func:`signal_bins` where the intervals of a track do not overlap. "Later" is a larger
    ``order``. A bin is cut where an interval starts or ends in it; the latest interval of each piece gives
    its value, the piece's length its weight. A bin has at most ``bin_size`` pieces, and one if a
    single interval covers it, so a long interval costs a row per bin and none per base.
    """
    keys = ["chrom", "track", "bin"]
    parts = grid_overlaps(signal, contigs, bin_size, keep=[F.col(order).alias("__order")]).withColumn(
        "__lo", F.greatest("start_pos", F.col("bin") * bin_size)
    ).select(*keys, "__lo", (F.col("__lo") + F.col("overlap")).alias("__hi"), "value", "__order")
    edges = parts.select(*keys, F.explode(F.array("__lo", "__hi")).alias("__at")).distinct()
    in_bin = Window.partitionBy(*keys).orderBy("__at")
    pieces = edges.withColumn("__to", F.lead("__at").over(in_bin)).where("__to IS NOT NULL")
    latest = (
        parts.join(pieces, keys).where("__at >= __lo AND __to <= __hi")
        .groupBy(*keys, "__at", "__to").agg(F.max_by("value", "__order").alias("value"))
    )
    return latest.withColumn("overlap", F.col("__to") - F.col("__at")).groupBy(*keys).agg(covered_mean().alias("mean"))


def region_tasks(regions: DataFrame, n_bins: int) -> int:
    """Tasks for the bins of all regions: about ``TASK_BINS`` per track each, and one per core at least."""
    return max(regions.sparkSession.sparkContext.defaultParallelism, -(-regions.count() * n_bins // TASK_BINS))


def exact_bins(regions: DataFrame, signal: DataFrame, n_bins: int, bucket_bp: int) -> DataFrame:
    """``(index, track, bin, mean)`` with bins that start exactly at each region's ``sig_start``.

    Sums of a bin that lies in two buckets come from both. Rows are placed by (index, track), so that what
    looks at a region's bins together, such as the sign, finds them together. More regions make more tasks, not larger
    ones: bins compress so well that their bytes in a shuffle say little about what a task holds.
    """
    tasks = region_tasks(regions, n_bins)
    cells = region_sums(regions, signal, n_bins, bucket_bp, tasks).select(
        "index", "track", F.inline(F.arrays_zip("bins", "totals", "covered"))
    )
    return (
        cells.repartition(tasks, "index", "track").groupBy("index", "track", F.col("bins").alias("bin"))
        .agg((F.sum("totals") / F.sum("covered")).alias("mean"))
    )


def _mostly_negative(negative: Column, nonzero: Column) -> Column:
    """At least 80 % of the non-zero bins are negative; this makes the median negative as well."""
    return (nonzero > 0) & (5 * negative >= 4 * nonzero)


def _is_one_of(tracks: DataFrame) -> Column:
    """Whether the row's track is among tracks: metadata, as many values as tracks."""
    return F.array_contains(tracks.agg(F.collect_set("track")).scalar(), F.col("track"))


def fix_minus_sign(bins: DataFrame, minus_tracks: DataFrame, scope: Sequence[str] = ("chrom", "track")) -> DataFrame:
    """Negate a minus-strand track where at least 80 % of its non-zero long bins are negative.

    ``scope`` says over which bins the share is taken: ``(index, track)`` per region, which looks at a region's bins
    together; ``(chrom, track)`` or ``(track,)`` for long bins from elsewhere, which are aggregated and joined back. A
    grid has its counts with its tiles: see :func:`fix_minus_rows`.
    """
    scope = list(scope)
    negative, nonzero = F.col("mean") < 0, F.col("mean") != 0
    if "index" in scope:
        of_region = Window.partitionBy(*scope)
        turned = _is_one_of(minus_tracks) & _mostly_negative(
            F.count_if(negative).over(of_region), F.count_if(nonzero).over(of_region)
        )
        return bins.withColumn("__flip", turned).withColumn("mean", F.when(F.col("__flip"), -F.col("mean")).otherwise(F.col("mean"))).drop("__flip")
    counted = bins.where(_is_one_of(minus_tracks)).groupBy(*scope).agg(
        F.count_if(negative).alias("negative"), F.count_if(nonzero).alias("nonzero")
    )
    return (
        bins.join(_flips(counted, scope), scope, "left")
        .withColumn("mean", F.when(F.col("__flip"), -F.col("mean")).otherwise(F.col("mean")))
        .drop("__flip")
    )


def _flips(counted: DataFrame, scope: list[str]) -> DataFrame:
    return counted.where(_mostly_negative(F.col("negative"), F.col("nonzero"))).select(*scope, F.lit(True).alias("__flip"))


def fix_minus_rows(rows: DataFrame, minus_tracks: DataFrame, scope: Sequence[str] = ("chrom", "track")) -> DataFrame:
    """Grid rows with the means of mostly negative minus-strand tracks negated.

    The rows are written once; the counts beside them are summed per scope, a column or two of a small part of them,
    and the few scopes to negate are joined to tiles, not to bins.
    """
    scope = list(scope)
    rows = cut_lineage(rows)
    counted = rows.where(_is_one_of(minus_tracks)).groupBy(*scope).agg(
        F.sum("negative").alias("negative"), F.sum("nonzero").alias("nonzero")
    )
    means = F.when(F.col("__flip"), F.transform("means", lambda x: -x)).otherwise(F.col("means"))
    return rows.join(_flips(counted, scope), scope, "left").withColumn("means", means).drop("__flip")


def flipped_tracks(tiles: DataFrame, minus_tracks: DataFrame) -> DataFrame:
    """``(chrom, flipped)``: dense tracks of each chromosome to negate, from the counts beside dense tiles."""
    signs = tiles.select("chrom", F.posexplode(F.arrays_zip("negative", "nonzero")).alias("track", "of"))
    counted = signs.where(_is_one_of(minus_tracks)).groupBy("chrom", "track").agg(
        F.sum("of.negative").alias("negative"), F.sum("of.nonzero").alias("nonzero")
    )
    # One row per chromosome with at most all tracks.
    return _flips(counted, ["chrom", "track"]).groupBy("chrom").agg(F.collect_set("track").alias("flipped"))
