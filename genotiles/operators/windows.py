"""Prediction windows: targeted, tiled, checked for overlap; long-form records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genotiles.functions.numeric import whole_div
from genotiles.operators.regions import centre


def _with_bounds(rows: DataFrame, pred_start: Column, middle: Column, pred_bp: int, context_length: int) -> DataFrame:
    return (
        rows.withColumn("pred_start", pred_start.cast("bigint"))
        .withColumn("pred_end", F.col("pred_start") + pred_bp)
        .withColumn("ctx_start", (middle - context_length // 2).cast("bigint"))
        .withColumn("ctx_end", F.col("ctx_start") + context_length)
    )


def targeted_windows(
    regions: DataFrame, contigs: DataFrame, n_pred_bins: int, bin_size: int, context_length: int
) -> DataFrame:
    """One window centred on each region; a region on an unknown chromosome fails the query."""
    pred_bp = n_pred_bins * bin_size
    known = contigs.select("chrom", "chrom_rank", "len")
    located = regions.join(known, "chrom", "left").withColumn(
        "len",
        F.when(F.col("len").isNotNull(), F.col("len")).otherwise(
            F.raise_error(F.concat(F.lit("chromosome not in chrom sizes: "), F.col("chrom"))).cast("bigint")
        ),
    )
    return _with_bounds(located, centre() - pred_bp // 2, centre(), pred_bp, context_length)


def tiled_windows(contigs: DataFrame, n_pred_bins: int, bin_size: int, context_length: int) -> DataFrame:
    """Windows that tile every contig from 0; the last one may hang over the end."""
    pred_bp = n_pred_bins * bin_size
    starts = contigs.where(F.col("len") > 0).withColumn(
        "__start",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1, F.lit(pred_bp).cast("bigint"))),
    )
    middle = F.col("__start") + pred_bp // 2
    return _with_bounds(starts, F.col("__start"), middle, pred_bp, context_length).drop("__start")


def prediction_windows(
    contigs: DataFrame,
    n_pred_bins: int,
    bin_size: int,
    context_length: int,
    *,
    regions: DataFrame | None = None,
    whole_genome: bool = False,
) -> DataFrame:
    """Exactly one of ``regions`` and ``whole_genome``; windows carry ``chrom_rank`` for ordering."""
    if (regions is None) == (not whole_genome):
        raise ValueError("give exactly one of regions and whole_genome=True")
    if regions is None:
        return tiled_windows(contigs, n_pred_bins, bin_size, context_length)
    return targeted_windows(regions, contigs, n_pred_bins, bin_size, context_length)


def in_genome_order(windows: DataFrame) -> DataFrame:
    return windows.orderBy("chrom_rank", "pred_start")


def overlapping_neighbours(windows: DataFrame, pred_bp: int) -> DataFrame:
    """Neighbouring windows on a chromosome that overlap: ``(chrom, prev_start, pred_start, n_pairs)``.

    Windows are equally wide, so a neighbour that overlaps starts in the same or in the previous slot
    of ``pred_bp`` bases. Equal starts are counted before the shuffle; a slot then holds at most
    ``pred_bp`` distinct starts however many windows fall into it.
    """
    starts = (
        windows.groupBy("chrom", "pred_start").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__slot", whole_div(F.col("pred_start"), pred_bp))
    )
    inside = Window.partitionBy("chrom", "__slot").orderBy("pred_start")
    last_of_slot = starts.groupBy("chrom", (F.col("__slot") + 1).alias("__slot")).agg(
        F.max("pred_start").alias("__carried")
    )
    previous = (
        starts.withColumn("__lag", F.lag("pred_start").over(inside))
        .join(last_of_slot, ["chrom", "__slot"], "left")
        .withColumn("prev_start", F.coalesce("__lag", "__carried"))
    )
    pairs = F.array(
        F.struct(F.col("prev_start").alias("prev"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.col("pred_start").alias("prev"), (F.col("n") - 1).alias("n")),
    )
    return (
        previous.withColumn("__pair", F.explode(pairs))
        .where(
            F.col("__pair.prev").isNotNull()
            & (F.col("__pair.n") > 0)
            & (F.col("pred_start") - F.col("__pair.prev") < pred_bp)
        )
        .select("chrom", F.col("__pair.prev").alias("prev_start"), "pred_start", F.col("__pair.n").alias("n_pairs"))
    )


def check_disjoint(windows: DataFrame, pred_bp: int) -> None:
    """Raise when two windows overlap (a signal file may not hold overlapping intervals)."""
    found = overlapping_neighbours(windows, pred_bp).take(1)
    if found:
        row = found[0]
        raise ValueError(
            f"overlapping prediction windows on {row['chrom']}: they start at {row['prev_start']} "
            f"and {row['pred_start']} and are {pred_bp} bp wide"
        )


def long_records(predictions: DataFrame, bin_size: int) -> DataFrame:
    """``(chrom, start_pos, end_pos, track, value)``, one row per track and bin of ``values``."""
    tracks = predictions.select("chrom", "pred_start", F.posexplode("values").alias("track", "__row"))
    cells = tracks.select("chrom", "pred_start", "track", F.posexplode("__row").alias("bin", "value"))
    start = F.col("pred_start") + F.col("bin") * F.lit(bin_size)
    return cells.select(
        "chrom", start.alias("start_pos"), (start + bin_size).alias("end_pos"), "track", "value"
    )
