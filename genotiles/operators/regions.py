"""Labelled regions: windows around them, split membership, order and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genotiles.functions.numeric import floor_half
from genotiles.operators.ordering import number_rows


def centre() -> Column:
    return floor_half(F.col("start_pos") + F.col("end_pos"))


def with_signal_window(
    regions: DataFrame, n_pred_bins: int, bin_size: int, *, shift_max_bp: int = 0, clamp: bool = True
) -> DataFrame:
    """Add ``sig_start`` and ``sig_end``: the label window centred on the region.

    With ``clamp`` a window that would start before 0 starts at 0 and keeps its width.
    """
    if shift_max_bp % bin_size:
        raise ValueError(f"shift_max_bp {shift_max_bp} is no multiple of bin_size {bin_size}")
    width = n_pred_bins * bin_size
    start = centre() - width // 2 - shift_max_bp
    if clamp:
        start = F.greatest(start, F.lit(0))
    return regions.withColumn("sig_start", start.cast("bigint")).withColumn(
        "sig_end", F.col("sig_start") + width + 2 * shift_max_bp
    )


def with_context_window(regions: DataFrame, contigs: DataFrame, context_length: int) -> DataFrame:
    """Add the sequence window: its bounds, the part inside the contig, and the padding left of it."""
    start = centre() - context_length // 2
    return (
        with_contig_length(regions, contigs)
        .withColumn("ctx_start", start.cast("bigint"))
        .withColumn("ctx_end", F.col("ctx_start") + context_length)
        .withColumn("read_start", F.greatest(F.col("ctx_start"), F.lit(0)))
        .withColumn(
            "read_end",
            F.greatest(F.least(F.col("ctx_end"), F.col("len")), F.col("read_start")),
        )
        .withColumn("left_pad", F.col("read_start") - F.col("ctx_start"))
    )


def with_contig_length(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Add ``len``; 0 for a contig that is not known."""
    known = contigs.select("chrom", F.col("len").alias("__len"))
    return (
        regions.join(known, "chrom", "left")
        .withColumn("len", F.coalesce("__len", F.lit(0)))
        .drop("__len")
    )


def interval_label() -> Column:
    return F.concat(
        F.col("chrom"), F.lit(":"), F.col("start_pos").cast("string"),
        F.lit("-"), F.col("end_pos").cast("string"),
    )


def parse_splits(specs: Sequence[str], defaults: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Read ``NAME:FOLD1,FOLD2`` options; none given means the defaults."""
    splits: dict[str, list[str]] = {}
    for spec in specs:
        name, colon, folds = spec.partition(":")
        if not colon:
            raise ValueError(f"split {spec!r} is not of the form NAME:FOLD1,FOLD2")
        splits[name] = [fold.strip() for fold in folds.split(",") if fold.strip()]
    return splits or {name: list(folds) for name, folds in defaults.items()}


def assign_splits(regions: DataFrame, splits: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (split, region). No folds means all regions; a region may be in several splits.

    Membership is a column expression over the options, so it needs no join and no shuffle.
    """
    member_of = F.filter(
        F.array(*[F.when(_in_split(folds), F.lit(name)) for name, folds in splits.items()]),
        lambda name: name.isNotNull(),
    )
    return regions.withColumn("split", F.explode(member_of))


def _in_split(folds: Sequence[str]) -> Column:
    return F.col("fold").isin(list(folds)) if folds else F.lit(True)


def in_any_split(regions: DataFrame, splits: Mapping[str, Sequence[str]]) -> DataFrame:
    """Regions that some split uses."""
    return regions.where(reduce(lambda a, b: a | b, [_in_split(folds) for folds in splits.values()]))


def keep_chroms(regions: DataFrame, chroms: Sequence[str] | None) -> DataFrame:
    """Restrict to some chromosomes; ``index`` stays as it is."""
    return regions.where(F.col("chrom").isin(list(chroms))) if chroms else regions


def with_local_index(members: DataFrame) -> DataFrame:
    """Add ``local_index``: 0-based position within the split in file order."""
    return number_rows(members, "index", group=["split"], out="local_index")


def buildable(regions: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """Regions on contigs that hold at least one whole bin. Others have no grid to read from."""
    usable = contigs.where(F.col("len") >= bin_size).select("chrom")
    return regions.join(usable, "chrom", "left_semi")


def used_chroms(members: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """Chromosomes that any split needs, with their length, longest first."""
    used = members.select("chrom").distinct()
    usable = contigs.where(F.col("len") >= bin_size).select("chrom", "len")
    return usable.join(used, "chrom", "left_semi").orderBy(F.desc("len"), "chrom")


def chrom_major(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Longest chromosome first, names ascending among equals, file order inside."""
    return with_contig_length(rows, contigs).orderBy(F.desc("len"), "chrom", "index")


def shard_counts(members: DataFrame, contigs: DataFrame, bin_size: int, rows_per_shard: int) -> DataFrame:
    """Rows and shards per split and chromosome."""
    return (
        buildable(members, contigs, bin_size)
        .groupBy("split", "chrom")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("n_shards", F.ceil(F.col("n_rows") / F.lit(rows_per_shard)).cast("bigint"))
    )


def invalid_coordinates(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows that violate ``0 <= start <= end`` or name an unknown chromosome, with the reason."""
    known = contigs.select("chrom", F.lit(True).alias("__known"))
    reason = F.when(F.col("__known").isNull(), "unknown chromosome").when(
        (F.col("start_pos") < 0) | (F.col("end_pos") < F.col("start_pos")),
        "coordinates must satisfy 0 <= start <= end",
    )
    return (
        regions.join(known, "chrom", "left").withColumn("reason", reason)
        .where(F.col("reason").isNotNull()).drop("__known")
    )


def check_coordinates(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """The same regions; the query fails when one of them is invalid."""
    known = contigs.select("chrom", F.lit(True).alias("__known"))
    described = F.concat_ws(" ", F.lit("invalid region"), interval_label())
    valid = (
        F.col("__known").isNotNull()
        & (F.col("start_pos") >= 0)
        & (F.col("end_pos") >= F.col("start_pos"))
    )
    return (
        regions.join(known, "chrom", "left")
        .withColumn("start_pos", F.when(valid, F.col("start_pos")).otherwise(
            F.raise_error(described).cast("bigint")))
        .drop("__known")
    )
