"""Tracks from paths: what a build does before it reads a single value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.operators import tracks as T
from genotiles.session import cut_lineage
from genotiles.sources.tracks import content_identities, identify, list_paths, requested_tracks, tracks_in_folder


@dataclass(frozen=True)
class ResolvedTracks:
    """Final tracks (``track_index``, ``track``, ``path``, ``is_minus``, …), and what is not among them."""

    final: DataFrame
    dropped: DataFrame
    missing: DataFrame
    counters: DataFrame


def resolve_tracks(
    spark: SparkSession,
    paths: Sequence[str] | None = None,
    *,
    folder: str | None = None,
    glob: str = "*.bw",
    dedupe: str = "content",
    drop_missing: bool = False,
) -> ResolvedTracks:
    """Requested files, or those of a folder, without missing ones and copies.

    A missing path is an error unless ``drop_missing``. Content is read only of files whose size another
    surviving file has, and beyond the first block only where that is equal too.
    """
    if (paths is None) == (folder is None):
        raise ValueError("give track paths or a folder")
    if folder is not None:
        requested = tracks_in_folder(spark, folder, glob).select("source_index", "path")
    else:
        requested = requested_tracks(spark, paths)
    listing = list_paths(spark, requested)
    missing = T.missing_tracks(requested, listing)
    existing = cut_lineage(identify(T.existing_tracks(requested, listing, drop_missing=drop_missing)))
    nothing = existing.withColumn("content_hash", F.lit(None).cast("string"))
    if dedupe == "content":
        survivors = T.dedupe_map(nothing, "identity").where("source_index = canonical")
        alike = survivors.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        hashes = cut_lineage(content_identities(survivors.join(alike, "size").select("path", "size")))
        nothing = existing.join(hashes, "path", "left")
    mapped = cut_lineage(T.dedupe_map(nothing, dedupe))
    final = T.with_minus_flag(T.final_tracks(mapped, dedupe)).withColumn("track", F.col("track_index"))
    counters = T.dedupe_counters(mapped, missing.agg(F.count(F.lit(1))).scalar())
    return ResolvedTracks(final, T.dropped_tracks(mapped, final), missing, counters)
