"""Prediction verb: windows, sequence, model, collapse, signal files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.operators import collapse, windows as W
from genotiles.operators.examples import CHUNK_BASES, fetch_sequence
from genotiles.operators.inference import Model, by_track, predict_windows
from genotiles.operators.regions import check_coordinates
from genotiles.operators.tracks import select_tracks
from genotiles.plans.build import Geometry
from genotiles.session import cut_lineage
from genotiles.sinks.tables import check_unique_names, write_signal

WINDOW_KEYS = ("chrom", "pred_start", "pred_end", "ctx_start", "ctx_end")


def predict(
    windows: DataFrame,
    chunks: DataFrame,
    geometry: Geometry,
    load_model: Callable[[], Model],
    *,
    key: Sequence[str] = WINDOW_KEYS,
    tracks: Sequence[int] | None = None,
    batch_size: int = 4,
    inverse_squash: bool = False,
    on_error: str = "raise",
    include_input: bool = False,
    chunk_bases: int = CHUNK_BASES,
) -> DataFrame:
    """``(chrom, pred_start, pred_end, ctx_start, ctx_end, len, values)`` for windows with ``len``.

    The shuffle that gathers the sequence also spreads the windows over the tasks that run the model.
    """
    placed = (
        windows.withColumn("read_start", F.greatest(F.col("ctx_start"), F.lit(0)))
        .withColumn("read_end", F.greatest(F.least(F.col("ctx_end"), F.col("len")), F.col("read_start")))
        .withColumn("left_pad", F.col("read_start") - F.col("ctx_start"))
    )
    keys = [*key, *[c for c in ("len",) if c not in key]]
    fetched = fetch_sequence(
        placed.select("chrom", "read_start", "read_end", "left_pad", *[k for k in keys if k != "chrom"]),
        chunks, geometry.context_length, key=keys, chunk=chunk_bases,
    )
    return predict_windows(
        fetched, load_model, batch_size=batch_size, tracks=tracks, inverse_squash=inverse_squash,
        on_error=on_error, include_input=include_input,
    )


def predict_regions(
    regions: DataFrame,
    contigs: DataFrame,
    chunks: DataFrame,
    geometry: Geometry,
    load_model: Callable[[], Model],
    **options: object,
) -> DataFrame:
    """Predict the window centred on each region; regions may overlap. Coordinates are checked."""
    checked = check_coordinates(regions, contigs)
    windows = W.targeted_windows(
        checked, contigs, geometry.n_pred_bins, geometry.bin_size, geometry.context_length
    ).withColumnsRenamed({"start_pos": "query_start", "end_pos": "query_end"})
    key = ("index", "query_start", "query_end", *WINDOW_KEYS)
    return predict(windows, chunks, geometry, load_model, key=key, **options)


def predict_signal(
    contigs: DataFrame,
    chunks: DataFrame,
    geometry: Geometry,
    load_model: Callable[[], Model],
    tracks: DataFrame,
    *,
    regions: DataFrame | None = None,
    whole_genome: bool = False,
    wanted: Sequence[str] | None = None,
    rtol: float = 0.01,
    folder: str | None = None,
    **options: object,
) -> DataFrame:
    """Collapsed intervals ``(chrom, start_pos, end_pos, track, value, track_name)``; written if asked.

    ``tracks(track_index, track_name)`` names the model's outputs.
    """
    windows = W.prediction_windows(
        contigs, geometry.n_pred_bins, geometry.bin_size, geometry.context_length,
        regions=regions, whole_genome=whole_genome,
    )
    if windows.isEmpty():
        raise ValueError("no prediction windows: empty regions or contig list")
    if regions is not None:
        W.check_disjoint(windows, geometry.n_pred_bins * geometry.bin_size)
    chosen = select_tracks(tracks, wanted)
    numbers = None
    if wanted:
        # The request is an option of the caller; its resolved indices go to the model tasks.
        numbers = [row["track_index"] for row in chosen.orderBy("request").select("track_index").collect()]
    predicted = predict(windows, chunks, geometry, load_model, tracks=numbers, **options)
    intervals = collapse.collapse(by_track(predicted, numbers), geometry.bin_size, rtol)
    names = chosen.select(F.col("track_index").alias("track"), "track_name")
    named = intervals.join(names, "track", "left").withColumn(
        "track_name",
        F.when(F.col("track_name").isNotNull(), F.col("track_name"))
        .otherwise(F.raise_error(F.concat(F.lit("no name for model output "), F.col("track").cast("string")))),
    )
    if folder is not None:
        check_unique_names(chosen)
        # Written and returned from one run of the model.
        named = cut_lineage(named)
        write_signal(named, contigs, folder)
    return named
