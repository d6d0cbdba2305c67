"""Read-time transform of examples: crop, reverse complement, signal transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genotiles.functions.arrays import draw
from genotiles.functions.tensors import label_kernel, sequence_kernel


def track_vectors(tracks: DataFrame) -> DataFrame:
    """One row: scale and clip values as arrays in track order."""
    ordered = F.array_sort(F.collect_list(F.struct("track_index", "scale_factor", "clip_soft", "clip_hard")))

    def vector(column: str) -> Column:
        return F.transform("__t", lambda t: t[column].cast("double")).alias(column)

    return tracks.agg(ordered.alias("__t")).select(*[vector(c) for c in ("scale_factor", "clip_soft", "clip_hard")])


def make_transform(
    vectors: DataFrame,
    *,
    shift_max_bins: int = 0,
    context_length: int,
    n_pred_bins: int,
    bin_size: int,
    center_crop: bool = False,
    enable_rc_aug: bool = False,
    rc_permutation: DataFrame | None = None,
    seed: int = 42,
    epoch: int = 0,
    key: str = "index",
    apply_scale: bool = True,
    apply_squash: bool = True,
    apply_clip: bool = True,
) -> Callable[[DataFrame], DataFrame]:
    """Function for ``DataFrame.transform``, the same on batch and streaming examples.

    ``vectors`` and ``rc_permutation`` are one-row tables (:func:`track_vectors`,
    ``permutation_array``), read once; they travel with the task, not in the plan. Crop, signal transform, flip and strand
    swap are one pass over a batch's buffers (``functions/tensors.py``). Random draws depend on (key, seed, epoch) only. The signal
    transform works track by track, so it is applied before the strand swap with the tracks' own
    vectors; that equals swapping first and permuting the vectors along.
    """
    row = vectors.first()
    swap = rc_permutation.first()["permutation"] if enable_rc_aug and rc_permutation is not None else None
    crops = shift_max_bins > 0
    on_labels = label_kernel(
        *(row[c] for c in ("scale_factor", "clip_soft", "clip_hard")), length=n_pred_bins if crops else None, mates=swap,
        apply_scale=apply_scale, apply_squash=apply_squash, apply_clip=apply_clip,
    )
    on_sequence = sequence_kernel(context_length if crops else None)

    def apply(examples: DataFrame) -> DataFrame:
        shift = F.lit(shift_max_bins if center_crop else 0)
        if crops and not center_crop:
            shift = F.pmod(draw(F.col(key), seed, epoch, "shift"), F.lit(2 * shift_max_bins + 1)).cast("int")
        flip = F.pmod(draw(F.col(key), seed, epoch, "flip"), F.lit(2)) == 0 if enable_rc_aug else F.lit(False)
        return examples.withColumns({
            "input_ids": on_sequence(F.col("input_ids"), shift * bin_size, flip),
            "labels": on_labels(F.col("labels"), shift, flip),
        })

    return apply
