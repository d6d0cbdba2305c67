"""The track dimension: resolution, dedupe, names, selection, pairing, grouping, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genotiles.functions.names import is_minus_strand, strand_sign, track_stem
from genotiles.operators.ordering import null_safe_join, number_rows
from genotiles.schemas import DEFAULT_CLIP_HARD, DEFAULT_CLIP_SOFT, DEFAULT_SCALE_FACTOR

DEDUPE_MODES = ("none", "identity", "content")

# Fields that make a plus and a minus track a pair.
PAIRING_FIELDS = ("condition_id", "cell_line_id", "assay_type_id", "target_id")

# Fields that tell track groups apart, and fields that never do.
GROUPING_FIELDS = (
    "assay_type_id",
    "assay_type",
    "cell_line_id",
    "cell_line",
    "timepoint_minutes",
    "timepoint",
    "target_id",
    "target",
    "strand",
    "replicate",
    "experiment_series",
)
NON_GROUPING_FIELDS = (
    "condition",
    "condition_id",
    "track_index",
    "track_name",
    "name",
    "display_name",
    "scale_factor",
    "scale_factors",
    "clip_hard",
    "clip_soft",
)

# Metadata handed to a model, output name to record field.
MODEL_METADATA = {
    "track_condition_ids": "condition_id",
    "track_timepoint_minutes": "timepoint_minutes",
    "track_cell_line_ids": "cell_line_id",
    "track_assay_type_ids": "assay_type_id",
    "track_target_ids": "target_id",
}


def missing_tracks(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """Requested ``(source_index, path)`` rows that the file listing does not have."""
    return requested.join(listing.select("path"), "path", "left_anti").select("source_index", "path")


def existing_tracks(requested: DataFrame, listing: DataFrame, *, drop_missing: bool) -> DataFrame:
    """Requested rows with the listing's columns. Without ``drop_missing`` a missing path fails the query."""
    if drop_missing:
        return requested.join(listing, "path")
    found = requested.join(listing.withColumn("__found", F.lit(True)), "path", "left")
    checked = F.when(F.col("__found"), F.col("source_index")).otherwise(
        F.raise_error(F.concat(F.lit("track path does not exist: "), F.col("path"))).cast("bigint")
    )
    return found.withColumn("source_index", checked).drop("__found")


def dedupe_map(tracks: DataFrame, mode: str) -> DataFrame:
    """Each track with the first track it is a copy of.

    Input ``(source_index, identity_key, size, content_hash)``. Adds ``identity_source`` (first track
    with the same identity), ``canonical`` (first survivor with the same size and content, carried
    over to all tracks of that identity) and ``hashed`` (the content was compared, i.e. another
    survivor has the same size). Both steps are grouped minima joined back, not windows, so a key with
    very many copies is combined before it is shuffled.
    """
    if mode not in DEDUPE_MODES:
        raise ValueError(f"dedupe mode must be one of {', '.join(DEDUPE_MODES)}, got {mode!r}")
    if mode == "none":
        own = F.col("source_index")
        return tracks.withColumns({"identity_source": own, "canonical": own, "hashed": F.lit(False)})
    first = tracks.groupBy("identity_key").agg(F.min("source_index").alias("identity_source"))
    known = tracks.join(first, "identity_key")
    if mode == "identity":
        return known.withColumns({"canonical": F.col("identity_source"), "hashed": F.lit(False)})
    survivors = known.where(F.col("source_index") == F.col("identity_source"))
    same_size = survivors.where(F.col("size").isNotNull()).groupBy("size").agg(F.count(F.lit(1)).alias("__n"))
    copies = survivors.where(F.col("size").isNotNull()).groupBy("size", "content_hash").agg(
        F.min("source_index").alias("__first")
    )
    compared = (
        survivors.select(F.col("source_index").alias("identity_source"), "size", "content_hash")
        .join(same_size.where(F.col("__n") > 1), "size")
        .join(copies, ["size", "content_hash"])
        .select("identity_source", "__first")
    )
    return (
        known.join(compared, "identity_source", "left")
        .withColumn("canonical", F.coalesce("__first", "identity_source"))
        .withColumn("hashed", F.col("__first").isNotNull())
        .drop("__first")
    )


def _dedupe_key(from_content: Column) -> Column:
    return F.when(from_content, F.concat(F.lit("content:"), F.col("content_hash"))).otherwise(
        F.col("identity_key")
    )


def final_tracks(mapped: DataFrame, mode: str) -> DataFrame:
    """Surviving tracks, renumbered densely in request order."""
    kept = mapped.where(F.col("source_index") == F.col("canonical"))
    method = F.when(F.col("hashed"), "content").otherwise("none" if mode == "none" else "identity")
    return (
        number_rows(kept, "source_index", out="track_index")
        .withColumn("dedupe_method", method)
        .withColumn("dedupe_key", _dedupe_key(F.col("hashed")))
    )


def dropped_tracks(mapped: DataFrame, final: DataFrame) -> DataFrame:
    """Dropped copies with the track they duplicate and how that was found."""
    survivor = final.select(
        F.col("source_index").alias("duplicate_of_source_index"),
        F.col("track_index").alias("duplicate_of_track_index"),
    )
    by_identity = F.col("identity_source") != F.col("source_index")
    return (
        mapped.where(F.col("source_index") != F.col("canonical"))
        .withColumnRenamed("canonical", "duplicate_of_source_index")
        .withColumn("dedupe_method", F.when(by_identity, "identity").otherwise("content"))
        .withColumn("dedupe_key", _dedupe_key(~by_identity & F.col("hashed")))
        .join(survivor, "duplicate_of_source_index")
    )


def dedupe_counters(mapped: DataFrame, n_missing: Column | None = None) -> DataFrame:
    """One row of provenance counters."""
    dropped = F.col("source_index") != F.col("canonical")
    by_identity = F.col("identity_source") != F.col("source_index")
    survivor = ~by_identity
    missing = n_missing if n_missing is not None else F.lit(0).cast("bigint")
    counted = mapped.agg(
        F.count(F.lit(1)).alias("n_existing"),
        F.count_if(dropped).alias("n_dropped_duplicate_tracks"),
        F.count_if(by_identity).alias("n_identity_duplicates"),
        F.count_if(survivor & dropped).alias("n_content_duplicates"),
        F.count_if(survivor & F.col("hashed")).alias("n_hashed_files"),
        F.count_if(~dropped).alias("n_final_tracks"),
    )
    return counted.select(
        (F.col("n_existing") + missing).alias("n_requested_tracks"),
        missing.alias("n_missing_tracks"),
        "n_dropped_duplicate_tracks", "n_identity_duplicates", "n_content_duplicates",
        "n_hashed_files", "n_final_tracks",
    )


def with_minus_flag(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("is_minus", is_minus_strand(F.col("path")))


def with_track_names(tracks: DataFrame, paths: Sequence[str] = ("path", "resolved_path")) -> DataFrame:
    """Add ``track_name``: file-safe, repeats numbered ``_1``, ``_2`` in track order.

    ``paths`` are the columns to take the name from, first non-NULL first. A generated name is not
    compared with the other names.
    """
    source = F.coalesce(*[F.when(F.col(p) != "", F.col(p)) for p in paths if p in tracks.columns])
    named = tracks.withColumn("__stem", track_stem(source, F.col("track_index")))
    numbered = number_rows(named, "track_index", group=["__stem"], out="__copy")
    name = F.when(F.col("__copy") == 0, F.col("__stem")).otherwise(
        F.concat_ws("_", "__stem", F.col("__copy").cast("string"))
    )
    return numbered.withColumn("track_name", name).drop("__stem", "__copy")


def select_tracks(tracks: DataFrame, tokens: Sequence[str] | None) -> DataFrame:
    """Tracks by name or index in request order (``request``), repeats once; unknown ones fail the query.

    The tokens are an option of the caller, so they are the only rows that come from the driver.
    """
    if not tokens:
        return tracks.withColumn("request", F.col("track_index").cast("bigint"))
    spark = tracks.sparkSession
    asked = spark.createDataFrame(
        [(i, str(token).strip()) for i, token in enumerate(tokens)], "pos bigint, token string"
    )
    # As in a dictionary filled in track order, the last track of a repeated name holds it.
    by_name = tracks.groupBy(F.col("track_name").alias("token")).agg(F.max("track_index").alias("__named"))
    number = F.when(F.col("token").rlike(r"^-*[0-9]+$"), F.expr("try_cast(token as bigint)"))
    by_index = tracks.select(F.col("track_index").cast("bigint").alias("__number"))
    found = (
        asked.join(by_name, "token", "left")
        .withColumn("__wanted", number)
        .join(by_index, F.col("__wanted") == F.col("__number"), "left")
        .withColumn("track_index", F.coalesce(F.col("__named").cast("bigint"), "__number"))
    )
    checked = F.when(F.col("track_index").isNotNull(), F.col("track_index")).otherwise(
        F.raise_error(F.concat(F.lit("unknown track: "), F.col("token"))).cast("bigint")
    )
    wanted = found.withColumn("track_index", checked).groupBy("track_index").agg(F.min("pos").alias("request"))
    return tracks.join(wanted, "track_index")


def _present(tracks: DataFrame, fields: Sequence[str]) -> list[str]:
    """Fields that some track has a value for: one aggregate, one row."""
    known = [f for f in fields if f in tracks.columns]
    if not known:
        return []
    row = tracks.agg(*[F.count(f).alias(f) for f in known]).first()
    return [f for f in known if row[f] > 0]


def strand_permutation(
    tracks: DataFrame, fields: Sequence[str] = PAIRING_FIELDS, *, present: Sequence[str] | None = None
) -> DataFrame:
    """``(track_index, mate)``: the i-th plus and the i-th minus track of a group swap places.

    Groups are tracks with equal pairing fields (NULL equals NULL). Tracks without a mate or without a
    known strand map to themselves. ``present`` skips the look-up of which fields are in use.
    """
    keys = list(present) if present is not None else _present(tracks, fields)
    signed = tracks.select("track_index", *keys, strand_sign(F.col("strand").cast("string")).alias("sign"))
    ranked = number_rows(
        signed.where(F.col("sign").isNotNull()), "track_index", group=[*keys, "sign"], out="place"
    )
    plus = ranked.where(F.col("sign") == "+").withColumnRenamed("track_index", "plus_track")
    minus = ranked.where(F.col("sign") == "-").withColumnRenamed("track_index", "minus_track")
    pairs = null_safe_join(plus.drop("sign"), minus.drop("sign"), [*keys, "place"])
    mates = pairs.select(
        F.explode(F.array(
            F.struct(F.col("plus_track").alias("track_index"), F.col("minus_track").alias("mate")),
            F.struct(F.col("minus_track").alias("track_index"), F.col("plus_track").alias("mate")),
        )).alias("m")
    ).select("m.*")
    return tracks.select("track_index").join(mates, "track_index", "left").select(
        "track_index", F.coalesce("mate", "track_index").alias("mate")
    )


def permutation_array(permutation: DataFrame) -> DataFrame:
    """One row: the permutation as an array in track order, NULL when it changes nothing."""
    moved = F.max((F.col("mate") != F.col("track_index")).cast("int")) > 0
    ordered = F.array_sort(F.collect_list(F.struct("track_index", "mate")))
    return permutation.agg(
        F.when(moved, F.transform(ordered, lambda p: p["mate"].cast("int"))).alias("permutation")
    )


def condition_groups(tracks: DataFrame, *, present: Sequence[str] | None = None) -> DataFrame:
    """``(track_index, group_id)``: tracks alike in all but their condition share an id.

    Ids count up by first appearance in track order. NaN counts as missing.
    """
    if present is not None:
        keys = list(present)
    else:
        keys = _present(tracks, GROUPING_FIELDS) or sorted(
            _present(tracks, [c for c in tracks.columns if c not in NON_GROUPING_FIELDS])
        )
    if not keys:
        raise ValueError("no metadata field tells the tracks apart")
    types = dict(tracks.dtypes)
    clean = tracks.select(
        "track_index",
        *[F.nanvl(F.col(k), F.lit(None)).alias(k) if types[k] in ("float", "double") else F.col(k) for k in keys],
    )
    first = clean.groupBy(*keys).agg(F.min("track_index").alias("__first"))
    numbered = number_rows(first, "__first", out="group_id")
    return null_safe_join(clean, numbered, keys).select("track_index", "group_id")


def with_defaults(tracks: DataFrame) -> DataFrame:
    """Scale and clip columns with the defaults where a record lacks them."""
    have = lambda name: F.col(name) if name in tracks.columns else F.lit(None).cast("double")
    return tracks.withColumns({
        "scale_factor": F.coalesce(have("scale_factor"), F.lit(DEFAULT_SCALE_FACTOR)),
        "clip_soft": F.coalesce(have("clip_soft"), F.lit(DEFAULT_CLIP_SOFT)),
        "clip_hard": F.coalesce(have("clip_hard"), F.lit(DEFAULT_CLIP_HARD)),
    })


def model_metadata(tracks: DataFrame) -> DataFrame:
    """Constant per-track model inputs; a field that no track has is left out.

    Missing ids become -1; a field whose ids are all negative counts as missing. Missing time points
    stay NULL.
    """
    columns = {}
    for out, field in MODEL_METADATA.items():
        if field in tracks.columns:
            value = F.col(field)
            columns[out] = (
                F.nanvl(value.cast("double"), F.lit(None)) if out == "track_timepoint_minutes"
                else F.coalesce(value.cast("bigint"), F.lit(-1))
            )
    prepared = tracks.select("track_index", *[c.alias(name) for name, c in columns.items()])
    if not columns:
        return prepared
    used = prepared.agg(*[
        (F.count(name) if name == "track_timepoint_minutes" else F.count_if(F.col(name) >= 0)).alias(name)
        for name in columns
    ]).first()
    return prepared.select("track_index", *[name for name in columns if used[name] > 0])


def attach_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Constant track metadata on every (example, track) row."""
    return rows.join(metadata, "track_index")


def cardinality(tracks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: per id field its largest non-negative id plus one, 0 when there is none."""
    return tracks.agg(*[
        F.coalesce(F.max(F.when(F.col(f) >= 0, F.col(f))) + 1, F.lit(0)).cast("bigint").alias(f) for f in fields
    ])


def enrich(tracks: DataFrame, factors: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Overwrite ``fields`` of the tracks that the factor table knows; others stay as they are."""
    absent = [f for f in fields if f not in factors.columns]
    if absent:
        raise ValueError(f"fields missing from the scale-factor table: {absent}")
    new = factors.select("track_index", F.lit(True).alias("__known"), *[
        F.col(f).cast("double").alias(f"__new_{f}") for f in fields
    ])
    joined = tracks.join(new, "track_index", "left")
    old = lambda f: F.col(f).cast("double") if f in tracks.columns else F.lit(None).cast("double")
    return joined.withColumns(
        {f: F.when(F.col("__known"), F.col(f"__new_{f}")).otherwise(old(f)) for f in fields}
    ).drop("__known", *[f"__new_{f}" for f in fields])


def enrichment_count(tracks: DataFrame, factors: DataFrame) -> DataFrame:
    """One row: how many tracks the factor table updates, out of how many."""
    known = factors.select("track_index", F.lit(True).alias("__known")).dropDuplicates(["track_index"])
    return tracks.join(known, "track_index", "left").agg(
        F.count("__known").alias("n_updated"), F.count(F.lit(1)).alias("n_tracks")
    )
