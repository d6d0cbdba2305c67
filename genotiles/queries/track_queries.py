"""The track dimension and its scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.functions.names import clean_path
from genotiles.operators import scaling, tracks as T
from genotiles.plans.scale import enrich_tracks, original_scaling, tmm_from_means
from genotiles.queries import views as V
from genotiles.queries.base import Query, rounded, rounded_sql

REGION_KB = 10.0
BIN_SIZE = 32


def final(mode: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = T.final_tracks(T.dedupe_map(V.tracks_in(spark, sf_dir), mode), mode)
        return kept.select("track_index", "source_index", "dedupe_method", "dedupe_key")
    return build


def dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = T.dedupe_map(V.tracks_in(spark, sf_dir), "content")
    rows = T.dropped_tracks(mapped, T.final_tracks(mapped, "content"))
    return rows.select("source_index", "duplicate_of_source_index", "duplicate_of_track_index", "dedupe_method", "dedupe_key")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dedupe_counters(T.dedupe_map(V.tracks_in(spark, sf_dir), "content"))


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is requested under a quoted path; those of one source are not listed."""
    docs = V.table(spark, sf_dir, "documents")
    quoted = F.concat(F.lit(' "/data/'), F.col("doc_id").cast("string"), F.lit('.bw" '))
    return docs.select(F.col("doc_id").alias("source_index"), clean_path(quoted).alias("path"), "lang")


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _requested(spark, sf_dir).where(F.col("lang") != "en").select("path")
    return T.missing_tracks(_requested(spark, sf_dir), listing)


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _requested(spark, sf_dir).where(F.col("lang") != "en").select("path")
    return T.existing_tracks(_requested(spark, sf_dir), listing, drop_missing=True).select("source_index", "path")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_track_names(V.tracks(spark, sf_dir)).select("track_index", "track_name")


def selected(tokens: Sequence[str] | None):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = F.concat(F.lit("track_"), F.col("track_index").cast("string"))
        rows = T.select_tracks(V.tracks(spark, sf_dir).withColumn("track_name", name), tokens)
        return rows.select("track_index", "track_name", F.col("request").cast("bigint").alias("request"))
    return build


def minus_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_minus_flag(V.tracks(spark, sf_dir)).select("track_index", "is_minus")


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every seventh track has no cell line, some have no usable strand.
    rows = V.tracks(spark, sf_dir).withColumns({
        "cell_line_id": F.when(F.col("track_index") % 7 != 0, F.col("cell_line_id")),
        "strand": F.when(F.col("track_index") % 11 != 0, F.col("strand")).otherwise("none"),
    })
    return T.strand_permutation(rows)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.tracks(spark, sf_dir).withColumn(
        "cell_line_id", F.when(F.col("track_index") % 7 != 0, F.col("cell_line_id"))
    )
    return T.condition_groups(rows)


def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = V.tracks(spark, sf_dir).withColumn("clip_hard", F.col("library_size") / 1e5)
    return T.with_defaults(partial).select("track_index", "scale_factor", "clip_soft", rounded("clip_hard").alias("clip_hard"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tracks(spark, sf_dir).withColumns({
        "target_id": F.lit(-1), "timepoint_minutes": F.when(F.col("track_index") % 3 == 0, F.col("track_index") * 1.5),
        "cell_line_id": F.when(F.col("track_index") % 7 != 0, F.col("cell_line_id")),
    })


def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.model_metadata(_metadata(spark, sf_dir))


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cardinality(_metadata(spark, sf_dir), ["condition_id", "cell_line_id", "target_id"])


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region means with the metadata of the track that has the same number."""
    metadata = T.model_metadata(_metadata(spark, sf_dir)).select("track_index", "track_condition_ids")
    rows = T.attach_metadata(V.region_means(spark, sf_dir), metadata)
    return rows.select("index", "track_index", rounded("mean").alias("mean"), "track_condition_ids")


def _original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return original_scaling(V.tracks(spark, sf_dir), BIN_SIZE)


def original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _original(spark, sf_dir).select(
        "track_index", rounded("scale_factor").alias("scale_factor"), "clip_soft", "clip_hard",
        rounded("library_size", 3).alias("library_size"),
    )


def by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = V.tracks(spark, sf_dir).select("track_index", F.col("path").alias("resolved_path"))
    paths = V.tracks(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n_files"))
    return scaling.join_on_path(paths, dimension).select("path", "n_files", "track_index")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _original(spark, sf_dir).where(F.col("library_size") > 0)
    records = V.tracks(spark, sf_dir).withColumn("scale_factor", F.lit(2.5))
    rows = enrich_tracks(records, known)
    return rows.select("track_index", rounded("scale_factor").alias("scale_factor"), "clip_soft", "clip_hard")


def enriched_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _original(spark, sf_dir).where(F.col("library_size") > 0)
    return T.enrichment_count(V.tracks(spark, sf_dir), known)


def tmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = scaling.tmm_factors(V.region_means(spark, sf_dir), V.libraries(spark, sf_dir), REGION_KB)
    return factors.select("track_index", rounded("tmm_factor").alias("tmm_factor"))


def tmm_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = original_scaling(V.libraries(spark, sf_dir), BIN_SIZE)
    rows = tmm_from_means(V.region_means(spark, sf_dir), factors, REGION_KB)
    return rows.select(
        "track_index", rounded("scale_factor").alias("scale_factor"), rounded("tmm_factor").alias("tmm_factor"),
        "clip_soft", "clip_hard",
    )


_DEDUPE = f"""{V.with_views('tracks_in')},
    m AS (SELECT *, min(source_index) OVER (PARTITION BY identity_key) AS identity_source FROM tracks_in),
    s AS (SELECT source_index AS identity_source, count(*) OVER (PARTITION BY size) > 1 AS hashed,
                 min(source_index) OVER (PARTITION BY size, content_hash) AS first_copy
          FROM m WHERE source_index = identity_source),
    c AS (SELECT m.*, hashed, CASE WHEN hashed THEN first_copy ELSE m.identity_source END AS canonical
          FROM m JOIN s USING (identity_source)),
    f AS (SELECT row_number() OVER (ORDER BY source_index) - 1 AS track_index, *
          FROM c WHERE source_index = canonical)"""

_TRACK_NAMES = f"""{V.with_views('tracks')},
    stems AS (SELECT track_index, regexp_replace(regexp_replace(split_part(path, '/', 3), '\\.bw$', ''),
                                                 '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') AS stem FROM tracks),
    copies AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY track_index) - 1 AS n FROM stems),
    names AS (SELECT track_index, CASE WHEN n = 0 THEN stem ELSE stem || '_' || n END AS track_name FROM copies)"""

_ORIGINAL = f"""{V.with_views('tracks')},
    original AS (
        SELECT track_index, coalesce(library_size / 1e9::DOUBLE, 1.0::DOUBLE) * {BIN_SIZE} AS scale_factor,
               round_even(7.0::DOUBLE * coalesce(library_size, 0) / 1e6::DOUBLE, 1) AS clip_soft,
               round_even(16.0::DOUBLE * coalesce(library_size, 0) / 1e6::DOUBLE, 1) AS clip_hard,
               coalesce(library_size, 0::DOUBLE) AS library_size
        FROM tracks)"""

_TMM = f"""{V.with_views('region_means', 'libraries')},
    counts AS (SELECT index, m.track_index, library_size AS lib,
                      mean * ({REGION_KB}::DOUBLE * library_size / 1e6::DOUBLE) AS n
               FROM region_means m JOIN libraries l ON m.track_index = l.track_index),
    uq AS (SELECT track_index, quantile_cont(n, 0.75) AS uq75 FROM counts GROUP BY track_index),
    ref AS (SELECT track_index FROM uq
            ORDER BY abs(uq75 - (SELECT avg(uq75) FROM uq)), track_index LIMIT 1),
    base AS (SELECT index, n AS n_ref, lib AS lib_ref FROM counts
             WHERE track_index = (SELECT track_index FROM ref) AND n >= 1),
    p AS (SELECT c.*, n_ref, lib_ref, log2(n / lib) - log2(n_ref / lib_ref) AS m,
                 0.5::DOUBLE * (log2(n / lib) + log2(n_ref / lib_ref)) AS a
          FROM counts c JOIN base USING (index)
          WHERE track_index <> (SELECT track_index FROM ref) AND n >= 1),
    cuts AS (SELECT track_index, quantile_cont(m, 0.3) AS m_lo, quantile_cont(m, 0.7) AS m_hi,
                    quantile_cont(a, 0.05) AS a_lo, quantile_cont(a, 0.95) AS a_hi
             FROM p GROUP BY track_index),
    w AS (SELECT p.track_index, m,
                 CASE WHEN m BETWEEN m_lo AND m_hi AND a BETWEEN a_lo AND a_hi THEN
                   greatest((lib - n) / (lib * n) + (lib_ref - n_ref) / (lib_ref * n_ref), 1e-10) END AS w
          FROM p JOIN cuts USING (track_index)),
    raw AS (SELECT l.track_index,
                   coalesce(CASE WHEN count(m) >= 10 AND count(w) >= 5 THEN sum(w * m) / sum(w) END, 0) AS lf
            FROM libraries l LEFT JOIN w USING (track_index) GROUP BY l.track_index),
    tmm AS (SELECT track_index, pow(2.0::DOUBLE, lf - (SELECT avg(lf) FROM raw)) AS tmm_factor FROM raw)"""

_PAIRED = f"""{V.with_views('tracks')},
    t AS (SELECT track_index, condition_id, CASE WHEN track_index % 7 <> 0 THEN cell_line_id END AS cell,
                 CASE WHEN track_index % 11 <> 0 THEN strand END AS sign FROM tracks),
    r AS (SELECT *, row_number() OVER (PARTITION BY condition_id, cell, sign ORDER BY track_index) AS rn
          FROM t WHERE sign IS NOT NULL),
    x AS (SELECT p.track_index AS plus_track, m.track_index AS minus_track
          FROM r p JOIN r m ON p.sign = '+' AND m.sign = '-' AND p.rn = m.rn
           AND p.condition_id IS NOT DISTINCT FROM m.condition_id AND p.cell IS NOT DISTINCT FROM m.cell)"""

_META = f"""{V.with_views('tracks')},
    meta AS (SELECT track_index, condition_id, CASE WHEN track_index % 7 <> 0 THEN cell_line_id END AS cell_line_id,
                    CASE WHEN track_index % 3 = 0 THEN track_index * 1.5::DOUBLE END AS timepoint FROM tracks)"""

QUERIES = [
    Query("final_tracks_by_content", "SET-2 WIN-7", final("content"), f"""{_DEDUPE}
        SELECT track_index, source_index, CASE WHEN hashed THEN 'content' ELSE 'identity' END AS dedupe_method,
               CASE WHEN hashed THEN 'content:' || content_hash ELSE identity_key END AS dedupe_key FROM f"""),
    Query("final_tracks_by_identity", "SET-2 WIN-7", final("identity"), f"""{_DEDUPE}
        SELECT row_number() OVER (ORDER BY source_index) - 1 AS track_index, source_index,
               'identity' AS dedupe_method, identity_key AS dedupe_key
        FROM m WHERE source_index = identity_source"""),
    Query("final_tracks_without_dedupe", "SET-2 WIN-7", final("none"), f"""{V.with_views('tracks_in')}
        SELECT row_number() OVER (ORDER BY source_index) - 1 AS track_index, source_index,
               'none' AS dedupe_method, identity_key AS dedupe_key FROM tracks_in"""),
    Query("dropped_tracks", "SET-3", dropped, f"""{_DEDUPE}
        SELECT c.source_index, c.canonical AS duplicate_of_source_index,
               f.track_index AS duplicate_of_track_index,
               CASE WHEN c.identity_source <> c.source_index THEN 'identity' ELSE 'content' END AS dedupe_method,
               CASE WHEN c.identity_source = c.source_index AND c.hashed THEN 'content:' || c.content_hash
                    ELSE c.identity_key END AS dedupe_key
        FROM c JOIN f ON f.source_index = c.canonical WHERE c.source_index <> c.canonical"""),
    Query("dedupe_counters", "AGG-15", counters, f"""{_DEDUPE}
        SELECT count(*) AS n_requested_tracks, 0::BIGINT AS n_missing_tracks,
               count(*) FILTER (source_index <> canonical) AS n_dropped_duplicate_tracks,
               count(*) FILTER (source_index <> identity_source) AS n_identity_duplicates,
               count(*) FILTER (source_index = identity_source AND source_index <> canonical) AS n_content_duplicates,
               count(*) FILTER (source_index = identity_source AND hashed) AS n_hashed_files,
               count(*) FILTER (source_index = canonical) AS n_final_tracks FROM c"""),
    Query("missing_tracks", "FLT-4", missing,
          "SELECT doc_id AS source_index, '/data/' || doc_id || '.bw' AS path FROM documents WHERE lang = 'en'"),
    Query("existing_tracks", "FLT-4", existing,
          "SELECT doc_id AS source_index, '/data/' || doc_id || '.bw' AS path FROM documents WHERE lang <> 'en'"),
    Query("track_names", "PRJ-5", names, f"{_TRACK_NAMES} SELECT * FROM names"),
    Query("selected_tracks", "FLT-7", selected(["3", "track_7", "0", "track_3"]), f"""{V.with_views('tracks')}
        SELECT track_index, 'track_' || track_index AS track_name,
               CASE track_index WHEN 3 THEN 0 WHEN 7 THEN 1 ELSE 2 END::BIGINT AS request
        FROM tracks WHERE track_index IN (0, 3, 7)"""),
    Query("all_tracks_selected", "FLT-7 SRT-2", selected(None),
          f"{V.with_views('tracks')} SELECT track_index, 'track_' || track_index AS track_name, "
          "CAST(track_index AS BIGINT) AS request FROM tracks"),
    Query("minus_flags", "FLT-5", minus_flags,
          f"{V.with_views('tracks')} SELECT track_index, path LIKE '%\\_minus.bw' ESCAPE '\\' AS is_minus FROM tracks"),
    Query("strand_permutation", "JOIN-10", permutation, f"""{_PAIRED},
        y AS (SELECT plus_track AS track_index, minus_track AS mate FROM x
              UNION ALL SELECT minus_track, plus_track FROM x)
        SELECT t.track_index, coalesce(mate, t.track_index) AS mate FROM t LEFT JOIN y USING (track_index)"""),
    Query("condition_groups", "JOIN-11", groups, f"""{V.with_views('tracks')},
        k AS (SELECT track_index, min(track_index) OVER (PARTITION BY
                CASE WHEN track_index % 7 <> 0 THEN cell_line_id END, strand) AS first_track FROM tracks)
        SELECT track_index, dense_rank() OVER (ORDER BY first_track) - 1 AS group_id FROM k"""),
    Query("track_defaults", "PRJ-7", defaults, f"""{V.with_views('tracks')}
        SELECT track_index, 1.0::DOUBLE AS scale_factor, 348.0::DOUBLE AS clip_soft,
               {rounded_sql('coalesce(library_size / 1e5::DOUBLE, 796.0::DOUBLE)')} AS clip_hard FROM tracks"""),
    Query("model_metadata", "PRJ-8", model_metadata, f"""{_META}
        SELECT track_index, CAST(condition_id AS BIGINT) AS track_condition_ids,
               timepoint AS track_timepoint_minutes,
               CAST(coalesce(cell_line_id, -1) AS BIGINT) AS track_cell_line_ids FROM meta"""),
    Query("id_cardinality", "AGG-13", cardinality, f"""{_META}
        SELECT CAST(max(condition_id) + 1 AS BIGINT) AS condition_id,
               CAST(max(cell_line_id) + 1 AS BIGINT) AS cell_line_id, 0::BIGINT AS target_id FROM meta"""),
    Query("attached_metadata", "JOIN-9", attached, f"""{V.with_views('tracks', 'region_means')}
        SELECT index, m.track_index, {rounded_sql('mean')} AS mean,
               CAST(condition_id AS BIGINT) AS track_condition_ids
        FROM region_means m JOIN tracks t ON m.track_index = t.track_index"""),
    Query("original_scaling", "AGG-9 AGG-10 PIPE-2", original, f"""{_ORIGINAL}
        SELECT track_index, {rounded_sql('scale_factor')} AS scale_factor, clip_soft, clip_hard,
               {rounded_sql('library_size', 3)} AS library_size FROM original"""),
    Query("factors_by_path", "JOIN-7", by_path, f"""{V.with_views('tracks')}
        SELECT path, count(*) AS n_files, min(track_index) AS track_index FROM tracks GROUP BY path"""),
    Query("enriched_tracks", "JOIN-8 PIPE-4", enriched, f"""{_ORIGINAL}
        SELECT track_index, {rounded_sql('CASE WHEN library_size > 0 THEN scale_factor ELSE 2.5 END')} AS scale_factor,
               CASE WHEN library_size > 0 THEN clip_soft END AS clip_soft,
               CASE WHEN library_size > 0 THEN clip_hard END AS clip_hard FROM original"""),
    Query("enrichment_count", "JOIN-8", enriched_count,
          f"{_ORIGINAL} SELECT count(*) FILTER (library_size > 0) AS n_updated, count(*) AS n_tracks FROM original"),
    Query("tmm_factors", "AGG-11", tmm,
          f"{_TMM} SELECT track_index, {rounded_sql('tmm_factor')} AS tmm_factor FROM tmm"),
    Query("tmm_scaling", "AGG-12 PIPE-3", tmm_scaled, f"""{_TMM}
        SELECT track_index, {rounded_sql(f'library_size / 1e9::DOUBLE * {BIN_SIZE} / tmm_factor')} AS scale_factor,
               {rounded_sql('tmm_factor')} AS tmm_factor,
               round_even(7.0::DOUBLE * library_size / 1e6::DOUBLE, 1) AS clip_soft,
               round_even(16.0::DOUBLE * library_size / 1e6::DOUBLE, 1) AS clip_hard
        FROM tmm JOIN libraries USING (track_index)"""),
]
