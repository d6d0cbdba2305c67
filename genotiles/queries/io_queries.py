"""Sources and sinks: tables are written to the shared folder in each format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.operators import tracks as T
from genotiles.operators.examples import example_means
from genotiles.plans.build import build_dataset, build_from_paths
from genotiles.plans.scale import enrich_tracks, original_scaling
from genotiles.queries import views as V
from genotiles.queries.base import Query, rounded, rounded_sql
from genotiles.queries.window_queries import BUILD, _BUILD_SQL, _chunks, _doc_contigs
from genotiles.session import new_shared_path
from genotiles.sinks import examples as XS, tables as TS
from genotiles.sources import examples as XR, intervals as I, sequences as Q, tracks as TR

LINE = 60


def _write_lines(rows: DataFrame, line: Column, name: str, *order: str) -> str:
    """Text files that list the rows in order: range-partitioned, so file order is row order."""
    path = new_shared_path(rows.sparkSession, name)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.text(path)
    return path


def labelled_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as BED text with comment and blank lines in between; every third row has no fold."""
    cells = [F.col(c).cast("string") for c in ("chrom", "start_pos", "end_pos")]
    fold = F.when(F.col("index") % 3 != 0, F.concat(F.lit("\t"), F.col("fold"))).otherwise("")
    line = F.concat(F.concat_ws("\t", *cells), fold, F.when(F.col("index") % 10 == 0, "\n# note\n").otherwise(""))
    path = _write_lines(V.regions(spark, sf_dir), line, "regions.bed", "index")
    return I.read_labelled_bed(spark, path)


def target_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as BED text, odd rows separated by blanks, with header and short lines in between."""
    cells = [F.col(c).cast("string") for c in ("chrom", "start_pos", "end_pos")]
    line = F.when(F.col("index") % 2 == 0, F.concat_ws("\t", *cells)).otherwise(F.concat_ws("  ", *cells))
    line = F.concat(line, F.when(F.col("index") % 10 == 0, "\ntrack name=x\nbrowser y\nu1\t5\n").otherwise(""))
    path = _write_lines(V.regions(spark, sf_dir), line, "targets.bed", "index")
    return I.read_target_bed(spark, path)


def chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig lengths as chrom.sizes text in which every fifth name is listed twice."""
    contigs = V.contigs(spark, sf_dir)
    twice = contigs.where(F.col("chrom_rank") % 5 == 0).withColumns(
        {"chrom_rank": F.col("chrom_rank") + 1_000_000_000, "len": F.col("len") + 7}
    )
    line = F.concat("chrom", F.when(F.col("len") % 2 == 0, "\t").otherwise(" "), F.col("len").cast("string"))
    path = _write_lines(contigs.unionByName(twice), line, "chrom.sizes", "chrom_rank")
    return I.read_chrom_sizes(spark, path)


def sequence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig lengths as a five-column sequence index."""
    rest = F.lit(f"0\t{LINE}\t{LINE + 1}")
    line = F.concat_ws("\t", "chrom", F.col("len").cast("string"), rest)
    path = _write_lines(_doc_contigs(spark, sf_dir), line, "genome.fai", "chrom_rank")
    return I.read_sequence_index(spark, path)


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FASTA text, read back as chunks."""
    letters = F.regexp_replace("seq", "[^A-Za-z]", "N")
    record = F.concat(F.lit(">"), F.col("chrom"), F.lit(" text\n"), F.regexp_replace(letters, f"(.{{{LINE}}})", "$1\n"))
    path = _write_lines(V.sequences(spark, sf_dir), record, "genome.fa", "chrom_rank")
    return Q.read_fasta(spark, path, 1000).select("chrom", "chunk_no", F.md5("seq").alias("seq_md5"))


def _signal_files(spark: SparkSession, sf_dir: str) -> str:
    folder = new_shared_path(spark, "signal")
    rows = V.signal(spark, sf_dir).withColumnRenamed("track", "track_name")
    TS.write_signal(rows, V.contigs(spark, sf_dir), folder)
    return folder


def signal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal written per track and read back; the track comes from the file's folder."""
    folder = _signal_files(spark, sf_dir)
    rows = I.read_bedgraph(spark, f"{folder}/*")
    track = F.regexp_extract("track", "track_name=([^/]+)/", 1)
    return rows.groupBy(track.alias("track"), "chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start_pos").alias("starts"), F.sum("end_pos").alias("ends"),
        rounded(F.sum(F.col("value").cast("double")), 2).alias("total"),
    )


def listed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track folders found by a glob, numbered by name."""
    folder = _signal_files(spark, sf_dir)
    found = TR.tracks_in_folder(spark, f"{folder}/*", "*.csv")
    name = F.regexp_extract("path", "track_name=([^/]+)/", 1)
    first = found.groupBy(name.alias("track")).agg(F.min("source_index").alias("first"), F.sum("size").alias("size"))
    return first.select("track", (F.col("size") > 0).alias("has_bytes"))


def _dataset(spark: SparkSession, sf_dir: str) -> str:
    root = new_shared_path(spark, "dataset")
    _write(spark, sf_dir, root)
    return root


def _write(spark: SparkSession, sf_dir: str, root: str, **options: object) -> list[str]:
    return build_dataset(
        root, V.genome_regions(spark, sf_dir), V.genome_signal(spark, sf_dir), V.genome_tracks(spark, sf_dir),
        _doc_contigs(spark, sf_dir), _chunks(spark, sf_dir), BUILD, rows_per_file=500, **options,
    )


def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A built dataset's own document: read, enriched with scale factors, written and read again."""
    root, folder = _dataset(spark, sf_dir), new_shared_path(spark, "enriched")
    document = TR.read_metadata(spark, root)
    records = TR.track_records(document).withColumn("dataset", F.lit(0))
    document = document.withColumn("dataset", F.lit(0))
    sizes = V.table(spark, sf_dir, "lineitem").groupBy(V.genome_track_index().alias("track_index")).agg(
        F.sum("l_quantity").alias("library_size")
    )
    factors = original_scaling(records.select("track_index").join(sizes, "track_index"), document.first()["bin_size"])
    TS.write_metadata_documents(document, enrich_tracks(records, factors), f"{folder}/{TR.METADATA_FILES[0]}")
    found = TR.track_records(TR.read_metadata(spark, folder))
    return found.select(
        F.col("track_index").cast("int").alias("track_index"), "path", "is_minus", rounded("scale_factor").alias("scale_factor")
    )


def built_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region means of a dataset built from a folder of bedGraph files, one per track, named by strand.

    One task writes a track's file, as the format has it; the files get their names by a copy in tasks.
    """
    parts, folder, root = (new_shared_path(spark, name) for name in ("track_parts", "track_files", "from_paths"))
    name = F.when(F.col("track") == 1, "t1_minus").otherwise(F.concat(F.lit("t"), F.col("track").cast("string")))
    rows = V.genome_signal(spark, sf_dir).select("chrom", "start_pos", "end_pos", "value", name.alias("name"))
    rows.repartition("name").write.partitionBy("name").option("sep", "\t").csv(parts)
    target = F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", "name=([^/]+)/", 1), F.lit(".bedGraph"))
    copied = TR.copy_files(TR.list_files(spark, f"{parts}/*", "*.csv").select(F.col("path").alias("source"), target.alias("target")))
    if copied.where("read_hash <> written_hash").count():
        raise AssertionError("a track file was not copied whole")
    build_from_paths(
        root, V.genome_regions(spark, sf_dir), _doc_contigs(spark, sf_dir), _chunks(spark, sf_dir), BUILD, folder=folder, rows_per_file=500
    )
    means = example_means(XR.read_examples(spark, root, columns=["index", "labels"]))
    return means.select("index", F.col("track").cast("bigint").alias("track"), rounded("mean", 3).alias("mean"))


def stored_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region means of the train split, from the labels column of a written dataset."""
    labels = XR.read_examples(spark, _dataset(spark, sf_dir), split="train", columns=["index", "labels"])
    return example_means(labels).select("index", F.col("track").cast("bigint").alias("track"), rounded("mean", 3).alias("mean"))


def stored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split after a second build that finds every split there and writes nothing."""
    root = _dataset(spark, sf_dir)
    if _write(spark, sf_dir, root):
        raise AssertionError("a complete dataset was built again")
    return XS.split_summary(XR.read_examples(spark, root), BUILD.splits)


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset rewritten with zstd holds the same rows, cell by cell, and the files beside them."""
    root, target = _dataset(spark, sf_dir), new_shared_path(spark, "rewritten")
    report = XS.rewrite_dataset(spark, root, target, level=3, rows_per_file=200)
    def cells(path: str, name: str) -> DataFrame:
        rows = XR.read_examples(spark, path)
        return rows.select("split", "index", "local_index", F.md5(F.to_json(F.struct("labels", "input_ids"))).alias(name))

    same = cells(target, "after").join(cells(root, "before"), ["split", "index", "local_index"], "left")
    counted = same.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("index").alias("index_sum"),
        F.sum("local_index").alias("local_sum"), F.count_if(F.col("after") == F.col("before")).alias("n_same"),
    )
    def beside(path: str) -> DataFrame:
        """Files of a few tables that describe the dataset, by their place in it."""
        tables = "{tracks,build_params,split_folds}/*.json"
        found = TR.list_files(spark, f"{path}/{tables}", content=True).unionByName(
            TR.list_files(spark, f"{path}/{TS.METADATA_DOCUMENT}", content=True)
        )
        return found.select(F.regexp_extract("path", "/(rewritten|dataset)-[^/]+/(.*)", 2).alias("place"), "content_hash")

    alike = beside(root).withColumnRenamed("content_hash", "old").join(beside(target), "place", "full")
    all_alike = alike.agg(
        (F.count(F.lit(1)) == F.count_if(F.col("old") == F.col("content_hash"))) & (F.count(F.lit(1)) >= 4)
    ).scalar()
    both = (F.col("bytes_before") > 0) & (F.col("bytes_after") > 0)
    return counted.join(report, "split").select(
        "split", "n_rows", "index_sum", "local_sum", "n_same", both.alias("measured"),
        all_alike.alias("files_copied"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track records through metadata documents, enriched on the way; a dataset has up to 50 tracks."""
    folder = new_shared_path(spark, "metadata")
    records = enrich_tracks(V.tracks(spark, sf_dir), original_scaling(V.tracks(spark, sf_dir), 32))
    records = records.withColumn("dataset", F.expr("track_index div 50"))
    documents = records.select("dataset").distinct().withColumn("bin_size", F.lit(32))
    TS.write_metadata_documents(documents, records, f"{folder}/{TR.METADATA_FILES[0]}")
    found = TR.track_records(TR.read_metadata(spark, folder))
    return found.select(
        F.col("track_index").cast("int").alias("track_index"), "path", "strand", rounded("scale_factor").alias("scale_factor")
    )


def factor_files(fmt: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_shared_path(spark, "factors") + f".{fmt}"
        rows = original_scaling(V.tracks(spark, sf_dir).select("track_index", "library_size"), 32)
        TS.write_scale_factors(rows, path, fmt)
        table = TR.read_scale_factors(spark, path, ["library_size", "scale_factor"])
        return table.select(
            F.col("track_index").cast("int").alias("track_index"), rounded("scale_factor").alias("scale_factor"),
            F.col("clip_soft").cast("double").alias("clip_soft"), F.col("clip_hard").cast("double").alias("clip_hard"),
        )
    return build


def build_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of a build: tracks kept with the number of requested and dropped ones beside."""
    root = new_shared_path(spark, "provenance")
    mapped = T.dedupe_map(V.tracks_in(spark, sf_dir), "content")
    final = T.final_tracks(mapped, "content")
    TS.write_dataset_metadata(
        root, spark, {"bin_size": 8, "splits": {"train": ["fold0", "fold1"], "all": []}}, final,
        T.dropped_tracks(mapped, final),
    )
    size = lambda name: spark.read.json(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n"))
    tables = ("tracks", "dropped_tracks", "build_params", "split_folds")
    rows = [size(name).select(F.lit(name).alias("name"), "n") for name in tables]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


_FACTORS = f"""{V.with_views('tracks')}
    SELECT track_index, {rounded_sql('coalesce(library_size / 1e9::DOUBLE, 1.0::DOUBLE) * 32')} AS scale_factor,
           round_even(7.0::DOUBLE * coalesce(library_size, 0) / 1e6::DOUBLE, 1) AS clip_soft,
           round_even(16.0::DOUBLE * coalesce(library_size, 0) / 1e6::DOUBLE, 1) AS clip_hard FROM tracks"""

_MEMBERS = f"""{V.with_views('genome_regions', 'sequences')},
    kept AS (SELECT *, CASE WHEN fold IN ('fold0', 'fold1', 'fold2', 'fold5', 'fold6', 'fold7') THEN 'train'
                            WHEN fold = 'fold4' THEN 'validation' ELSE 'test' END AS split FROM genome_regions),
    local AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY index) - 1 AS local_index FROM kept),
    used AS (SELECT local.* FROM local JOIN sequences USING (chrom) WHERE len >= 8)"""

_BUILD_PRELUDE = _BUILD_SQL[:_BUILD_SQL.index("    wide AS")].replace(
    V.with_views("sequences", "genome_regions"), V.with_views("sequences", "genome_regions", "genome_signal")
).rstrip().rstrip(",")

# Text files hold values that are read as 32-bit floats.
_FLOAT_PRELUDE = _BUILD_PRELUDE.replace(
    "SELECT s.chrom, track, value,", "SELECT s.chrom, track, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,"
)

QUERIES = [
    Query("labelled_bed", "SRC-1", labelled_bed, f"""{V.with_views('regions')}
        SELECT row_number() OVER (ORDER BY index) - 1 AS index, chrom, start_pos, end_pos,
               CASE WHEN index % 3 <> 0 THEN fold ELSE '' END AS fold FROM regions"""),
    Query("target_bed", "SRC-2", target_bed, f"""{V.with_views('regions')}
        SELECT row_number() OVER (ORDER BY index) - 1 AS index, chrom, start_pos, end_pos FROM regions"""),
    Query("chrom_sizes", "SRC-3", chrom_sizes, f"""{V.with_views('contigs')}
        SELECT chrom, row_number() OVER (ORDER BY chrom_rank) - 1 AS chrom_rank,
               CASE WHEN chrom_rank % 5 = 0 THEN len + 7 ELSE len END AS len FROM contigs"""),
    Query("sequence_index", "SRC-4", sequence_index,
          "SELECT 'd' || doc_id AS chrom, row_number() OVER (ORDER BY doc_id) - 1 AS chrom_rank, length(text) AS len "
          "FROM documents"),
    Query("fasta_chunks", "SRC-5", fasta, """
        SELECT 'd' || doc_id AS chrom, chunk_no, md5(substring(text, chunk_no * 1000 + 1, 1000)) AS seq_md5
        FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', 'N', 'g') AS text,
                     unnest(range((length(text) - 1) // 1000 + 1)) AS chunk_no
              FROM documents WHERE length(text) > 0)"""),
    Query("signal_files", "SNK-7 SRC-6", signal_files, f"""{V.with_views('signal')}
        SELECT track, chrom, count(*) AS n, CAST(sum(start_pos) AS BIGINT) AS starts, CAST(sum(end_pos) AS BIGINT) AS ends,
               {rounded_sql('sum(CAST(CAST(value AS FLOAT) AS DOUBLE))', 2)} AS total FROM signal GROUP BY track, chrom"""),
    Query("listed_tracks", "SRC-7 SNK-7", listed_tracks,
          "SELECT DISTINCT event_type AS track, true AS has_bytes FROM events"),
    Query("stored_means", "SNK-1 SRC-8 AGG-8", stored_means, f"""{_BUILD_PRELUDE}
        SELECT u.index, CAST(t.track AS BIGINT) AS track, {rounded_sql('coalesce(total, 0) / 18', 3)} AS mean
        FROM used u CROSS JOIN (SELECT unnest(range(3)) AS track) t
        LEFT JOIN sums s ON s.index = u.index AND s.track = t.track WHERE split = 'train'"""),
    Query("built_from_paths", "PIPE-1 SRC-6 SRC-7 SET-2", built_from_paths, f"""{_FLOAT_PRELUDE}
        SELECT u.index, CAST(t.track AS BIGINT) AS track, {rounded_sql('coalesce(total, 0) / 18', 3)} AS mean
        FROM used u CROSS JOIN (SELECT unnest(range(3)) AS track) t
        LEFT JOIN sums s ON s.index = u.index AND s.track = t.track"""),
    Query("stored_splits", "SNK-1 SNK-3 SNK-9", stored_splits,
          f"{_MEMBERS} SELECT split, count(*) AS n_rows FROM used GROUP BY split"),
    Query("rewritten_dataset", "SNK-4 PIPE-6", rewritten, f"""{_MEMBERS}
        SELECT split, count(*) AS n_rows, CAST(sum(index) AS BIGINT) AS index_sum,
               CAST(sum(local_index) AS BIGINT) AS local_sum, count(*) AS n_same, true AS measured,
               true AS files_copied FROM used GROUP BY split"""),
    Query("metadata_document", "SNK-5 SRC-10 PRJ-7 PIPE-4", metadata, f"""{V.with_views('tracks')}
        SELECT track_index, path, strand,
               {rounded_sql('coalesce(library_size / 1e9::DOUBLE, 1.0::DOUBLE) * 32')} AS scale_factor FROM tracks"""),
    Query("dataset_metadata", "SNK-5 SRC-10 PIPE-1 PIPE-4", dataset_metadata, f"""
        WITH s AS (SELECT l_returnflag AS flag, CAST(sum(l_quantity) AS DOUBLE) AS library_size FROM lineitem GROUP BY 1)
        SELECT CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS track_index,
               '/data/' || flag || CASE flag WHEN 'N' THEN '_minus.bw' ELSE '.bw' END AS path, flag = 'N' AS is_minus,
               {rounded_sql(f'library_size / 1e9::DOUBLE * {BUILD.geometry.bin_size}')} AS scale_factor FROM s"""),
    Query("factor_table_parquet", "SNK-6 SRC-11", factor_files("parquet"), _FACTORS),
    Query("factor_table_csv", "SNK-6 SRC-11", factor_files("csv"), _FACTORS),
    Query("build_provenance", "SNK-5 SET-3", build_parameters, f"""{V.with_views('tracks_in')},
        m AS (SELECT *, min(source_index) OVER (PARTITION BY identity_key) AS identity_source FROM tracks_in),
        s AS (SELECT *, min(source_index) OVER (PARTITION BY size, content_hash) AS canonical
              FROM m WHERE source_index = identity_source)
        SELECT 'tracks' AS name, count(*) FILTER (source_index = canonical) AS n FROM s
        UNION ALL SELECT 'dropped_tracks', (SELECT count(*) FROM tracks_in) - count(*) FILTER (source_index = canonical) FROM s
        UNION ALL SELECT 'build_params', 1 UNION ALL SELECT 'split_folds', 3"""),
]
