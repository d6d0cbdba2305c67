"""Prediction windows, sequence, arrays, collapse, inference, sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.functions import arrays as A, signal as G
from genotiles.operators import augment, collapse, examples, inference, sampling, windows as W
from genotiles.operators.regions import with_context_window
from genotiles.plans.build import BuildOptions, Geometry, build_examples
from genotiles.plans.evaluate import evaluate_examples
from genotiles.plans.predict import predict_regions, predict_signal
from genotiles.queries import views as V
from genotiles.queries.base import Query, rounded, rounded_sql

PRED_BP = V.N_BINS * V.BIN
CONTEXT = 200_000
CHUNK = 500
GEOMETRY = Geometry(context_length=256, n_pred_bins=16, bin_size=8)
BUILD = BuildOptions(
    geometry=Geometry(context_length=256, n_pred_bins=16, bin_size=8, shift_max_bp=8), tile_bins=64, chunk_bases=CHUNK
)
SEED = 42


def targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.prediction_windows(
        V.contigs(spark, sf_dir), V.N_BINS, V.BIN, CONTEXT, regions=V.regions(spark, sf_dir)
    )
    return W.in_genome_order(rows).select("index", "chrom_rank", "pred_start", "pred_end", "ctx_start", "ctx_end")


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.prediction_windows(V.contigs(spark, sf_dir), V.N_BINS, V.BIN, CONTEXT, whole_genome=True)
    return W.in_genome_order(rows).select("chrom", "chrom_rank", "pred_start", "pred_end", "ctx_start", "ctx_end")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.targeted_windows(V.regions(spark, sf_dir), V.contigs(spark, sf_dir), V.N_BINS, V.BIN, CONTEXT)
    return W.overlapping_neighbours(rows, PRED_BP)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors as predictions: whole numbers, some windows before 0 or over the contig end."""
    whole = F.transform("labels", lambda row: F.transform(row, lambda v: F.round(v.cast("double") * 8)))
    return V.tensors(spark, sf_dir).select(
        F.concat(F.lit("v"), F.col("index").cast("string")).alias("chrom"),
        (F.pmod(F.col("index"), F.lit(7)) * 10 - 25).alias("pred_start"),
        (F.lit(90) + F.pmod(F.col("index"), F.lit(60))).alias("len"), whole.alias("values"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.long_records(_predictions(spark, sf_dir), 10)
    return rows.select("chrom", "start_pos", "end_pos", F.col("track").cast("bigint").alias("track"), "value")


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse.collapse(inference.by_track(_predictions(spark, sf_dir)), 10, 0.01)
    return rows.select(
        "chrom", "start_pos", "end_pos", F.col("track").cast("bigint").alias("track"), rounded("value").alias("value")
    )


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.chunk_sequences(V.sequences(spark, sf_dir).select("chrom", "seq"), CHUNK)


def _doc_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sequence_lengths(spark, sf_dir)


def contig_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.contigs_from_chunks(_chunks(spark, sf_dir))


def tile_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = W.tiled_windows(_doc_contigs(spark, sf_dir), 16, 8, 256)
    placed = tiles.withColumns({
        "read_start": F.greatest("ctx_start", F.lit(0)), "read_end": F.least("ctx_end", "len"),
        "left_pad": F.greatest(-F.col("ctx_start"), F.lit(0)),
    })
    rows = examples.fetch_sequence(placed, _chunks(spark, sf_dir), 256, key=("chrom", "pred_start"), chunk=CHUNK)
    return rows.select("chrom", "pred_start", F.md5("seq").alias("seq_md5"))


def region_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = with_context_window(V.genome_regions(spark, sf_dir), _doc_contigs(spark, sf_dir), 256)
    rows = examples.fetch_sequence(located, _chunks(spark, sf_dir), 256, chunk=CHUNK)
    return rows.select("index", F.md5("seq").alias("seq_md5"))


def _channel_sums(matrix: str) -> list[Column]:
    """Per channel the number of ones and the 1-based position of the first."""
    one, none = F.lit(1).cast("tinyint"), F.lit(0).cast("tinyint")
    columns = []
    for i, base in enumerate("acgt"):
        row = F.get(F.col(matrix), F.lit(i))
        columns.append(F.size(F.array_remove(row, none)).cast("bigint").alias(f"n_{base}"))
        columns.append(F.array_position(row, one).cast("bigint").alias(f"first_{base}"))
    return columns


def one_hot(encoder: Callable[[str], Column]):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = V.sequences(spark, sf_dir).withColumn("x", encoder(F.col("seq")))
        return rows.select("chrom", *_channel_sums("x"))
    return build


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every character that is no letter A-Z written as N."""
    return V.sequences(spark, sf_dir).select("chrom", F.regexp_replace("seq", "[^A-Za-z]", "N").alias("seq"))


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("chrom", F.md5(A.reverse_complement(F.col("seq"))).alias("seq_md5"))


def _cells(rows: DataFrame, matrix: str = "labels") -> DataFrame:
    """Long cells of a nested column."""
    long = rows.select("index", F.posexplode(matrix).alias("track", "vals"))
    cells = long.select("index", "track", F.posexplode("vals").alias("bin", "value"))
    return cells.select(
        "index", F.col("track").cast("bigint").alias("track"), F.col("bin").cast("bigint").alias("bin"),
        F.col("value").cast("double").alias("value"),
    )


def _rounded_cells(rows: DataFrame, digits: int = 6) -> DataFrame:
    return _cells(rows).withColumn("value", rounded("value", digits))


def centre_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(V.tensors(spark, sf_dir).withColumn("labels", A.crop_columns(F.col("labels"), F.lit(3), 10)))


def _shift() -> Column:
    return F.pmod(A.draw(F.col("index"), SEED, 0, "shift"), F.lit(7)).cast("int")


def random_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(V.tensors(spark, sf_dir).withColumn("labels", A.crop_columns(F.col("labels"), _shift(), 10)))


def both_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(V.tensors(spark, sf_dir).withColumn("labels", A.reverse_both_axes(F.col("labels"))))


def swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mates = F.array(*[F.lit(i) for i in (1, 0, 3, 2)])
    turned = A.permute_rows(A.reverse_bins(F.col("labels")), mates)
    return _cells(V.tensors(spark, sf_dir).withColumn("labels", turned))


def _scaled_cells(spark: SparkSession, sf_dir: str, **steps: bool) -> DataFrame:
    cells = _cells(V.tensors(spark, sf_dir))
    scale = F.lit(40.0) * (F.col("track") + 1)
    value = G.transform_value(F.col("value"), scale, F.lit(8.0), F.lit(30.0), **steps)
    return cells.withColumn("value", rounded(value))


def transformed(**steps: bool):
    return lambda spark, sf_dir: _scaled_cells(spark, sf_dir, **steps)


def inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(V.tensors(spark, sf_dir))
    value = G.inverse_value(F.col("value") * 10, F.lit(2.0) * F.col("track"))
    return cells.withColumn("value", rounded(value, 3))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(V.tensors(spark, sf_dir))
    power, log = G.target_transform("power_0_75"), G.target_transform("log1p")
    x = F.col("value") * 10
    return cells.select(
        "index", "track", "bin", rounded(G.signed_sqrt(x)).alias("squashed"), rounded(power.forward(x)).alias("power"),
        rounded(power.inverse(x), 4).alias("power_inverse"), rounded(log.forward(x)).alias("log"),
        rounded(log.inverse(F.col("value")), 4).alias("log_inverse"),
    )


def as_examples(tensors: DataFrame) -> DataFrame:
    """Tensors as stored examples of 12 bins and a shift buffer of 2 bins at one base per bin."""
    ids = F.transform("labels", lambda row: F.transform(row, lambda v: (v > 0).cast("tinyint")))
    big = F.transform("labels", lambda row: F.transform(row, lambda v: (v * 50).cast("float")))
    return tensors.select("index", ids.alias("input_ids"), big.alias("labels"))


def read_transform(spark: SparkSession, center: bool) -> Callable[[DataFrame], DataFrame]:
    """Read-time transform for those examples: centre crop, or random crop with reverse complement."""
    vectors = spark.createDataFrame(
        [(t, 1.0 + t, 6.0 + t, 40.0 + 10 * t) for t in range(4)],
        "track_index int, scale_factor double, clip_soft double, clip_hard double",
    )
    mates = spark.createDataFrame([([1, 0, 3, 2],)], "permutation array<int>")
    return augment.make_transform(
        augment.track_vectors(vectors), shift_max_bins=2, context_length=12, n_pred_bins=12, bin_size=1,
        center_crop=center, enable_rc_aug=not center, rc_permutation=None if center else mates, seed=SEED,
    )


def read_time(center: bool):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = as_examples(V.tensors(spark, sf_dir)).transform(read_transform(spark, center))
        ids = _cells(rows, "input_ids").withColumnRenamed("value", "base")
        return _rounded_cells(rows, 3).join(ids, ["index", "track", "bin"])
    return build


def evaluated(max_samples: int | None):
    """A sample of the examples, or all, scored against predictions that mirror their transformed labels."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = as_examples(V.tensors(spark, sf_dir))
        transform = read_transform(spark, center=True)
        predictions = stored.transform(transform).select("index", A.reverse_bins(F.col("labels")).alias("values"))
        rows = evaluate_examples(
            stored, predictions, transform, topk_bins=5, n_bins=12, losses=[{"name": "mse"}],
            max_samples=max_samples, seed=SEED,
        )
        return rows.select("metric", rounded("value", 4).alias("value"))
    return build


def load_counting_model() -> inference.Model:
    """Model of two tracks: bases A, and bases C or G, counted per bin in the middle of the context."""
    bins, size = GEOMETRY.n_pred_bins, GEOMETRY.bin_size
    start = (GEOMETRY.context_length - bins * size) // 2

    def model(x: np.ndarray) -> np.ndarray:
        middle = x[:, :, start:start + bins * size].reshape(x.shape[0], 4, bins, size).sum(axis=-1)
        return np.stack([middle[:, 0], middle[:, 1] + middle[:, 2]], axis=1)

    return model


def predicted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predict_regions(
        V.genome_regions(spark, sf_dir), _doc_contigs(spark, sf_dir), _chunks(spark, sf_dir), GEOMETRY,
        load_counting_model, chunk_bases=CHUNK,
    )
    return _cells(rows, "values")


def predicted_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = V.genome_tracks(spark, sf_dir).where("track < 2").select(
        F.col("track").alias("track_index"), F.concat(F.lit("t"), F.col("track").cast("string")).alias("track_name")
    )
    rows = predict_signal(
        _doc_contigs(spark, sf_dir), _chunks(spark, sf_dir), GEOMETRY, load_counting_model, names,
        whole_genome=True, chunk_bases=CHUNK, batch_size=64,
    )
    return rows.select("chrom", "start_pos", "end_pos", "track_name", rounded("value").alias("value"))


def built_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build_examples(
        V.genome_regions(spark, sf_dir), V.genome_signal(spark, sf_dir), V.genome_tracks(spark, sf_dir),
        _doc_contigs(spark, sf_dir), _chunks(spark, sf_dir), BUILD,
    )
    label_sum = lambda t: F.aggregate(
        F.get(F.col("labels"), F.lit(t)), F.lit(0.0), lambda a, v: a + v.cast("double")
    )
    sums = [rounded(label_sum(t), 3).alias(f"labels_{t}") for t in range(3)]
    return rows.select("split", "index", "local_index", "interval", *_channel_sums("input_ids"), *sums)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.regions(spark, sf_dir).select("index", "chrom", F.col("index").alias("local_index"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_sample(_orders(spark, sf_dir), 500, SEED).select("index", "chrom")


def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stride_sample(_orders(spark, sf_dir), 400).select("index", "chrom")


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(_orders(spark, sf_dir), 100).select("index", "chrom")


def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.shuffled(_orders(spark, sf_dir), SEED)
    return rows.select("index", sampling.shuffle_key("index", SEED).alias("shuffle_key"))


_TARGETED = f"""{V.with_views('regions', 'contigs')},
    t AS (SELECT r.index, r.chrom, chrom_rank, (start_pos + end_pos) // 2 - {PRED_BP // 2} AS pred_start,
                 (start_pos + end_pos) // 2 - {CONTEXT // 2} AS ctx_start
          FROM regions r JOIN contigs c ON r.chrom = c.chrom)"""

_TENSOR_CELLS = f"""{V.with_views('tensors')},
    rows AS (SELECT index, unnest(labels) AS vals, unnest(range(4)) AS track FROM tensors),
    cells AS (SELECT index, track, unnest(vals)::DOUBLE AS value, unnest(range(16)) AS bin FROM rows)"""

_PRED_CELLS = f"""{_TENSOR_CELLS},
    preds AS (SELECT 'v' || index AS chrom, (index % 7) * 10 - 25 + bin * 10 AS start_pos, 90 + index % 60 AS len,
                     track, bin, round(value * 8) + 0.0 AS value FROM cells)"""

_HASH = "('0x' || substring(md5(index || ':42:0:{salt}'), 1, 15))::BIGINT"


def _letter_sums(seq: str) -> str:
    plain = f"translate({seq}, 'acgt', 'ACGT')"
    return ", ".join(
        f"length({seq}) - length(replace({plain}, '{b.upper()}', '')) AS n_{b}, "
        f"CAST(instr({plain}, '{b.upper()}') AS BIGINT) AS first_{b}" for b in "acgt"
    )


def _context_sql(length: int) -> str:
    return f"""rpad(repeat('N', CAST(greatest(-ctx_start, 0) AS INTEGER))
        || CASE WHEN least(ctx_start + {length}, len) > greatest(ctx_start, 0)
                THEN substring(seq, greatest(ctx_start, 0) + 1, least(ctx_start + {length}, len) - greatest(ctx_start, 0))
                ELSE '' END, {length}, 'N')"""


_DOC_TILES = f"""{V.with_views('sequences')},
    starts AS (SELECT *, unnest(range(0, len, 128)) AS pred_start FROM sequences),
    tiles AS (SELECT *, pred_start + 64 - 128 AS ctx_start FROM starts),
    ctx AS (SELECT chrom, pred_start, len, {_context_sql(256)} AS ctx FROM tiles)"""

_DOC_REGIONS = f"""{V.with_views('sequences', 'genome_regions')},
    placed AS (SELECT r.index, r.chrom, start_pos, end_pos, fold, coalesce(len, 0) AS len, coalesce(seq, '') AS seq,
                      (start_pos + end_pos) // 2 - 128 AS ctx_start
               FROM genome_regions r LEFT JOIN sequences s ON r.chrom = s.chrom),
    ctx AS (SELECT *, {_context_sql(256)} AS ctx FROM placed)"""


def _counts_sql(source: str, keys: str) -> str:
    """Cells of the counting model: characters of each bin of the middle of the context."""
    return f"""bins AS (SELECT {keys}, ctx, unnest(range(16)) AS bin FROM {source}),
    parts AS (SELECT {keys}, bin, substring(ctx, 64 + bin * 8 + 1, 8) AS s FROM bins),
    counts AS (SELECT {keys}, bin, unnest([0, 1]) AS track,
                      unnest([8 - length(replace(replace(s, 'A', ''), 'a', '')),
                              8 - length(regexp_replace(s, '[CGcg]', '', 'g'))])::DOUBLE AS value FROM parts)"""


def _islands(source: str, by: str) -> str:
    return f"""marked AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY {by} ORDER BY bin) THEN 0 ELSE 1 END AS new
               FROM {source}),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY bin) AS run FROM marked)"""


_TRANSFORM = """CASE WHEN value > 0 THEN value ELSE 0 END"""
_CLIPPED = f"least(({_TRANSFORM}) * 40.0::DOUBLE * (track + 1), 30.0)"
_SQUASHED = f"(pow({_CLIPPED} + 1, 0.75::DOUBLE) - 1)"
_KNEE = "(pow(9.0::DOUBLE, 0.75::DOUBLE) - 1)"
_FULL = f"CASE WHEN {_SQUASHED} > {_KNEE} THEN {_KNEE} - 1 + sqrt({_SQUASHED} - {_KNEE} + 1) ELSE {_SQUASHED} END"


_INVERSE = ("greatest(pow(greatest(value * 10, 0) + 1, 4.0::DOUBLE / 3.0::DOUBLE) - 1, 0) "
            "/ greatest(2.0::DOUBLE * track, 1e-8)")


def _read_sql(shift: str, flip: str) -> str:
    """Crop, signal transform, then reverse complement with swapped neighbours where ``flip``."""
    big = "CAST(CAST(value AS FLOAT) * 50::FLOAT AS DOUBLE)"
    clipped = f"least(CASE WHEN {big} > 0 THEN {big} ELSE 0 END * (1.0 + track), 40.0 + 10 * track)"
    squashed = f"(pow({clipped} + 1, 0.75::DOUBLE) - 1)"
    knee = "(pow(7.0::DOUBLE + track, 0.75::DOUBLE) - 1)"
    done = f"CASE WHEN {squashed} > {knee} THEN {knee} - 1 + sqrt({squashed} - {knee} + 1) ELSE {squashed} END"
    return f"""{_TENSOR_CELLS},
    cropped AS (SELECT index, track, bin - ({shift}) AS bin, {flip} AS flip, CAST(CAST({done} AS FLOAT) AS DOUBLE) AS value,
                       CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END AS base
                FROM cells WHERE bin - ({shift}) BETWEEN 0 AND 11),
    lab AS (SELECT index, CASE WHEN NOT flip THEN track WHEN track % 2 = 0 THEN track + 1 ELSE track - 1 END AS track,
                   CASE WHEN flip THEN 11 - bin ELSE bin END AS bin, value FROM cropped),
    ids AS (SELECT index, CASE WHEN flip THEN 3 - track ELSE track END AS track,
                   CASE WHEN flip THEN 11 - bin ELSE bin END AS bin, base FROM cropped)
    SELECT index, track, bin, {rounded_sql('value', 3)} AS value, base::DOUBLE AS base
    FROM lab JOIN ids USING (index, track, bin)"""


_BUILD_SQL = f"""{_DOC_REGIONS.replace('- 128 AS ctx_start', '- 136 AS ctx_start').replace(_context_sql(256), _context_sql(272))},
    grid AS (SELECT chrom, len // 8 AS n_grid FROM sequences WHERE len >= 8),
    hits AS (SELECT s.chrom, track, value, greatest(start_pos, 0) AS lo, least(end_pos, n_grid * 8) AS hi
             FROM genome_signal s JOIN grid g ON s.chrom = g.chrom),
    spread AS (SELECT *, unnest(range(lo // 8, (hi - 1) // 8 + 1)) AS bin FROM hits WHERE lo < hi),
    means AS (SELECT chrom, track, bin, sum(value * (least(hi, bin * 8 + 8) - greatest(lo, bin * 8)))
                     / sum(least(hi, bin * 8 + 8) - greatest(lo, bin * 8)) AS mean FROM spread GROUP BY ALL),
    flips AS (SELECT chrom, track FROM means WHERE track = 1 GROUP BY ALL
              HAVING count(*) FILTER (mean <> 0) > 0
                 AND 5 * count(*) FILTER (mean < 0) >= 4 * count(*) FILTER (mean <> 0)),
    fixed AS (SELECT m.chrom, m.track, bin,
                     CAST(CAST(CASE WHEN f.track IS NULL THEN mean ELSE -mean END AS FLOAT) AS DOUBLE) AS mean
              FROM means m LEFT JOIN flips f ON m.chrom = f.chrom AND m.track = f.track),
    kept AS (SELECT c.*, CASE WHEN fold IN ('fold0', 'fold1', 'fold2', 'fold5', 'fold6', 'fold7') THEN 'train'
                              WHEN fold = 'fold4' THEN 'validation' ELSE 'test' END AS split,
                    greatest(0, (start_pos + end_pos) // 2 - 64 - 8) // 8 AS b0
             FROM ctx c),
    local AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY index) - 1 AS local_index FROM kept),
    used AS (SELECT l.* FROM local l JOIN grid g ON l.chrom = g.chrom),
    sums AS (SELECT u.index, track, sum(mean) AS total FROM used u
             JOIN fixed f ON u.chrom = f.chrom AND f.bin >= b0 AND f.bin < b0 + 18 GROUP BY ALL),
    wide AS (SELECT index, sum(total) FILTER (track = 0) AS t0, sum(total) FILTER (track = 1) AS t1,
                    sum(total) FILTER (track = 2) AS t2 FROM sums GROUP BY index)
    SELECT split, index, local_index, chrom || ':' || start_pos || '-' || end_pos AS interval,
           {_letter_sums('ctx')},
           {rounded_sql('coalesce(t0, 0)', 3)} AS labels_0, {rounded_sql('coalesce(t1, 0)', 3)} AS labels_1,
           {rounded_sql('coalesce(t2, 0)', 3)} AS labels_2
    FROM used LEFT JOIN wide USING (index)"""

def _evaluated_sql(limit: str) -> str:
    """Mirrored labels as predictions; correlation from sums, over all bins, the top five and totals."""
    def sums(name: str, source: str) -> str:
        return (f"{name} AS (SELECT track, count(*) AS n, sum(pred) AS sp, sum(target) AS st, sum(pred * target) AS spt, "
                f"sum(pred * pred) AS sp2, sum(target * target) AS st2 FROM {source} GROUP BY track)")

    r = ("CASE WHEN n * sp2 - sp * sp > 0 AND n * st2 - st * st > 0 "
         "THEN (n * spt - sp * st) / sqrt((n * sp2 - sp * sp) * (n * st2 - st * st)) END")
    median = lambda name: rounded_sql(f"(SELECT quantile_cont({r}, 0.5) FROM {name})", 4)
    labels = _read_sql("2", "false").rsplit("SELECT index, track, bin,", 1)[0]
    return f"""{labels}, chosen AS (
        SELECT index FROM tensors ORDER BY md5(index || ':{SEED}'), index {limit}),
    pairs AS (SELECT t.index, t.track, t.bin, p.value AS pred, t.value AS target,
                     row_number() OVER (PARTITION BY t.index, t.track ORDER BY t.value DESC, t.bin) AS rn
              FROM lab t JOIN lab p ON p.index = t.index AND p.track = t.track AND p.bin = 11 - t.bin
              JOIN chosen ON chosen.index = t.index),
    totals AS (SELECT index, track, sum(pred) AS pred, sum(target) AS target FROM pairs GROUP BY index, track),
    {sums('a', 'pairs')}, {sums('b', '(SELECT * FROM pairs WHERE rn <= 5)')}, {sums('c', 'totals')}
    SELECT 'pearson_bin_median' AS metric, {median('a')} AS value
    UNION ALL SELECT 'pearson_top5_median', {median('b')} UNION ALL SELECT 'pearson_total_median', {median('c')}
    UNION ALL SELECT 'mse', {rounded_sql('(SELECT avg((pred - target) * (pred - target)) FROM pairs)', 4)}"""


QUERIES = [
    Query("targeted_windows", "WIN-1 WIN-3 PRJ-3", targeted,
          f"{_TARGETED} SELECT index, chrom_rank, pred_start, pred_start + {PRED_BP} AS pred_end, ctx_start, "
          f"ctx_start + {CONTEXT} AS ctx_end FROM t"),
    Query("tiled_windows", "WIN-2 WIN-3", tiled, f"""{V.with_views('contigs')},
        t AS (SELECT chrom, chrom_rank, unnest(range(0, len, {PRED_BP})) AS pred_start FROM contigs)
        SELECT chrom, chrom_rank, pred_start, pred_start + {PRED_BP} AS pred_end,
               pred_start + {PRED_BP // 2 - CONTEXT // 2} AS ctx_start,
               pred_start + {PRED_BP // 2 + CONTEXT // 2} AS ctx_end FROM t"""),
    Query("overlapping_windows", "WIN-4", overlaps, f"""{_TARGETED},
        n AS (SELECT chrom, pred_start, lag(pred_start) OVER (PARTITION BY chrom ORDER BY pred_start) AS prev_start FROM t)
        SELECT chrom, prev_start, pred_start, count(*) AS n_pairs FROM n
        WHERE pred_start - prev_start < {PRED_BP} GROUP BY ALL"""),
    Query("long_records", "SNK-8 PRJ-6", records,
          f"{_PRED_CELLS} SELECT chrom, start_pos, start_pos + 10 AS end_pos, track, value FROM preds"),
    Query("collapsed_runs", "WIN-5", collapsed, f"""{_PRED_CELLS},
        kept AS (SELECT * FROM preds WHERE least(start_pos + 10, len) > greatest(start_pos, 0)),
        {_islands('kept', 'chrom, track')}
        SELECT chrom, greatest(min(start_pos), 0) AS start_pos, least(max(start_pos) + 10, any_value(len)) AS end_pos,
               track, {rounded_sql('avg(value)')} AS value FROM runs GROUP BY chrom, track, run"""),
    Query("contig_lengths", "SRC-4 SRC-5", contig_lengths,
          "SELECT 'd' || doc_id AS chrom, length(text) AS len FROM documents"),
    Query("tile_sequences", "SRC-5 JOIN-5 WIN-2", tile_sequences,
          f"{_DOC_TILES} SELECT chrom, pred_start, md5(ctx) AS seq_md5 FROM ctx"),
    Query("region_sequences", "SRC-5 JOIN-5 PRJ-3 JOIN-6", region_sequences,
          f"{_DOC_REGIONS} SELECT index, md5(ctx) AS seq_md5 FROM ctx"),
    Query("one_hot_sequences", "ARR-1", one_hot(A.one_hot_arrow),
          f"{V.with_views('sequences')} SELECT chrom, {_letter_sums('seq')} FROM sequences"),
    Query("one_hot_builtin", "ARR-1", one_hot(A.one_hot),
          f"{V.with_views('sequences')} SELECT chrom, {_letter_sums('seq')} FROM sequences"),
    Query("reverse_complement", "ARR-3", reverse_complement, """
        SELECT 'd' || doc_id AS chrom,
               md5(reverse(translate(regexp_replace(text, '[^A-Za-z]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca'))) AS seq_md5
        FROM documents"""),
    Query("centre_crop", "ARR-2", centre_crop,
          f"{_TENSOR_CELLS} SELECT index, track, bin - 3 AS bin, value FROM cells WHERE bin BETWEEN 3 AND 12"),
    Query("random_crop", "ARR-2", random_crop,
          f"{_TENSOR_CELLS}, s AS (SELECT *, {_HASH.format(salt='shift')} % 7 AS shift FROM cells) "
          "SELECT index, track, bin - shift AS bin, value FROM s WHERE bin - shift BETWEEN 0 AND 9"),
    Query("reverse_both_axes", "ARR-3", both_axes,
          f"{_TENSOR_CELLS} SELECT index, 3 - track AS track, 15 - bin AS bin, value FROM cells"),
    Query("swap_strand_tracks", "ARR-3 JOIN-10", swapped,
          f"{_TENSOR_CELLS} SELECT index, CASE WHEN track % 2 = 0 THEN track + 1 ELSE track - 1 END AS track, "
          "15 - bin AS bin, value FROM cells"),
    Query("transform_signal", "ARR-4", transformed(),
          f"{_TENSOR_CELLS} SELECT index, track, bin, {rounded_sql(_FULL)} AS value FROM cells"),
    Query("transform_without_clip", "ARR-4", transformed(apply_clip=False),
          f"{_TENSOR_CELLS} SELECT index, track, bin, "
          f"{rounded_sql(f'pow(({_TRANSFORM}) * 40.0::DOUBLE * (track + 1) + 1, 0.75::DOUBLE) - 1')} AS value FROM cells"),
    Query("transform_without_squash", "ARR-4", transformed(apply_squash=False),
          f"{_TENSOR_CELLS} SELECT index, track, bin, {rounded_sql(_CLIPPED)} AS value FROM cells"),
    Query("inverse_transform", "ARR-5", inverse,
          f"{_TENSOR_CELLS} SELECT index, track, bin, {rounded_sql(_INVERSE, 3)} AS value FROM cells"),
    Query("target_transforms", "ARR-7 ARR-8", targets, f"""{_TENSOR_CELLS},
        x AS (SELECT *, value * 10 AS x FROM cells)
        SELECT index, track, bin, {rounded_sql('sign(x) * (sqrt(abs(x) + 1) - 1) + 0.01::DOUBLE * x')} AS squashed,
               {rounded_sql('pow(greatest(x, 0), 0.75::DOUBLE)')} AS power,
               {rounded_sql('pow(greatest(x, 0), 1.0::DOUBLE / 0.75::DOUBLE)', 4)} AS power_inverse,
               {rounded_sql('ln(1 + greatest(x, 0))')} AS log,
               {rounded_sql('greatest(exp(value) - 1, 0)', 4)} AS log_inverse FROM x"""),
    Query("read_time_transform_eval", "ARR-6 ARR-2 ARR-4", read_time(True), _read_sql("2", "false")),
    Query("read_time_transform_train", "ARR-6 ARR-2 ARR-3 ARR-4", read_time(False),
          _read_sql(f"{_HASH.format(salt='shift')} % 5", f"({_HASH.format(salt='flip')} % 2 = 0)")),
    Query("evaluate_examples", "PIPE-7 LIM-1 ARR-6 MET-7 MET-8 LOSS-8", evaluated(200), _evaluated_sql("LIMIT 200")),
    Query("evaluate_all_examples", "PIPE-7 ARR-6 MET-7 MET-8 LOSS-8", evaluated(None), _evaluated_sql("")),
    Query("predict_regions", "UDF-1 FLT-8 WIN-1", predicted_regions,
          f"{_DOC_REGIONS}, {_counts_sql('ctx', 'index')} SELECT index, CAST(track AS BIGINT) AS track, bin, value FROM counts"),
    Query("predict_signal", "PIPE-5 UDF-1 WIN-2 WIN-5", predicted_signal, f"""{_DOC_TILES},
        {_counts_sql('ctx', 'chrom, pred_start, len')},
        kept AS (SELECT *, pred_start + bin * 8 AS start_pos FROM counts WHERE pred_start + bin * 8 < len),
        {_islands('kept', 'chrom, pred_start, track')}
        SELECT chrom, min(start_pos) AS start_pos, least(max(start_pos) + 8, any_value(len)) AS end_pos,
               't' || track AS track_name, {rounded_sql('avg(value)')} AS value
        FROM runs GROUP BY chrom, pred_start, track, run"""),
    Query("build_examples", "PIPE-1 AGG-6 ARR-1 JOIN-4 JOIN-5", built_examples, _BUILD_SQL.replace(
        V.with_views("sequences", "genome_regions"), V.with_views("sequences", "genome_regions", "genome_signal"))),
    Query("random_sample", "LIM-1", sample,
          f"{V.with_views('regions')} SELECT index, chrom FROM regions ORDER BY md5(index || ':{SEED}'), index LIMIT 500"),
    Query("stride_sample", "LIM-2", stride, f"""{V.with_views('regions')},
        n AS (SELECT greatest(1, count(*) // 400) AS step FROM regions)
        SELECT index, chrom FROM regions, n WHERE index % step = 0 ORDER BY index LIMIT 400"""),
    Query("first_examples", "LIM-3", first,
          f"{V.with_views('regions')} SELECT index, chrom FROM regions ORDER BY index LIMIT 100"),
    Query("shuffled_examples", "LIM-4", shuffle,
          f"{V.with_views('regions')} SELECT index, md5(index || ':{SEED}') AS shuffle_key FROM regions"),
]
