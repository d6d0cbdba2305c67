"""Regions, binning and label assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.functions.names import is_minus_strand
from genotiles.operators import binning, examples, regions as R
from genotiles.queries import views as V
from genotiles.queries.base import Query, rounded, rounded_sql
from genotiles.schemas import DEFAULT_SPLITS

SHIFT = V.BIN
STORED = V.N_BINS + 2
FULL_LENGTH = 720 * V.BIN - V.BIN


def windows(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    return R.with_signal_window(V.regions(spark, sf_dir), V.N_BINS, V.BIN, shift_max_bp=SHIFT, **options)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.signal_bins(V.signal(spark, sf_dir), V.contigs(spark, sf_dir), V.BIN, V.TILE)


def _minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.strand_tracks(spark, sf_dir).where(is_minus_strand(F.col("path")))


def label_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples.label_bins(windows(spark, sf_dir), _grid(spark, sf_dir), STORED, V.BIN, V.TILE)
    return rows.select("index", "track", "bin", rounded("mean").alias("mean"))


def grid_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binning.grid_rows(V.signal(spark, sf_dir), V.contigs(spark, sf_dir), V.BIN, V.TILE)
    return binning.bins_of(rows, "covered").select("chrom", "track", "bin", rounded("mean").alias("mean"), "covered")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = V.signal(spark, sf_dir).select(
        "track", "chrom", "value", "event_id", F.expr("start_pos div 60").alias("start_pos"),
        F.expr("end_pos div 60 + 1").alias("end_pos"),
    )
    lengths = V.contigs(spark, sf_dir).withColumn("len", F.expr("len div 60"))
    return binning.last_wins_bins(minutes, lengths, 60, order="event_id").select(
        "chrom", "track", "bin", rounded("mean").alias("mean")
    )


def exact(n_bins: int):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        bp = V.N_BINS * V.BIN + 2 * SHIFT
        bins = binning.exact_bins(windows(spark, sf_dir), V.signal(spark, sf_dir), n_bins, bp)
        return bins.select("index", "track", "bin", rounded("mean").alias("mean"))
    return build


def _fixed(spark: SparkSession, sf_dir: str, scope: list[str]) -> DataFrame:
    rows = binning.grid_rows(V.stranded_signal(spark, sf_dir), V.contigs(spark, sf_dir), V.BIN, V.TILE)
    fixed = binning.bins_of(binning.fix_minus_rows(rows, _minus(spark, sf_dir), scope))
    return fixed.select("chrom", "track", "bin", rounded("mean").alias("mean"))


def sign_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    bp = V.N_BINS * V.BIN + 2 * SHIFT
    bins = binning.exact_bins(windows(spark, sf_dir), V.stranded_signal(spark, sf_dir), STORED, bp)
    fixed = binning.fix_minus_sign(bins, _minus(spark, sf_dir), ("index", "track"))
    return fixed.select("index", "track", "bin", rounded("mean").alias("mean"))


def nested_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = V.strand_tracks(spark, sf_dir)
    # Dense track numbers in name order, as a count of smaller names (the dimension is a few names).
    ordered = names.agg(F.array_sort(F.collect_list("track"))).scalar()
    n_tracks = names.agg(F.count(F.lit(1)).cast("int")).scalar()
    numbered = V.signal(spark, sf_dir).withColumn("track", F.array_position(ordered, F.col("track")).cast("int") - 1)
    tiles = binning.grid_tiles(numbered, V.contigs(spark, sf_dir), n_tracks, V.BIN, V.TILE)
    labels = examples.nested_labels(windows(spark, sf_dir), tiles, n_tracks, STORED, V.BIN, V.TILE)
    rows = labels.select("index", F.posexplode("labels").alias("track", "vals"))
    total = F.aggregate("vals", F.lit(0.0), lambda a, v: a + v.cast("double"))
    placed = F.aggregate(
        F.transform("vals", lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, v: a + v
    )
    return rows.select(
        "index", F.col("track").cast("bigint").alias("track"), F.size("vals").cast("bigint").alias("n_bins"),
        rounded(total, 3).alias("total"), rounded(placed, 3).alias("placed"),
    )


def region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples.label_bins(windows(spark, sf_dir), _grid(spark, sf_dir), STORED, V.BIN, V.TILE)
    return examples.long_means(rows, STORED).select("index", "track", rounded("mean").alias("mean"))


def signal_windows(clamp: bool):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows(spark, sf_dir, clamp=clamp).select("index", "chrom", "sig_start", "sig_end")
    return build


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = R.with_context_window(V.regions(spark, sf_dir), V.contigs(spark, sf_dir), 200_000)
    return located.select(
        "index", R.interval_label().alias("interval"), "len", "ctx_start", "ctx_end", "read_start", "read_end", "left_pad"
    )


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = {**DEFAULT_SPLITS, "all": [], "odd": ["fold1", "fold3"]}
    return R.assign_splits(V.regions(spark, sf_dir), splits)


def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_local_index(_members(spark, sf_dir)).select("split", "index", "chrom", "local_index")


def split_of_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.keep_chroms(_members(spark, sf_dir), ["u0", "u3", "u7"])
    return R.with_local_index(kept).select("split", "index", "chrom", "local_index")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shard_counts(_members(spark, sf_dir), V.contigs(spark, sf_dir), V.BIN, 8)


def used_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.used_chroms(_members(spark, sf_dir), V.contigs(spark, sf_dir), V.BIN)


def chrom_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every region in the build order, from the sorted rows themselves."""
    ordered = R.chrom_major(V.regions(spark, sf_dir), V.contigs(spark, sf_dir))
    return ordered.select("index", "chrom", "len")


def bad_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions checked against the contigs that reach the last hour; those of one fold end before they start."""
    known = V.contigs(spark, sf_dir).where(F.col("len") >= FULL_LENGTH)
    turned = F.when(F.col("fold") == "fold5", F.col("start_pos") - 1).otherwise(F.col("end_pos"))
    return R.invalid_coordinates(V.regions(spark, sf_dir).withColumn("end_pos", turned), known).select("index", "reason")


def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binning.in_range(V.signal(spark, sf_dir), "u7", 400_000, 1_900_000)
    return found.select("event_id", "track", "start_pos", "end_pos", "value")


_SIG_START = f"greatest(0, (start_pos + end_pos) // 2 - {V.N_BINS * V.BIN // 2} - {SHIFT})"
_WINDOWS = f"""windows AS (
    SELECT *, {_SIG_START} AS sig_start, {_SIG_START} + {V.N_BINS * V.BIN + 2 * SHIFT} AS sig_end FROM regions)"""
_LABELS = f"""labels AS (
    SELECT index, track, bin - sig_start // {V.BIN} AS bin, mean
    FROM windows JOIN bins USING (chrom)
    WHERE bin >= sig_start // {V.BIN} AND bin < sig_start // {V.BIN} + {STORED})"""


def _exact_sql(n_bins: int, signal: str = "signal") -> str:
    width = f"({V.N_BINS * V.BIN + 2 * SHIFT})"
    step = f"({V.N_BINS * V.BIN + 2 * SHIFT}::DOUBLE / {n_bins}::DOUBLE)"
    return f"""{_WINDOWS},
    hits AS (
        SELECT index, track, value, greatest(s.start_pos, sig_start) - sig_start AS lo,
               least(s.end_pos, sig_end) - sig_start AS hi
        FROM windows w JOIN {signal} s ON w.chrom = s.chrom AND s.start_pos < sig_end AND s.end_pos > sig_start),
    spans AS (
        SELECT *, CAST(floor(lo / {step}) AS BIGINT) AS b0,
               least(CAST(ceil(hi / {step}) AS BIGINT), {n_bins}) - 1 AS b1
        FROM hits WHERE lo < hi),
    cells AS (SELECT *, unnest(range(b0, b1 + 1)) AS bin FROM spans),
    parts AS (
        SELECT index, track, bin, value,
               CASE WHEN b0 = b1 THEN hi - lo ELSE
                 least(hi, CASE WHEN bin + 1 >= {n_bins} THEN {width}
                                ELSE CAST(floor((bin + 1) * {step}) AS BIGINT) END)
                 - greatest(lo, CAST(floor(bin * {step}) AS BIGINT)) END AS n
        FROM cells),
    exact AS (
        SELECT index, track, bin, sum(value * n) / sum(n) AS mean FROM parts WHERE n > 0 GROUP BY ALL)"""


def _flip_sql(scope: str, source: str) -> str:
    keys = " AND ".join(f"b.{k} = f.{k}" for k in scope.split(", "))
    return f"""flips AS (
        SELECT {scope} FROM {source} WHERE track IN ('error', 'view') GROUP BY {scope}
        HAVING count(*) FILTER (mean <> 0) > 0
           AND 5 * count(*) FILTER (mean < 0) >= 4 * count(*) FILTER (mean <> 0)),
    fixed AS (
        SELECT b.*, CASE WHEN f.track IS NULL THEN mean ELSE -mean END AS fixed_mean
        FROM {source} b LEFT JOIN flips f ON {keys})"""


def _strand_bins_sql() -> str:
    return V.with_views("stranded_signal", "contigs") + ", strand_bins AS (" + V.VIEW_SQL["bins"].replace(
        "FROM signal s", "FROM stranded_signal s"
    ) + ")"


_MEMBERS = """members AS (
    SELECT unnest(list_filter([
        CASE WHEN fold IN ('fold0', 'fold1', 'fold2', 'fold5', 'fold6', 'fold7') THEN 'train' END,
        CASE WHEN fold = 'fold4' THEN 'validation' END, CASE WHEN fold = 'fold3' THEN 'test' END,
        'all', CASE WHEN fold IN ('fold1', 'fold3') THEN 'odd' END], lambda s: s IS NOT NULL)) AS split, *
    FROM regions)"""

_TOTALS = f"""
    SELECT r.index, t.track_no AS track, CAST({STORED} AS BIGINT) AS n_bins,
           {rounded_sql("coalesce(sum(CAST(CAST(mean AS FLOAT) AS DOUBLE)), 0)", 3)} AS total,
           {rounded_sql("coalesce(sum(CAST(CAST(mean AS FLOAT) AS DOUBLE) * bin), 0)", 3)} AS placed
    FROM regions r CROSS JOIN (SELECT track, row_number() OVER (ORDER BY track) - 1 AS track_no
                               FROM (SELECT DISTINCT track FROM signal)) t
    LEFT JOIN labels l ON l.index = r.index AND l.track = t.track
    GROUP BY r.index, t.track_no"""

QUERIES = [
    Query("label_bins", "JOIN-1 JOIN-4 AGG-1 AGG-3 PRJ-1", label_bins,
          f"{V.with_views('bins', 'regions')}, {_WINDOWS}, {_LABELS} "
          f"SELECT index, track, bin, {rounded_sql('mean')} AS mean FROM labels"),
    Query("grid_bins", "JOIN-1 AGG-1 AGG-3 FLT-6 JOIN-6", grid_bins,
          f"{V.with_views('bins')} SELECT chrom, track, bin, {rounded_sql('mean')} AS mean, covered FROM bins"),
    Query("last_wins_bins", "AGG-2", last_wins, f"""{V.with_views('signal', 'contigs')},
        bases AS (
            SELECT chrom, track, base, arg_max(value, event_id) AS value
            FROM (SELECT s.chrom, track, event_id, value,
                         unnest(range(start_pos // 60, least(end_pos // 60 + 1, len // 60 // 60 * 60))) AS base
                  FROM signal s JOIN contigs c ON s.chrom = c.chrom)
            GROUP BY ALL)
        SELECT chrom, track, base // 60 AS bin, {rounded_sql('avg(value)')} AS mean
        FROM bases GROUP BY chrom, track, base // 60"""),
    Query("exact_bins", "JOIN-3 AGG-1 PRJ-1", exact(STORED),
          f"{V.with_views('signal', 'regions')}, {_exact_sql(STORED)} "
          f"SELECT index, track, bin, {rounded_sql('mean')} AS mean FROM exact"),
    Query("fractional_bins", "JOIN-2 JOIN-3", exact(7),
          f"{V.with_views('signal', 'regions')}, {_exact_sql(7)} "
          f"SELECT index, track, bin, {rounded_sql('mean')} AS mean FROM exact"),
    Query("minus_sign_by_chrom", "AGG-4 FLT-5", lambda s, d: _fixed(s, d, ["chrom", "track"]),
          f"{_strand_bins_sql()}, {_flip_sql('chrom, track', 'strand_bins')} "
          f"SELECT chrom, track, bin, {rounded_sql('fixed_mean')} AS mean FROM fixed"),
    Query("minus_sign_by_track", "AGG-5", lambda s, d: _fixed(s, d, ["track"]),
          f"{_strand_bins_sql()}, {_flip_sql('track', 'strand_bins')} "
          f"SELECT chrom, track, bin, {rounded_sql('fixed_mean')} AS mean FROM fixed"),
    Query("minus_sign_by_region", "AGG-5 JOIN-3", sign_by_region,
          f"{V.with_views('stranded_signal', 'regions')}, {_exact_sql(STORED, 'stranded_signal')}, "
          f"{_flip_sql('index, track', 'exact')} "
          f"SELECT index, track, bin, {rounded_sql('fixed_mean')} AS mean FROM fixed"),
    Query("nested_labels", "AGG-6 JOIN-4", nested_labels,
          f"{V.with_views('bins', 'regions')}, {_WINDOWS}, {_LABELS} {_TOTALS}"),
    Query("region_mean_signal", "AGG-8 JOIN-4", region_means,
          f"{V.with_views('bins', 'regions')}, {_WINDOWS}, {_LABELS} "
          f"SELECT index, track, {rounded_sql(f'sum(mean) / {STORED}')} AS mean FROM labels GROUP BY index, track"),
    Query("signal_windows", "PRJ-1", signal_windows(True),
          f"{V.with_views('regions')}, {_WINDOWS} SELECT index, chrom, sig_start, sig_end FROM windows"),
    Query("signal_windows_unclamped", "PRJ-2", signal_windows(False), f"""{V.with_views('regions')}
        SELECT index, chrom, (start_pos + end_pos) // 2 - {V.N_BINS * V.BIN // 2 + SHIFT} AS sig_start,
               (start_pos + end_pos) // 2 + {V.N_BINS * V.BIN // 2 + SHIFT} AS sig_end FROM regions"""),
    Query("context_windows", "PRJ-3 PRJ-4 JOIN-6", context_windows, f"""{V.with_views('regions', 'contigs')},
        c AS (SELECT r.*, coalesce(len, 0) AS len, (start_pos + end_pos) // 2 - 100000 AS ctx_start
              FROM regions r LEFT JOIN contigs USING (chrom))
        SELECT index, chrom || ':' || start_pos || '-' || end_pos AS interval, len, ctx_start,
               ctx_start + 200000 AS ctx_end, greatest(ctx_start, 0) AS read_start,
               greatest(least(ctx_start + 200000, len), greatest(ctx_start, 0)) AS read_end,
               greatest(ctx_start, 0) - ctx_start AS left_pad FROM c"""),
    Query("split_members", "FLT-1 WIN-6 SET-1", split_members,
          f"{V.with_views('regions')}, {_MEMBERS} SELECT split, index, chrom, "
          "row_number() OVER (PARTITION BY split ORDER BY index) - 1 AS local_index FROM members"),
    Query("split_members_of_chroms", "FLT-3 WIN-6", split_of_chroms,
          f"{V.with_views('regions')}, {_MEMBERS} SELECT split, index, chrom, "
          "row_number() OVER (PARTITION BY split ORDER BY index) - 1 AS local_index "
          "FROM members WHERE chrom IN ('u0', 'u3', 'u7')"),
    Query("shard_counts", "AGG-14 SET-5", shard_counts,
          f"{V.with_views('regions', 'contigs')}, {_MEMBERS} SELECT split, chrom, count(*) AS n_rows, "
          f"CAST(ceil(count(*) / 8.0) AS BIGINT) AS n_shards FROM members JOIN contigs USING (chrom) "
          f"WHERE len >= {V.BIN} GROUP BY split, chrom"),
    Query("used_chroms", "SET-5 SRT-1", used_chroms,
          f"{V.with_views('regions', 'contigs')}, {_MEMBERS} SELECT DISTINCT chrom, len FROM members "
          f"JOIN contigs USING (chrom) WHERE len >= {V.BIN}"),
    Query("chrom_major_order", "SRT-1", chrom_major,
          f"{V.with_views('regions', 'contigs')} SELECT index, chrom, coalesce(len, 0) AS len "
          "FROM regions LEFT JOIN contigs USING (chrom) ORDER BY len DESC, chrom, index"),
    Query("invalid_regions", "FLT-8", bad_coordinates, f"""{V.with_views('regions', 'contigs')},
        k AS (SELECT chrom FROM contigs WHERE len >= {FULL_LENGTH}),
        t AS (SELECT r.*, CASE WHEN fold = 'fold5' THEN start_pos - 1 ELSE end_pos END AS stop, k.chrom AS known
              FROM regions r LEFT JOIN k ON r.chrom = k.chrom)
        SELECT index, CASE WHEN known IS NULL THEN 'unknown chromosome'
                           ELSE 'coordinates must satisfy 0 <= start <= end' END AS reason
        FROM t WHERE known IS NULL OR stop < start_pos"""),
    Query("signal_in_range", "SRC-6", scan_range,
          f"{V.with_views('signal')} SELECT event_id, track, start_pos, end_pos, value FROM signal "
          "WHERE chrom = 'u7' AND start_pos < 1900000 AND end_pos > 400000"),
]
