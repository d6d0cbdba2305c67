"""Genomic tables derived from the driver's tables. Keys grow with the data, so groups stay small.

Every view is a projection or a partial aggregate: no view needs a window over a large group. The SQL
twin of each view is in ``VIEW_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.session import configure, spread_scan

BIN = 3600
N_BINS = 20
TILE = 64
EPOCH = 1_704_067_200  # 2024-01-01 UTC in seconds
REGION_BP = 72_000
REGION_SPAN = 2_520_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that multiplies rows or is heavy per row."""
    return spread_scan(table(spark, sf_dir, name).select(*columns))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value intervals per event type (track) and user (chromosome)."""
    return _intervals(spread(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"))


def _intervals(events: DataFrame) -> DataFrame:
    start = F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH
    return events.select(
        F.col("event_type").alias("track"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("chrom"),
        start.alias("start_pos"),
        (start + 60 + F.pmod(F.col("event_id") * 37, F.lit(7200))).alias("end_pos"),
        "value", "event_id",
    )


def stranded_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two minus-strand tracks, one of them mostly negative, one half negative."""
    rows = signal(spark, sf_dir)
    tens = F.pmod(F.col("event_id"), F.lit(10))
    negative = ((F.col("track") == "error") & (tens < 9)) | ((F.col("track") == "view") & (tens < 5))
    return rows.withColumn("value", F.when(negative, -F.col("value")).otherwise(F.col("value")))


def strand_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track names of the signal with a file path that tells the strand."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("track")).distinct()
    suffix = F.when(F.col("track").isin("error", "view"), "_minus.bw").otherwise("_plus.bw")
    return names.withColumn("path", F.concat(F.lit("/data/"), F.col("track"), suffix))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes of the signal; a chromosome ends where its last interval ends."""
    number = F.substring("chrom", 2, 20).cast("bigint")
    # A maximum per task is all that is shuffled; spreading the scan first would shuffle every row.
    intervals = _intervals(table(spark, sf_dir, "events"))
    return intervals.groupBy("chrom").agg(F.max("end_pos").alias("len")).select(
        "chrom", number.alias("chrom_rank"), "len"
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled intervals from orders; starts are not aligned to bins."""
    orders = spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    start = F.pmod(F.col("o_orderkey") * 7919, F.lit(REGION_SPAN))
    return orders.select(
        F.col("o_orderkey").alias("index"),
        F.concat(F.lit("u"), F.expr("cast(o_custkey div 10 as string)")).alias("chrom"),
        start.alias("start_pos"), (start + REGION_BP).alias("end_pos"),
        F.concat(F.lit("fold"), F.pmod(F.col("o_orderkey"), F.lit(8)).cast("string")).alias("fold"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and targets: one example per part, one track per return flag, one bin per line."""
    return pairs_of(table(spark, sf_dir, "lineitem"))


def pairs_of(lines: DataFrame) -> DataFrame:
    """The same from a batch or a stream of lines."""
    return lines.select(
        F.col("l_partkey").alias("index"), F.col("l_returnflag").alias("track"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("bin"),
        (F.col("l_extendedprice") / 1000).alias("pred"), F.col("l_quantity").alias("target"),
    )


def cond_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with a group and a condition: mean price and quantity per supplier and ship month."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").alias("index"), F.col("l_returnflag").alias("group_id"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("condition_id"),
        F.month("l_shipdate").alias("bin"),
    ).agg((F.avg("l_extendedprice") / 1000).alias("pred"), F.avg("l_quantity").alias("target"))


def region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean signal per part (region) and supplier class (track)."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("index"), F.pmod("l_suppkey", F.lit(8)).cast("int").alias("track_index")
    ).agg(F.avg("l_quantity").alias("mean"))


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library sizes of the region-mean tracks."""
    seen = table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(8)).cast("int").alias("track_index")
    ).distinct()
    return seen.withColumn("library_size", (F.col("track_index") + 1) * F.lit(1_000_000.0))


def tracks_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested track files: a document is a file, its text the content.

    The hash is taken at the scan, so no text is shuffled.
    """
    return spread(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars").select(
        F.col("doc_id").alias("source_index"),
        F.md5(F.concat("text", "source")).alias("identity_key"),
        F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_hash"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track records from suppliers and their nations."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    plus = F.pmod(F.col("s_suppkey"), F.lit(2)) == 0
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("int").alias("track_index"),
        F.concat(F.lit("/data/"), "n_name", F.when(plus, "_plus.bw").otherwise("_minus.bw")).alias("path"),
        F.when(plus, "+").otherwise("-").alias("strand"),
        F.expr("cast((s_suppkey div 2) % 3 as int)").alias("condition_id"),
        F.col("s_nationkey").alias("cell_line_id"),
        F.when(F.pmod("s_suppkey", F.lit(5)) != 0, F.abs("s_acctbal") * 10_000).alias("library_size"),
    )


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested examples: an embedding of 64 values read as 4 tracks x 16 bins."""
    return tensors_of(spread(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def tensors_of(embeddings: DataFrame) -> DataFrame:
    """The same from a batch or a stream of embeddings."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.slice("embedding", t * 16 + 1, 16))
    return embeddings.select(F.col("vec_id").alias("index"), rows.alias("labels"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as contigs."""
    return spread(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"),
        F.col("doc_id").alias("chrom_rank"), F.col("text").alias("seq"),
        F.length("text").cast("bigint").alias("len"),
    )


def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contigs without their sequences. Lengths are taken at the scan, so no text is shuffled."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"),
        F.col("doc_id").alias("chrom_rank"), F.length("text").cast("bigint").alias("len"),
    )


def genome_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value intervals on the document contigs, from order lines; track N is a minus strand."""
    lines = spread(
        spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"
    )
    start = F.pmod(F.col("l_partkey") * 37 + F.col("l_orderkey"), F.lit(2000))
    value = F.round(F.col("l_discount") * 100 + F.col("l_linenumber"), 2)
    return lines.select(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("track"),
        F.concat(F.lit("d"), F.expr("cast(l_orderkey div 15 as string)")).alias("chrom"),
        start.alias("start_pos"), (start + F.col("l_quantity").cast("bigint")).alias("end_pos"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 1), -value).otherwise(value).alias("value"),
    )


def genome_track_index() -> Column:
    return F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)


def genome_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tracks of the genome signal."""
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    number = genome_track_index()
    return flags.select(
        number.alias("track"),
        F.concat(F.lit("/data/"), "l_returnflag", F.when(number == 1, "_minus.bw").otherwise(".bw")).alias("path"),
        (number == 1).alias("is_minus"),
    )


def genome_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled intervals on the document contigs, from orders."""
    orders = spread(spark, sf_dir, "orders", "o_orderkey")
    start = F.pmod(F.col("o_orderkey") * 7919, F.lit(2000))
    return orders.select(
        F.col("o_orderkey").alias("index"),
        F.concat(F.lit("d"), F.expr("cast(o_orderkey div 15 as string)")).alias("chrom"),
        start.alias("start_pos"), (start + 160).alias("end_pos"),
        F.concat(F.lit("fold"), F.pmod(F.col("o_orderkey"), F.lit(8)).cast("string")).alias("fold"),
    )


VIEW_SQL = {
    "signal": f"""
        SELECT event_type AS track, 'u' || user_id AS chrom,
               epoch_us(ts) // 1000000 - {EPOCH} AS start_pos,
               epoch_us(ts) // 1000000 - {EPOCH} + 60 + (event_id * 37) % 7200 AS end_pos,
               value, event_id
        FROM events""",
    "stranded_signal": """
        SELECT track, chrom, start_pos, end_pos, event_id,
               CASE WHEN (track = 'error' AND event_id % 10 < 9) OR (track = 'view' AND event_id % 10 < 5)
                    THEN -value ELSE value END AS value
        FROM signal""",
    "contigs": """
        SELECT chrom, CAST(substring(chrom, 2) AS BIGINT) AS chrom_rank, max(end_pos) AS len
        FROM signal GROUP BY chrom""",
    "regions": f"""
        SELECT o_orderkey AS index, 'u' || (o_custkey // 10) AS chrom,
               (o_orderkey * 7919) % {REGION_SPAN} AS start_pos,
               (o_orderkey * 7919) % {REGION_SPAN} + {REGION_BP} AS end_pos,
               'fold' || (o_orderkey % 8) AS fold
        FROM orders""",
    "pairs": """
        SELECT l_partkey AS index, l_returnflag AS track, l_orderkey * 8 + l_linenumber AS bin,
               l_extendedprice / 1000 AS pred, l_quantity AS target
        FROM lineitem""",
    "cond_pairs": """
        SELECT l_suppkey AS index, l_returnflag AS group_id,
               CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS condition_id, month(l_shipdate) AS bin,
               avg(l_extendedprice) / 1000 AS pred, avg(l_quantity) AS target
        FROM lineitem GROUP BY ALL""",
    "region_means": """
        SELECT l_partkey AS index, CAST(l_suppkey % 8 AS INTEGER) AS track_index, avg(l_quantity) AS mean
        FROM lineitem GROUP BY ALL""",
    "libraries": """
        SELECT DISTINCT CAST(l_suppkey % 8 AS INTEGER) AS track_index,
               (l_suppkey % 8 + 1) * 1000000.0::DOUBLE AS library_size
        FROM lineitem""",
    "tracks_in": """
        SELECT doc_id AS source_index, md5(text || source) AS identity_key, n_chars AS size,
               sha256(text) AS content_hash
        FROM documents""",
    "tracks": """
        SELECT CAST(s_suppkey AS INTEGER) AS track_index,
               '/data/' || n_name || CASE WHEN s_suppkey % 2 = 0 THEN '_plus.bw' ELSE '_minus.bw' END AS path,
               CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
               CAST((s_suppkey // 2) % 3 AS INTEGER) AS condition_id, s_nationkey AS cell_line_id,
               CASE WHEN s_suppkey % 5 <> 0 THEN abs(s_acctbal) * 10000 END AS library_size
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "tensors": """
        SELECT vec_id AS index,
               [embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]] AS labels
        FROM embeddings""",
    "genome_signal": """
        SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS track,
               'd' || (l_orderkey // 15) AS chrom, (l_partkey * 37 + l_orderkey) % 2000 AS start_pos,
               (l_partkey * 37 + l_orderkey) % 2000 + CAST(l_quantity AS BIGINT) AS end_pos,
               CASE WHEN l_returnflag = 'N' AND l_linenumber > 1 THEN -1 ELSE 1 END
                   * round(l_discount * 100 + l_linenumber, 2) AS value
        FROM lineitem""",
    "genome_regions": """
        SELECT o_orderkey AS index, 'd' || (o_orderkey // 15) AS chrom,
               (o_orderkey * 7919) % 2000 AS start_pos, (o_orderkey * 7919) % 2000 + 160 AS end_pos,
               'fold' || (o_orderkey % 8) AS fold
        FROM orders""",
    "bins": f"""
        SELECT chrom, track, bin,
               sum(value * (least(hi, (bin + 1) * {BIN}) - greatest(lo, bin * {BIN})))
                 / sum(least(hi, (bin + 1) * {BIN}) - greatest(lo, bin * {BIN})) AS mean,
               CAST(sum(least(hi, (bin + 1) * {BIN}) - greatest(lo, bin * {BIN})) AS BIGINT) AS covered
        FROM (SELECT *, unnest(range(lo // {BIN}, (hi - 1) // {BIN} + 1)) AS bin
              FROM (SELECT s.chrom, track, value, greatest(start_pos, 0) AS lo,
                           least(end_pos, len // {BIN} * {BIN}) AS hi
                    FROM signal s JOIN contigs c ON s.chrom = c.chrom
                    WHERE NOT isnan(value))
              WHERE lo < hi)
        GROUP BY chrom, track, bin""",
    "sequences": """
        SELECT 'd' || doc_id AS chrom, doc_id AS chrom_rank, text AS seq, length(text) AS len
        FROM documents""",
}

_NEEDS = {
    "stranded_signal": ["signal"],
    "contigs": ["signal"],
    "bins": ["signal", "contigs"],
}


def with_views(*names: str) -> str:
    """``WITH`` prelude of the named views and what they need."""
    ordered: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    return "WITH " + ", ".join(f'{n} AS ({VIEW_SQL[n]})' for n in ordered)
