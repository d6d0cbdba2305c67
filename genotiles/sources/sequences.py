"""FASTA text to numbered sequence chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genotiles.operators.examples import CHUNK_BASES
from genotiles.operators.ordering import null_safe_join
from genotiles.sources.intervals import text_lines

# Lines that a window looks at together: a power of two, so that leading bits of a line's number tell its block.
BLOCK_LINES = 1 << 14

# Tasks that share the lines of one file split, about.
TASKS_PER_SPLIT = 4


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK_BASES) -> DataFrame:
    """``(chrom, chunk_no, seq)`` with ``chunk`` bases per chunk.

    Every line needs its contig and its offset in it. Inside a block of a file split (``BLOCK_LINES`` lines at
    most) both come from a window over that block; what a block inherits from the blocks before it (the open
    contig and how many bases it has) is one row per block. More splits make more tasks, not larger ones.
    """
    place = ["__file", "__split", "__block"]
    text = text_lines(spark, path)
    n_tasks = max(spark.sparkContext.defaultParallelism, TASKS_PER_SPLIT * text.rdd.getNumPartitions())
    lines = text.withColumn("__block", F.shiftright("__line", BLOCK_LINES.bit_length() - 1)).withColumn("value", F.regexp_replace("value", r"\s+$", ""))
    lines = lines.where(F.col("value") != "").withColumn("__head", F.col("value").startswith(">"))
    lines = lines.repartition(n_tasks, *place)
    inside = Window.partitionBy(*place).orderBy("__line")
    # Position of the header a line belongs to; NULL means the contig was opened in an earlier block.
    header = F.last(F.when(F.col("__head"), F.col("__line")), ignorenulls=True).over(inside)
    name = F.last(
        F.when(F.col("__head"), F.regexp_extract("value", r"^>\s*(\S*)", 1)), ignorenulls=True
    ).over(inside)
    marked = lines.withColumn("__header", header).withColumn("__name", name)
    section = Window.partitionBy(*place, "__header").orderBy("__line").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.when(F.col("__head"), 0).otherwise(F.length("value"))
    placed = marked.withColumn("__n", bases).withColumn(
        "__before", F.coalesce(F.sum("__n").over(section), F.lit(0))
    )
    # One row per block: the contig open at its end and the bases that contig has in this block.
    ends = marked.groupBy(*place).agg(
        F.max_by("__name", "__line").alias("__open"),
        F.max("__header").alias("__last_header"),
    )
    tail = placed.groupBy(*place, F.col("__header").alias("__last_header")).agg(F.sum("__n").alias("__tail"))
    ends = null_safe_join(ends, tail, [*place, "__last_header"])
    by_block = Window.partitionBy("__file").orderBy("__split", "__block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last("__open", ignorenulls=True).over(earlier)
    run = F.sum(F.when(F.col("__open").isNotNull(), 1).otherwise(0)).over(by_block)
    carried = (
        ends.withColumn("__run", run)
        .withColumn("__inherited", opened)
        .withColumn(
            "__done",
            F.sum("__tail").over(Window.partitionBy("__file", "__run").orderBy("__split", "__block")),
        )
        .withColumn("__carry", F.coalesce(F.lag("__done").over(by_block), F.lit(0)))
        .select(*place, "__inherited", "__carry")
    )
    joined = placed.where(~F.col("__head")).join(carried, place)
    from_before = F.col("__header").isNull()
    located = joined.select(
        F.coalesce("__name", "__inherited").alias("chrom"),
        (F.col("__before") + F.when(from_before, F.col("__carry")).otherwise(0)).alias("__start"),
        "value",
    )
    first = F.expr(f"__start div {chunk}")
    last = F.expr(f"(__start + length(value) - 1) div {chunk}")
    pieces = located.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    cut_from = F.greatest(F.col("chunk_no") * chunk - F.col("__start"), F.lit(0))
    cut_to = F.least((F.col("chunk_no") + 1) * chunk - F.col("__start"), F.length("value"))
    piece = F.substring("value", (cut_from + 1).cast("int"), (cut_to - cut_from).cast("int"))
    # A chunk holds `chunk` bases, so its group is bounded by that.
    return pieces.repartition(n_tasks, "chrom", "chunk_no").groupBy("chrom", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("__start", piece.alias("piece")))).alias("__pieces")
    ).select("chrom", "chunk_no", F.array_join(F.transform("__pieces", lambda p: p["piece"]), "").alias("seq"))
