"""Running metric state on streams: only sums per track are kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genotiles.operators import metrics as M
from genotiles.operators.sampling import first_rows
from genotiles.session import new_shared_path


def running_state(pairs: DataFrame, by: Sequence[str] = ("track",)) -> DataFrame:
    """Streaming form of the eight-sum state; the keyed state is one row per group."""
    return M.reconstruction_state(pairs, by)


def running_statistics(examples: DataFrame, topk_bins: int) -> DataFrame:
    """Streaming sums of the 18 statistics per track; the top bins are taken inside each row."""
    return M.accumulate_statistics(M.nested_statistics(examples, topk_bins))


def _read_batches(stream: DataFrame, path: str) -> DataFrame:
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/batches")


def run_aggregate(stream: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode aggregate over everything available and return its last result.

    Every micro-batch overwrites its own folder and is recorded by its number, so a batch that is run
    again replaces itself.
    """
    spark = stream.sparkSession
    path = new_shared_path(spark, name)

    def keep(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    results = _read_batches(stream, path)
    last = results.agg(F.max("batch")).scalar()
    return results.where(F.col("batch") == last).drop("batch")


def take_per_batch(stream: DataFrame, n: int, order: str, name: str) -> DataFrame:
    """First ``n`` rows of a finite stream by ``order``.

    Every micro-batch keeps its own first ``n`` rows; the result is the first ``n`` of those.
    """
    spark = stream.sparkSession
    path = new_shared_path(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        first_rows(rows, n, order).write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return first_rows(_read_batches(stream, path).drop("batch"), n, order)
