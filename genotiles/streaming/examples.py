"""Incremental example source and stateless transforms on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genotiles.operators.sampling import stride, stride_filter
from genotiles.schemas import EXAMPLES
from genotiles.session import new_shared_path
from genotiles.sources.examples import examples_path


def stream_parquet(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Read a parquet folder or file as a stream; the schema is that of the files.

    The path is given as a pattern, because a stream takes a single file only that way.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    plain = path.rstrip("/")
    return reader.parquet(f"{plain[:-1]}[{plain[-1]}]")


def stream_examples(spark: SparkSession, root: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Examples of a dataset, incrementally; the schema is known, so no file is read up front."""
    reader = spark.readStream.schema(EXAMPLES).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(examples_path(root))


def transform_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch transform, unchanged."""
    return stream.transform(transform)


def stride_stream(stream: DataFrame, n: int, n_rows: int | None, position: str = "local_index") -> DataFrame:
    """Stateless part of a stride sample; without a known length every row passes."""
    if n_rows is None or n_rows <= n:
        return stream
    return stride_filter(stream, stride(n_rows, n), position)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over everything available, into a table in the shared folder."""
    spark = stream.sparkSession
    path = new_shared_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/offsets")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
