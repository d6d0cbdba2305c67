"""Tables of the driver, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_field(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of df with one more column."""
    return StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may do without, in the warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: computed once, kept when executors are lost.

    The shuffles that led to the table are of no more use. Spark deletes a shuffle's files when the driver's JVM
    has collected its plan, which may be long after, so the collection is asked for here.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, rows_per_task: int) -> int:
    """Partitions for so many rows."""
    return max(1, -(-rows // rows_per_task))


def _give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library keeps its own house.
        pass


def lean(factory: Callable) -> Callable:
    """For makers of Arrow task functions: a worker that has ended its task holds no freed memory until the next one.

    Spark keeps workers for later stages, and several stand idle beside those at work.
    """

    @wraps(factory)
    def make(*args: object, **options: object) -> Callable:
        run = factory(*args, **options)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                _give_back()

        return task

    return make
