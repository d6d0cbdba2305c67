"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings every plan here relies on. Only settings that a running session may change
# are listed; anything the cluster has set itself is left alone.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution with skew handling and UTC where the cluster has not chosen otherwise."""
    chosen = spark.sparkContext.getConf()
    for key, value in {**SQL_DEFAULTS, "spark.sql.session.timeZone": "UTC"}.items():
        if not chosen.contains(key) and spark.conf.get(key) != value:
            spark.conf.set(key, value)
    # The few Python functions travel with the task, so executors need not have the package.
    cloudpickle.register_pickle_by_value(sys.modules["genotiles"])
    return spark


def spread_scan(scan: DataFrame) -> DataFrame:
    """A plain scan over all cores, also where the table is a file that cannot be split, or not into many parts.

    A large file is cut by bytes, but its rows come from few of these cuts if it has few row groups, which only its
    footer tells. Tables of many files are left as they are. Only for scans: asking a plan with shuffles for its
    partitions would run them.
    """
    width = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < width:
        return scan.repartition(width)
    if len(scan.inputFiles()) >= width:
        return scan
    # No column is read for this.
    filled = scan.select(F.spark_partition_id().alias("part")).distinct().count()
    return scan.repartition(width) if 2 * filled < width else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``. Only a local master may do without; it uses the warehouse folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def drop_shared(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; every table read from them is void."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Every later use sees the same rows, also after an executor is lost, and knows their size. Unlike a
    checkpoint, which computes its last stage once to count and once to save, this computes it once.
    """
    path = new_shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
