"""Streams over the given tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genotiles.operators import metrics as M
from genotiles.queries import views as V
from genotiles.queries.base import Query, rounded, rounded_sql
from genotiles.queries.metric_queries import _FINAL, _STATE_SUMS
from genotiles.queries.window_queries import (
    _TENSOR_CELLS,
    _cells,
    _read_sql,
    _rounded_cells,
    as_examples,
    read_transform,
)
from genotiles.session import configure
from genotiles.streaming import examples as SX, metrics as SM

TOP = 5


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SX.stream_parquet(configure(spark), f"{sf_dir}/{name}.parquet", files_per_trigger=1)


def streamed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental scan of the tensors."""
    rows = SX.run_to_table(V.tensors_of(_stream(spark, sf_dir, "embeddings")), "stream_examples")
    return _cells(rows)


def streamed_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read-time transform on a stream."""
    stream = as_examples(V.tensors_of(_stream(spark, sf_dir, "embeddings")))
    moved = SX.transform_stream(stream, read_transform(spark, center=True))
    rows = SX.run_to_table(moved, "stream_transform")
    ids = _cells(rows, "input_ids").withColumnRenamed("value", "base")
    return _rounded_cells(rows, 3).join(ids, ["index", "track", "bin"])


def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running reconstruction state per track, finalised after the last micro-batch."""
    pairs = V.pairs_of(_stream(spark, sf_dir, "lineitem"))
    state = SM.run_aggregate(SM.running_state(pairs), "stream_state")
    rows = M.finalize_state(state, ["track"])
    return rows.select("track", *[rounded(c).alias(c) for c in ("raw_pearson", "raw_mae", "raw_rmse")])


def nested_pairs(tensors: DataFrame) -> DataFrame:
    """Row t of a tensor as target, the next row as prediction."""
    rows = tensors.select("index", "labels", F.posexplode("labels").alias("track", "target"))
    following = F.element_at("labels", F.pmod(F.col("track") + 1, F.lit(4)) + 1)
    return rows.select("index", F.col("track").cast("bigint").alias("track"), following.alias("pred"), "target")


def _correlations(statistics: DataFrame) -> DataFrame:
    rows = M.track_correlations(statistics)
    return rows.select("track", *[rounded(c).alias(c) for c in ("r_bin", "r_top", "r_total")])


def streamed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nested_pairs(V.tensors_of(_stream(spark, sf_dir, "embeddings")))
    return _correlations(SM.run_aggregate(SM.running_statistics(pairs, TOP), "stream_statistics"))


def nested_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nested_pairs(V.tensors(spark, sf_dir))
    return _correlations(M.accumulate_statistics(M.nested_statistics(pairs, TOP)))


def streamed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stride sample of the orders stream; the limit is applied per micro-batch and at the end."""
    orders = _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local_index"), "o_custkey")
    n_rows = V.table(spark, sf_dir, "orders").count()
    kept = SX.stride_stream(orders, 300, n_rows)
    return SM.take_per_batch(kept, 300, "local_index", "stream_stride")


def _sums(suffix: str, source: str) -> str:
    return (f"{suffix} AS (SELECT track, count(*) AS n, sum(pred) AS sp, sum(target) AS st, sum(pred * target) AS spt, "
            f"sum(pred * pred) AS sp2, sum(target * target) AS st2 FROM {source} GROUP BY track)")


_R = ("CASE WHEN (n * sp2 - sp * sp) > 0 AND (n * st2 - st * st) > 0 "
      "THEN (n * spt - sp * st) / sqrt((n * sp2 - sp * sp) * (n * st2 - st * st)) END")
_NESTED_SQL = f"""{_TENSOR_CELLS},
    pairs AS (SELECT t.index, t.track, t.bin, p.value AS pred, t.value AS target,
                     row_number() OVER (PARTITION BY t.index, t.track ORDER BY t.value DESC, t.bin) AS rn
              FROM cells t JOIN cells p ON p.index = t.index AND p.bin = t.bin AND p.track = (t.track + 1) % 4),
    totals AS (SELECT index, track, sum(pred) AS pred, sum(target) AS target FROM pairs GROUP BY index, track),
    {_sums('a', 'pairs')}, {_sums('b', f'(SELECT * FROM pairs WHERE rn <= {TOP})')}, {_sums('c', 'totals')}
    SELECT track, {rounded_sql(f'(SELECT {_R} FROM a WHERE a.track = k.track)')} AS r_bin,
           {rounded_sql(f'(SELECT {_R} FROM b WHERE b.track = k.track)')} AS r_top,
           {rounded_sql(f'(SELECT {_R} FROM c WHERE c.track = k.track)')} AS r_total
    FROM (SELECT DISTINCT track FROM pairs) k"""

QUERIES = [
    Query("stream_examples", "STR-1 SRC-9", streamed_examples,
          f"{_TENSOR_CELLS} SELECT index, track, bin, value FROM cells"),
    Query("stream_transform", "STR-2 ARR-6", streamed_transform, _read_sql("2", "false")),
    Query("stream_state", "STR-3 AGG-16", streamed_state,
          f"{V.with_views('pairs')}, s AS (SELECT track, {_STATE_SUMS} FROM pairs GROUP BY track) "
          f"SELECT track, {rounded_sql(_FINAL)} AS raw_pearson, {rounded_sql('sum_abs_error / n')} AS raw_mae, "
          f"{rounded_sql('sqrt(sum_sq_error / n)')} AS raw_rmse FROM s"),
    Query("stream_statistics", "STR-4 MET-7 MET-8", streamed_statistics, _NESTED_SQL),
    Query("nested_statistics", "MET-7 MET-8", nested_statistics, _NESTED_SQL),
    Query("stream_stride", "STR-5 LIM-2", streamed_stride, """
        SELECT o_orderkey AS local_index, o_custkey FROM orders,
               (SELECT greatest(1, count(*) // 300) AS step FROM orders)
        WHERE o_orderkey % step = 0 ORDER BY o_orderkey LIMIT 300"""),
]
