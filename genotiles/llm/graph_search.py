"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard, searched by a beam.

Equal vectors are one point, which keeps as many of its smallest ids as a result can hold. Points are dealt to shards of
bounded size by hash. A shard's graph is built in one task: a greedy search proposes a new point's neighbours, relaxed
distance pruning keeps diverse ones, and edges go back. The index is a table: a row per point with its vector, ids and
neighbours. Every distinct query vector searches every shard; a task reads a shard once and then a stream of queries, and
shards with very many queries are read by several tasks. Scores are inner products of the original vectors in double
precision. Each shard answers with its k + 1 best rows per query vector, and the best of all shards are ranked.

Cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id take no part.
Vectors are compared with those of their own length only. Repeated rows count once. Of several vectors under one id, each is a
candidate and each searches; a pair of ids has its best score. Ties go to the smaller vec_id. With fewer candidates than k
all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genotiles.llm.pruned_graph import PrunedGraph, lifted
from genotiles.llm.tables import tasks_for, with_field, written
from genotiles.llm.tokens import column_of


@dataclass(frozen=True)
class GraphOptions:
    neighbours: int = 20
    #: Points of a shard, about: its graph and vectors are in one task's memory.
    shard_rows: int = 4096
    degree: int = 32
    #: Points that a search keeps while the graph is built, and while it is queried.
    build_beam: int = 48
    query_beam: int = 80
    relax: float = 1.2
    #: Query vectors that one task takes through a shard, about.
    block_rows: int = 1 << 16


_QUERY_BATCH = 256


def usable(vector: str) -> Column:
    """Whether a vector can be compared: finite components, one at least that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _usable_rows(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & usable("vector"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, in double precision."""
    flat = column.combine_chunks().flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1)


def _build(options: GraphOptions):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("first_id")
        graph = PrunedGraph(lifted(_matrix(shard["vector"])), options.degree, options.build_beam, options.relax)
        n = len(graph.near)
        sizes = pa.array(np.arange(n + 1, dtype=np.int32) * options.degree)
        near = pa.ListArray.from_arrays(sizes, pa.array(graph.near.reshape(-1).astype(np.int32)))
        starts = np.zeros(n, dtype=bool)
        starts[graph.starts] = True
        shard = shard.append_column("place", pa.array(np.arange(n, dtype=np.int32)))
        return shard.append_column("near", near).append_column("is_start", pa.array(starts))
    return run


def build_index(vectors: DataFrame, options: GraphOptions, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index as rows (dim, shard, first_id, vector, ids, place, near, is_start), written to the shared folder."""
    rows = _usable_rows(vectors, ident, vector).distinct()
    shards = tasks_for(rows.count(), options.shard_rows)
    # A result holds k ids, and the query's own may be among a point's. The limit works before the shuffle as well.
    order = Window.partitionBy("digest", "vector").orderBy("vec_id")
    points = (
        rows.withColumn("digest", F.xxhash64("vector"))
        .withColumn("number", F.row_number().over(order)).where(F.col("number") <= options.neighbours + 1)
        .groupBy("digest", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(
            F.size("vector").alias("dim"), F.pmod(F.col("digest"), F.lit(shards)).cast("int").alias("shard"),
            F.col("ids")[0].alias("first_id"), "vector", "ids",
        )
    )
    schema = points.schema
    for name, kind in (("place", "int"), ("near", "array<int>"), ("is_start", "boolean")):
        schema = with_field(points.sparkSession.createDataFrame([], schema), name, kind)
    return written(points.groupBy("dim", "shard").applyInArrow(_build(options), schema), "graph")


_FOUND = "first_id long, digest long, vec_id long, score double"


class _Shard:
    """Searches of one shard for batches of queries."""

    def __init__(self, rows: pa.Table, options: GraphOptions):
        rows = rows.sort_by("place")
        self.options, self.vectors = options, _matrix(rows["vector"])
        near = rows["near"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(rows), -1)
        starts = np.flatnonzero(rows["is_start"].to_numpy())
        self.graph = PrunedGraph(lifted(self.vectors), options.degree, options.build_beam, options.relax, near, starts)
        ids = rows["ids"].combine_chunks()
        self.ids, self.first = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64)

    def search(self, queries: pa.Table) -> pa.RecordBatch:
        q = _matrix(queries["vector"])
        keep = self.options.neighbours + 1
        level = (q / np.abs(q).max(axis=1, keepdims=True)).astype(np.float32)
        level = np.concatenate((level, np.zeros((len(q), 1), np.float32)), axis=1)
        point, _ = self.graph.search(level, max(self.options.query_beam, keep))
        row, place = np.nonzero(point >= 0)
        point = point[row, place]
        score = np.einsum("ij,ij->i", q[row], self.vectors[point])
        # The ids of a point all have its score.
        count = self.first[point + 1] - self.first[point]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        vec_id = self.ids[np.repeat(self.first[point], count) + within]
        row, score = np.repeat(row, count), np.repeat(score, count)
        order = np.lexsort((vec_id, -score, row))
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
        order = order[rank < keep]
        named = [pa.array(queries[c].to_numpy()[row[order]]) for c in ("first_id", "digest")]
        return pa.RecordBatch.from_arrays(
            [*named, pa.array(vec_id[order]), pa.array(score[order])], names=["first_id", "digest", "vec_id", "score"]
        )


def _search(options: GraphOptions):
    """Rows of a partition come sorted by (dim, shard, block, is_query): a shard's points, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, shard = None, [], None
        for batch in batches:
            marks = [column_of(batch, c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "block", "is_query")]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[:1] = True
            for values in marks:
                new[1:] |= values[1:] != values[:-1]
            edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                part = pa.Table.from_batches([batch.slice(low, high - low)])
                here = tuple(int(values[low]) for values in marks[:3])
                if here != key:
                    key, points, shard = here, [], None
                if not marks[3][low]:
                    points.append(part)
                elif points or shard:
                    if shard is None:
                        shard, points = _Shard(pa.concat_tables(points), options), []
                    for at in range(0, len(part), _QUERY_BATCH):
                        yield shard.search(part.slice(at, _QUERY_BATCH))
    return run


def nearest(
    index: DataFrame, queries: DataFrame, options: GraphOptions, ident: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of the index found for each query, but those with its own id."""
    rows = _usable_rows(queries, ident, vector).distinct().withColumn("digest", F.xxhash64("vector"))
    distinct = written(rows.groupBy("digest", "vector").agg(F.min("vec_id").alias("first_id")), "queries")
    blocks = tasks_for(distinct.count(), options.block_rows)
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    points = index.select(
        "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("is_query"),
        "place", F.lit(0).cast("long").alias("first_id"), F.lit(0).cast("long").alias("digest"), "vector", "ids", "near", "is_start",
    )
    asked = distinct.select(
        F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("first_id", "digest"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_query"),
        F.lit(-1).alias("place"), "first_id", "digest", "vector", F.lit(None).cast("array<long>").alias("ids"),
        F.lit(None).cast("array<int>").alias("near"), F.lit(False).alias("is_start"),
    )
    found = (
        points.unionByName(asked).repartition("dim", "shard", "block")
        .sortWithinPartitions("dim", "shard", "block", "is_query").mapInArrow(_search(options), _FOUND)
    )
    best = Window.partitionBy("first_id", "digest").orderBy(F.desc("score"), "vec_id")
    kept = found.withColumn("number", F.row_number().over(best)).where(F.col("number") <= options.neighbours + 1)
    # A vector's answer goes to all ids that asked with it, less their own rows.
    named = rows.join(distinct, ["digest", "vector"]).select("first_id", "digest", F.col("vec_id").alias("query_id"))
    pairs = (
        named.join(kept, ["first_id", "digest"]).where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= options.neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )


def neighbour_report(embeddings: DataFrame, options: GraphOptions | None = None) -> DataFrame:
    """The nearest found of every row whose vec_id is divisible by 20, among all other rows."""
    options = options or GraphOptions()
    return nearest(build_index(embeddings, options), embeddings.where(F.col("vec_id") % 20 == 0), options)
