from __future__ import annotations

import numpy as np
import pytest

from genotiles.llm.graph_search import GraphOptions, build_index, nearest, neighbour_report
from genotiles.llm.pruned_graph import PrunedGraph, lifted

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def brute(vectors, ids, query, k=20):
    scored = sorted(
        (-float(np.dot(vectors[query], v)), i) for n, (v, i) in enumerate(zip(vectors, ids, strict=True)) if i != ids[query]
    )
    return [(rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]


def test_few_vectors_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    # Lengths differ by far, so the largest inner product is not the nearest point.
    vectors = [(v * s).tolist() for v, s in zip(rng.normal(size=(60, 8)), rng.exponential(size=60) * 10 + 0.01, strict=True)]
    got = answers(neighbour_report(table(spark, vectors)))
    assert sorted(got) == [0, 20, 40]
    for q, found in got.items():
        want = brute(vectors, range(60), q)
        assert [(r, i) for r, i, _ in found] == [(r, i) for r, i, _ in want]
        assert np.allclose([s for *_, s in found], [s for *_, s in want], rtol=1e-14)


@pytest.mark.parametrize("shard_rows", [300, 4096])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24)) * 2
    data = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24))
    vectors = data.tolist()
    options = GraphOptions(shard_rows=shard_rows)
    got = answers(neighbour_report(table(spark, vectors), options))
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        assert np.allclose([s for *_, s in found], [float(data[q] @ data[i]) for _, i, _ in found], rtol=1e-13)
        hits += len({i for _, i, _ in found} & {i for _, i, _ in brute(vectors, range(3000), q)})
    assert hits / (20 * len(got)) > 0.95


def test_copies_are_ranked_by_id(spark):
    rng = np.random.default_rng(3)
    vectors = [[1.0, 2.0, 3.0]] * 700 + rng.normal(size=(100, 3)).tolist()
    got = answers(neighbour_report(table(spark, vectors, [i * 3 for i in range(800)]), GraphOptions(shard_rows=50)))
    for q in (0, 60, 1200):
        assert [i for _, i, _ in got[q]] == [i for i in range(0, 66, 3) if i != q][:20]


def test_unusable_rows_take_no_part(spark):
    vectors = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [], [0.5, 0.5], [-1.0, 0.0], [2.0]]
    ids = [0, 20, 40, 60, 80, 100, 120, 140, 3, 160]
    got = answers(neighbour_report(table(spark, vectors, ids)))
    assert got == {0: [(1, 140, 0.5), (2, 3, -1.0)], 140: [(1, 0, 0.5), (2, 3, -0.5)]}
    assert answers(neighbour_report(table(spark, [[1.0], [2.0]], [None, 20]))) == {}


def test_repeated_rows_and_ids(spark):
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [-1.0, -1.0]]
    got = answers(neighbour_report(table(spark, vectors, [20, 20, 20, 5, 6])))
    assert got == {20: [(1, 5, 0.8), (2, 6, -1.0)]}


def test_empty_table_and_other_columns(spark):
    assert answers(neighbour_report(table(spark, []))) == {}
    named = spark.createDataFrame([(20, [1.0], 1, 2, 3.0), (21, [3.0], 1, 2, 3.0)], "v long, e array<float>, vec_id int, rank int, score double")
    options = GraphOptions()
    got = nearest(build_index(named, options, "v", "e"), named.where("v = 20"), options, "v", "e")
    assert answers(got) == {20: [(1, 21, 3.0)]}


def test_many_blocks_give_the_same(spark):
    rng = np.random.default_rng(4)
    made = table(spark, rng.normal(size=(400, 6)).tolist())
    one = answers(neighbour_report(made, GraphOptions(shard_rows=128)))
    assert answers(neighbour_report(made, GraphOptions(shard_rows=128, block_rows=3))) == one


def test_every_point_is_reached():
    rng = np.random.default_rng(5)
    # Far clusters of equal and nearly equal points.
    data = np.concatenate([np.repeat(rng.normal(size=(3, 5)) * 50, 100, axis=0), rng.normal(size=(300, 5))])
    graph = PrunedGraph(lifted(data), 4, 8, 1.2)
    ids, away = graph.search(np.zeros((1, 6), np.float32), 600)
    assert sorted(ids[0].tolist()) == list(range(600)) and np.isfinite(away).all()
    assert (graph.near != np.arange(600)[:, None]).all()
