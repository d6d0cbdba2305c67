from __future__ import annotations

import random
import re

import numpy as np
import pytest

from genotiles.llm import jaccard_join
from genotiles.llm.components import components
from genotiles.llm.jaccard_join import GROUPS, JaccardOptions, _met_before, _overlap_bound, _points, least_overlap, linked_documents, one_of_each_group


def brute(texts, ids, size=3, percent=90):
    sets = []
    for text in texts:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x)
             for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets, strict=True))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", "  \n\t", "One", "one", "two words", "Two Words", "a b c", "x " * 4000, "y " * 3000 + "z"]
    while len(texts) < n:
        if rng.random() < 0.45:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 11, 40, 200, 900]))))
        else:
            w = (rng.choice(texts) or "q").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append("  ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    return texts


@pytest.mark.parametrize("tile", [4096, 3])
def test_components_against_all_pairs(spark, documents, tile):
    texts = corpus(5, 260)
    ids = [7 * i + 3 for i in range(len(texts))]
    got = linked_documents(documents(texts, ids), JaccardOptions(tile=tile))
    got = sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(texts, ids)


def test_clique_of_near_copies(spark, documents):
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1:]) for k in range(0, 120)]
    got = linked_documents(documents(texts)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_empty_table_and_repeated_rows(spark, documents):
    assert linked_documents(documents([])).count() == 0
    got = linked_documents(documents(["a b c d", "a b c d", None], [4, 4, None])).collect()
    assert [tuple(r) for r in got] == [(4, 2, 4, 0)]


def test_long_path_is_one_component(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1000), (1001, 1002)], "x long, y long")
    roots = dict((r["id"], r["root"]) for r in components(edges).collect())
    assert {roots[i] for i in range(n)} == {0} and roots[1000] == 1000 and roots[1002] == 1001


def brute_links(texts, size=3, percent=90):
    """By text, the number of other sets that its set is linked with."""
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    different = set(sets)
    return [sum(a != b and 100 * len(a & b) >= percent * len(a | b) for b in different) if a else 0 for a in sets]


@pytest.mark.parametrize("tile", [4096, 50])
def test_links_within_a_clique_of_near_copies(spark, documents, tile):
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1:]) for k in range(0, 120)]
    got = dict(linked_documents(documents(texts), JaccardOptions(tile=tile)).select("doc_id", "n_links").collect())
    assert [got[i] for i in range(120)] == brute_links(texts) == [119] * 120


@pytest.mark.parametrize("tile", [4096, 3])
def test_links_against_all_pairs(spark, documents, tile):
    texts = corpus(5, 260)
    got = dict(linked_documents(documents(texts), JaccardOptions(tile=tile)).select("doc_id", "n_links").collect())
    assert [got[i] for i in range(260)] == brute_links(texts)


def test_points_of_two_very_large_sets_bound_nothing():
    many = _points(np.zeros(70_000, np.uint64), np.zeros(70_000, np.int64), 1)
    few = _points(np.arange(1000, dtype=np.uint64), np.zeros(1000, np.int64), 1)
    assert many.shape == (1, GROUPS)
    assert _overlap_bound(many, many)[0] >= least_overlap(40_000_000, 40_000_000, 90)
    assert _overlap_bound(many, few)[0] == 1000


def test_rows_of_one_document_connect_their_sets(spark, documents):
    a, b, near = "a b c d", "e f g h i", " ".join(f"t{i}" for i in range(100))
    texts = documents([a, b, a, b, near, near, near + " x", near, near + " x", ""], [1, 2, 5, 5, 7, 8, 8, 9, 9, 9])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in linked_documents(texts).collect()}
    assert got == {1: (2, 1, 0), 2: (3, 1, 0), 5: (3, 1, 0), 7: (98, 7, 1), 8: (99, 7, 1), 9: (99, 7, 1)}
    assert sorted(r["doc_id"] for r in one_of_each_group(texts).collect()) == [1, 7]


def test_equal_rows_of_one_document_count_their_links_once(spark, documents):
    near = " ".join(f"t{i}" for i in range(100))
    got = linked_documents(documents([near, near, near + " x"], [4, 4, 6])).select("doc_id", "component_id", "n_links").collect()
    assert sorted(tuple(r) for r in got) == [(4, 4, 1), (6, 4, 1)]


def test_sets_that_links_to_pivots_connect_are_not_compared_again(spark, documents, monkeypatch):
    """Each text differs from the one before in a word; texts are linked to those near them, by keys with many pivots."""
    options, count = JaccardOptions(size=5, percent=80), {}
    texts = [" ".join([f"n{k}" for k in range(i)] + [f"t{k}" for k in range(i, 300)]) for i in range(150)]
    write = jaccard_join.written

    def counted(df, name):
        found = write(df, name)
        count[name] = found.count()
        return found

    monkeypatch.setattr(jaccard_join, "written", counted)
    classes = jaccard_join._linked_classes(documents(texts).select("doc_id", "text"), options)
    assert {r["root"] for r in classes[2].collect()} == {0} and classes[2].count() == len(texts)
    assert count["pairs"] <= len(texts)


def test_a_pair_comes_from_one_of_the_keys_it_shares(spark, documents, monkeypatch, tmp_path):
    """Texts of which many are nearly linked: they share many keys, and the bound leaves them."""
    options, rng, distinct = JaccardOptions(size=5, percent=80), random.Random(3), {}
    texts = []
    for i in range(40):
        w = [f"t{k}" for k in range(1200)]
        for place in rng.sample(range(10, 1190), 16):
            w[place] = f"new{i}-{place}"
        texts.append(" ".join(w))
    tile_pairs, write = jaccard_join._tile_pairs, jaccard_join.written

    def counted(options):
        run = tile_pairs(options)

        def task(batches):
            for k, batch in enumerate(run(batches)):
                (tmp_path / f"{random.SystemRandom().random()}-{k}").write_text(str(batch.num_rows))
                yield batch

        return task

    def kept(df, name):
        found = write(df, name)
        distinct[name] = found.count()
        return found

    monkeypatch.setattr(jaccard_join, "_tile_pairs", counted)
    monkeypatch.setattr(jaccard_join, "written", kept)
    got = linked_documents(documents(texts), options)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(texts, list(range(40)), 5, 80)
    made = sum(int(path.read_text()) for path in tmp_path.iterdir())
    assert distinct["pairs"] > 100 and made <= 1.5 * distinct["pairs"]


def test_pairs_that_share_a_smaller_key():
    top = np.iinfo(np.int64).max
    left = np.array([[-5, 2, 9, top], [-5, 2, 9, top], [1, 3, top, top]])
    right = np.array([[2, 7, 9, 11], [2, 7, 9, 11], [2, 4, top, top]])
    assert _met_before(left, right, np.array([9, 2, top])).tolist() == [True, False, False]
