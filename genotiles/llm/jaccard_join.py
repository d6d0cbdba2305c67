"""Exact n-gram Jaccard self-join: hashed group counts as points, an R-tree bound, verified pairs.

A text's set holds its distinct word shingles. Two sets are linked when 100 * |A n B| >= percent * |A u B|.

1. Equal sets are one class; only one representative of each goes on.
2. Tokens are hashed into groups. Linked sets differ in at most d tokens, so of d + s groups at least s hold the
   same tokens in both: (size class, group, digest of the group's tokens) is an equi-join key that loses no link.
   If either set has fewer than s empty groups, one of the s is not empty; so only sets with s or more empty
   groups have keys of those. d follows from the upper size of the class; a set that may have a partner in the
   next class has keys there too.
3. Within a key, the sets' counts over 256 groups are points of an R-tree. The sum of coordinate minima
   bounds the overlap of two points and, with a box's upper corner, of a point and all points of a box. What
   the bound leaves is verified on the sets.
4. A key's members are first compared with its first member only. What these links connect, over all keys, is one
   component already, so the second pass leaves out pairs of one such component and compares all others. No group's
   pairs are written out: a clique of thousands costs a few links a member, whatever pivots its keys have.
   Keys with the same members are compared once, and a pair that shares several keys comes from the smallest of them.
5. Large keys are cut into tiles of bounded size; a task holds two tiles.
6. All links are inside components, so n_links comes from a second pass: of each component of more than two sets
   every pair is compared on the sets, once, in the one task that holds the pair's tiles, and counted there.

Cases: null, empty and blank texts have the empty set and are linked with nothing; a text of fewer words
than a shingle is one shingle; rows with one doc_id count as one document with the union of links; a null
doc_id is not a document and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.bits import bit_table, has, without_ids
from genotiles.llm.components import components
from genotiles.llm.groups import complete_groups, group_starts
from genotiles.llm.tables import lean, written
from genotiles.llm.tokens import column_of, distinct, mix, pieces, shingles, signed, words

#: Coordinates of a point.
GROUPS = 256
_MOST = 65_535
#: Sizes of one class are below STEP times the smallest.
STEP = 1.5
#: 2^BITS bits of a bit table.
BITS = 25
#: Smallest keys of a set that travel with its point.
LEAST_KEYS = 32
#: Points in a leaf of the tree.
LEAF = 32
#: Tokens of a tile whose sets are compared with all others of their component.
TILE_TOKENS = 1 << 21


@dataclass(frozen=True)
class JaccardOptions:
    size: int = 3
    percent: int = 90
    #: Members of one key that are compared in one task, with as many others.
    tile: int = 4096


def least_overlap(a, b, percent: int):
    """The smallest overlap of linked sets of a and b tokens."""
    return -(-(percent * (a + b)) // (100 + percent))


def _class_bounds(largest: int) -> np.ndarray:
    """Upper sizes of the size classes, ascending, up to one that holds the largest."""
    bounds = [1]
    while bounds[-1] < largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * STEP)))
    return np.array(bounds)


def _keys(hashes: np.ndarray, row: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of sets given as distinct (row, hash), rows ascending."""
    bounds = _class_bounds(int(sizes.max(initial=1)) * 2)
    own = np.searchsorted(bounds, sizes)
    last = np.searchsorted(bounds, sizes * 100 // percent)
    out_key, out_row = [], []
    for ahead in range(int((last - own).max(initial=0)) + 1):
        level = own + ahead
        use = (sizes > 0) & (level <= last)
        upper = bounds[np.minimum(level, len(bounds) - 1)]
        differ = 2 * upper * (100 - percent) // (100 + percent)
        spare = 1 + np.where(differ > 0, np.maximum(1, differ // 8), 0)
        parts = differ + spare
        at = use[row]
        h, r = hashes[at], row[at]
        part = (mix(h ^ np.uint64(0x51ED)) % parts[r].astype(np.uint64)).astype(np.int64)
        # Sums of mixed hashes do not depend on order.
        first = np.cumsum(parts * use) - parts * use
        total = int((parts * use).sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, first[r] + part, mix(h))
        filled = np.zeros(total, dtype=bool)
        filled[first[r] + part] = True
        rows = np.repeat(np.arange(len(sizes)), parts * use)
        empty = np.bincount(rows[~filled], minlength=len(sizes))
        kept = np.flatnonzero(filled | (empty >= spare)[rows])
        rows, sums = rows[kept], sums[kept]
        number = kept - first[rows]
        salt = mix((level[rows].astype(np.uint64) << np.uint64(32)) ^ number.astype(np.uint64))
        out_key.append(mix(sums ^ salt))
        out_row.append(rows)
    return np.concatenate(out_key), np.concatenate(out_row)


def _points(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Counts of a set's tokens by group; a set with a count beyond 16 bits gets the point that bounds nothing."""
    group = (mix(hashes ^ np.uint64(0xA11CE)) % np.uint64(GROUPS)).astype(np.int64)
    count = np.bincount(row * GROUPS + group, minlength=rows * GROUPS).reshape(rows, GROUPS)
    return np.where(count.max(axis=1, keepdims=True) > _MOST, _MOST, count).astype("<u2")


def _read_points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, GROUPS)


def _read_keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Sorted keys of each row, filled up with the largest number, which is below no key."""
    keys = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    count = np.diff(keys.offsets.to_numpy())
    out = np.full((len(keys), LEAST_KEYS), np.iinfo(np.int64).max)
    out[np.arange(LEAST_KEYS) < count[:, None]] = keys.flatten().to_numpy()
    return out


def _met_before(left: np.ndarray, right: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the sorted keys of left and right share one below key."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < key[:, None])).any(axis=1)


def _overlap_bound(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima, over the last axis; two points that bound nothing have no bound."""
    bound = np.minimum(left, right).sum(axis=-1, dtype=np.int64)
    return np.where(bound == GROUPS * _MOST, np.iinfo(np.int64).max, bound)


@lean
def _set_batches(options: JaccardOptions, chosen: np.ndarray | None = None):
    """Per text its set's size and digest, and its point; or the sorted sets of rows whose bit is chosen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chosen is not None:
                batch = batch.filter(pa.array(has(chosen, column_of(batch, "h").to_numpy().view(np.uint64))))
            ids = column_of(batch, "doc_id")
            for low, high, data, starts in pieces(column_of(batch, "text")):
                rows = high - low
                h, row = distinct(*shingles(words(data, starts), options.size))
                ends = np.searchsorted(row, np.arange(rows + 1))
                sizes = np.diff(ends)
                columns = [ids.slice(low, rows), pa.array(sizes, pa.int64()), pa.array(signed(_digests(h, ends)))]
                if chosen is not None:
                    raw = [h[ends[i] : ends[i + 1]].astype("<u8").tobytes() for i in range(rows)]
                    yield pa.RecordBatch.from_arrays([columns[2], columns[1], pa.array(raw, pa.binary())], names=["d", "n", "tokens"])
                    continue
                columns.append(pa.array([p.tobytes() for p in _points(h, row, rows)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d", "point"])
    return run


def _digests(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of each sorted set; 0 for the empty one."""
    raw = memoryview(h.astype("<u8").tobytes())
    return np.array(
        [xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j]) if j > i else 0 for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
        np.uint64,
    )


@lean
def _key_batches(options: JaccardOptions, shared: np.ndarray | None = None):
    """(key, d) of all texts; with a bit table, of keys whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts in pieces(column_of(batch, "text")):
                h, row = distinct(*shingles(words(data, starts), options.size))
                ends = np.searchsorted(row, np.arange(high - low + 1))
                key, key_row = _keys(h, row, np.diff(ends), options.percent)
                if shared is not None:
                    use = has(shared, key)
                    key, key_row = key[use], key_row[use]
                d = _digests(h, ends)[key_row]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(d))], names=["key", "d"])
    return run


def _boxes(points: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, np.ndarray, int, int]]:
    """Leaves over points in the order given: first, end, upper corner, least and largest size."""
    return [
        (i, min(i + LEAF, len(points)), points[i : i + LEAF].max(axis=0), int(sizes[i : i + LEAF].min()), int(sizes[i : i + LEAF].max()))
        for i in range(0, len(points), LEAF)
    ]


def near_points(
    left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) that the bound leaves; each side is (points, sizes, labels).

    The tree over the right side packs points by size, then by the coordinates of the heaviest spread; pairs
    with one label are left out.
    """
    points, sizes, labels = left
    spread = np.argsort(-right[0].std(axis=0), kind="stable")[:2]
    order = np.lexsort((right[0][:, spread[1]], right[0][:, spread[0]], right[1]))
    tree, tree_sizes, tree_labels = right[0][order], right[1][order], right[2][order]
    for first, end, corner, least, most in _boxes(tree, tree_sizes):
        near = np.flatnonzero((sizes * percent <= most * 100) & (least * percent <= sizes * 100))
        if not len(near):
            continue
        bound = _overlap_bound(points[near], corner)
        near = near[bound >= least_overlap(sizes[near], np.maximum(least, sizes[near] * percent // 100), percent)]
        for i in range(0, len(near), 1024):
            a = near[i : i + 1024]
            overlap = _overlap_bound(points[a][:, None, :], tree[None, first:end, :])
            fits = overlap >= least_overlap(sizes[a][:, None], tree_sizes[None, first:end], percent)
            fits &= labels[a][:, None] != tree_labels[None, first:end]
            x, y = np.nonzero(fits)
            if len(x):
                yield a[x], order[first + y]


def _small_pairs(first: np.ndarray, size: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within groups of at most largest rows: row i and the row k further on, for each k."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, min(largest, int(size.max(initial=0)))):
        use = (size <= largest) & (size > k)
        count = size[use] - k
        rows = np.repeat(first[use], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        left.append(rows)
        right.append(rows + k)
    return np.concatenate(left), np.concatenate(right)


@lean
def _tile_pairs(options: JaccardOptions):
    """Of rows sorted by (key, tile, other tile): pairs that the bound leaves, of different labels.

    Groups of one or two leaves are compared at once for many keys; larger ones through their tree. A pair whose
    least keys share a smaller one is left to that; one that shares only keys beyond those may come several times.
    """
    keys = ("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, keys):
            ids, sizes, labels, side = (table[c].to_numpy() for c in ("d", "n", "label", "side"))
            points, key, least = _read_points(table["point"]), table["key"].to_numpy(), _read_keys(table["keys"])
            first = group_starts(table, keys)
            size = np.diff(np.append(first, len(ids)))
            x, y = _small_pairs(first, size, LEAF)
            fits = (labels[x] != labels[y]) & ((side[x] != side[y]) | (side[x] == 0))
            x, y = x[fits], y[fits]
            need = least_overlap(sizes[x], sizes[y], options.percent)
            near = np.minimum(sizes[x], sizes[y]) >= need
            x, y, need = x[near], y[near], need[near]
            found = [np.zeros((0, 2), np.int64)]
            for i in range(0, len(x), 4096):
                a, b = x[i : i + 4096], y[i : i + 4096]
                fits = _overlap_bound(points[a], points[b]) >= need[i : i + 4096]
                a, b = a[fits], b[fits]
                new = ~_met_before(least[a], least[b], key[a])
                found.append(np.stack([ids[a[new]], ids[b[new]]], axis=1))
            for start, count in zip(first[size > LEAF], size[size > LEAF], strict=True):
                own = np.arange(start, start + count)
                a, b = own[side[own] <= 0], own[side[own] >= 0]
                for i, j in near_points((points[a], sizes[a], labels[a]), (points[b], sizes[b], labels[b]), options.percent):
                    i, j = a[i], b[j]
                    new = ~_met_before(least[i], least[j], key[i])
                    found.append(np.stack([ids[i[new]], ids[j[new]]], axis=1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


@lean
def _verify(options: JaccardOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(column_of(batch, "x"), column_of(batch, "y"), strict=True):
                left, right = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * both >= options.percent * (len(left) + len(right) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([column_of(batch, c).filter(keep) for c in "ab"], names=["a", "b"])
    return run


def _linked_matrix(
    left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int
) -> np.ndarray:
    """Which sets of left and right are linked, as a matrix; each side is (tokens, row of each token, sizes).

    Tokens of many sets are counted by a product of matrices of zeros and ones, those of few by listing their pairs.
    """
    (tokens, row, sizes), (others, other_row, other_sizes) = left, right
    known = np.intersect1d(tokens, others)
    overlap = np.zeros((len(sizes), len(other_sizes)))

    def held(tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by token, where each known token's start, and how many they are."""
        place = np.searchsorted(known, tokens)
        use = (np.append(known, np.uint64(0))[place] == tokens) & (place < len(known))
        place, row = place[use], row[use]
        count = np.bincount(place, minlength=len(known))
        return row[np.argsort(place, kind="stable")], np.cumsum(count) - count, count

    a, a_first, a_count = held(tokens, row)
    b, b_first, b_count = held(others, other_row)
    pairs = a_count * b_count
    many = pairs * 250 > overlap.size

    def ones(rows: np.ndarray, first: np.ndarray, count: np.ndarray, chosen: np.ndarray, height: int) -> np.ndarray:
        out = np.zeros((height, len(chosen)), np.float32)
        n = count[chosen]
        at = np.arange(int(n.sum())) + np.repeat(first[chosen] - (np.cumsum(n) - n), n)
        out[rows[at], np.repeat(np.arange(len(chosen)), n)] = 1
        return out

    dense = np.flatnonzero(many)
    for i in range(0, len(dense), 1024):
        chosen = dense[i : i + 1024]
        overlap += ones(a, a_first, a_count, chosen, len(sizes)) @ ones(b, b_first, b_count, chosen, len(other_sizes)).T
    rare = np.flatnonzero(~many)
    ends = np.cumsum(pairs[rare])
    start = 0
    while start < len(rare):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), side="right")))
        chosen = rare[start:stop]
        n = pairs[chosen]
        each = np.repeat(chosen, n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        x, y = a[a_first[each] + k // b_count[each]], b[b_first[each] + k % b_count[each]]
        overlap += np.bincount(x * len(other_sizes) + y, minlength=overlap.size).reshape(overlap.shape)
        start = stop
    return 100 * overlap >= percent * (sizes[:, None] + other_sizes[None, :] - overlap)


@lean
def _count_batches(options: JaccardOptions):
    """Of rows sorted by (group, tile, other tile): with how many sets of the other tile each set is linked."""
    keys = ("g", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, keys):
            group, d, side = (table[c].to_numpy() for c in ("g", "d", "side"))
            column = table["tokens"].combine_chunks()
            first = group_starts(table, keys)
            for start, end in zip(first, np.append(first[1:], len(d)), strict=True):
                # A set may have come from several equal texts.
                own = start + np.unique(d[start:end], return_index=True)[1]
                sets = [np.frombuffer(column[int(i)].as_buffer(), "<u8") for i in own]
                sizes = np.array([len(x) for x in sets])
                links = np.zeros(len(own), np.int64)
                below, above = np.flatnonzero(side[own] <= 0), np.flatnonzero(side[own] >= 0)

                def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    return np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), sizes[rows]), sizes[rows]

                for i in range(0, len(below) if len(above) else 0, 1024):
                    a = below[i : i + 1024]
                    linked = _linked_matrix(part(a), part(above), options.percent)
                    linked &= a[:, None] != above[None, :]
                    links[a] += linked.sum(axis=1)
                    links[above] += np.where(side[own[above]] > 0, linked.sum(axis=0), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[own]), pa.array(d[own]), pa.array(links)], names=["g", "d", "links"]
                )
    return run


def _verified(pairs: DataFrame, sets: DataFrame, options: JaccardOptions, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    both = (
        pairs.join(sets.select(F.col("d").alias("a"), F.col("tokens").alias("x")), "a")
        .join(sets.select(F.col("d").alias("b"), F.col("tokens").alias("y")), "b")
    )
    return written(both.select("a", "b", "x", "y").mapInArrow(_verify(options), "a long, b long"), name)


def _linked_within(groups: DataFrame, texts: DataFrame, options: JaccardOptions) -> DataFrame:
    """(g, d, links): with how many others of its group each set of groups (g, d, n, first_id) is linked.

    Every pair of a group meets in one task, which sends a count for each set and no pairs.
    """
    sized = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    tiles = F.ceil(F.greatest(F.col("size") / options.tile, F.col("tokens") / TILE_TOKENS)).cast("int")
    tiled = _tiled(groups.select("g", "d").join(sized.select("g", tiles.alias("tiles")), "g"), "g", "d")
    chosen = bit_table(groups.select(F.xxhash64("first_id").alias("h")), "h", BITS)
    sets = (
        texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
        .mapInArrow(_set_batches(options, chosen), "d long, n long, tokens binary")
    )
    return (
        tiled.join(sets.select("d", "tokens"), "d").repartition("g", "low", "high").sortWithinPartitions("g", "low", "high")
        .mapInArrow(_count_batches(options), "g long, d long, links long")
        .groupBy("g", "d").agg(F.sum("links").alias("links"))
    )


def _tiled(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows once for each pair of tiles (low, high) that has theirs; side tells which of the two is theirs."""
    return (
        rows.withColumn("tile", F.pmod(F.xxhash64("d"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            *columns,
            F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
            F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), -1).otherwise(1).alias("side"),
        )
    )


def _linked_classes(texts: DataFrame, options: JaccardOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Size and digest of every row's set (doc_id, n, d), its classes (d, first_id, n), and (id, root) of first_ids with links."""
    features = written(
        texts.mapInArrow(_set_batches(options), "doc_id long, n long, d long, point binary"), "sets"
    )
    classes = features.where("n > 0").groupBy("d").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("point").alias("point")
    )
    keys = texts.select("text").mapInArrow(_key_batches(options), "key long, d long")
    shared = keys.groupBy("key").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high").select("key", "low")
    shared = written(shared, "shared_keys")
    kept = texts.select("text").mapInArrow(_key_batches(options, bit_table(shared, "key", BITS)), "key long, d long")
    members = written(kept.join(shared, "key").distinct(), "members")
    met = members.select("d").distinct()
    points = written(classes.join(met, "d"), "points")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The linked pairs; sets are made for representatives in pairs, and a few others whose bits coincide."""
        pairs = written(pairs, name)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()
        chosen = bit_table(points.join(ends, "d", "left_semi").select(F.xxhash64("first_id").alias("h")), "h", BITS)
        sets = written(
            texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
            .mapInArrow(_set_batches(options, chosen), "d long, n long, tokens binary"), f"{name}_sets",
        )
        return _verified(pairs, sets, options, f"{name}_links")

    pivots = members.where("d <> low").select(F.col("low").alias("a"), F.col("d").alias("b")).distinct()
    other = points.select(F.col("d").alias("b"), F.col("point").alias("q"), F.col("n").alias("m"))
    star = pivots.join(points.select(F.col("d").alias("a"), "point", "n"), "a").join(other, "b")
    star = star.mapInArrow(_pivot_bound(options), "a long, b long")
    star_links = verified(star, "pivots")

    # Keys have different pivots, and a set linked to several of them connects these.
    label = components(star_links).toDF("d", "label")
    labelled = members.select("key", "d").join(label, "d", "left").withColumn("label", F.coalesce("label", "d"))
    several = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("l"), F.max("label").alias("h"),
        F.bit_xor("d").alias("all"), F.bit_xor(F.xxhash64("d")).alias("mixed"),
    ).where("l <> h")
    # Keys with the same members have the same pairs: one of them is compared.
    several = several.groupBy("size", "all", "mixed").agg(F.min("key").alias("key"))
    tiles = F.ceil(F.col("size") / options.tile).cast("int")
    compared = written(labelled.join(several.select("key", tiles.alias("tiles")), "key"), "compared")
    least = compared.groupBy("d").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST_KEYS).alias("keys"))
    # Points and least keys are a row's bulk and join last: they are shuffled once.
    pairs = (
        _tiled(compared, "key", "d", "label").join(points.select("d", "point", "n").join(least, "d"), "d").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(_tile_pairs(options), "a long, b long").distinct()
    )
    pair_links = verified(pairs, "pairs")

    links = star_links.union(pair_links).distinct()
    ids = points.select("d", "first_id")
    edges = links.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select("x", "y")
    return features.select("doc_id", "n", "d"), classes.select("d", "first_id", "n"), components(edges)


def _several_sets(features: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, d, n, first_id): the sets of each doc_id g whose rows have different ones."""
    full = features.where("n > 0").select("doc_id", "d")
    again = full.groupBy("doc_id").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high").select("doc_id")
    own = full.join(again, "doc_id").distinct().join(classes, "d")
    return written(own.select(F.col("doc_id").alias("g"), "d", "n", "first_id"), "several_sets")


def _with_components(features: DataFrame, classes: DataFrame, roots: DataFrame, several: DataFrame) -> DataFrame:
    """doc_id, n, d and component_id of every row; the sets of one doc_id are connected."""
    resolved = (
        classes.join(roots, F.col("first_id") == F.col("id"), "left").select("d", F.coalesce("root", "first_id").alias("root"))
    )
    if not several.isEmpty():
        own = several.select("g", "d").join(resolved, "d")
        merged = components(own.join(own.groupBy("g").agg(F.min("root").alias("least")), "g").select("least", "root"))
        resolved = (
            resolved.join(merged.toDF("root", "least"), "root", "left").select("d", F.coalesce("least", "root").alias("root"))
        )
    return features.join(resolved, "d", "left").select(
        "doc_id", "n", "d", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id")
    )


def linked_documents(documents: DataFrame, options: JaccardOptions | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links (between different
    sets) of every document."""
    options = options or JaccardOptions()
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    features, classes, roots = _linked_classes(texts, options)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    groups = written(
        classes.join(roots.join(sizes, "root"), F.col("first_id") == F.col("id")).select(F.col("root").alias("g"), "d", "n", "first_id", "size"),
        "groups",
    )
    # Both sets of a component of two have the one link.
    several = _linked_within(groups.where("size > 2"), texts, options).select("d", "links")
    degree = groups.where("size = 2").select("d", F.lit(1).cast("long").alias("links")).union(several).withColumnRenamed("links", "n_links")
    own = _several_sets(features, classes)
    found = (
        _with_components(features, classes, roots, own).join(degree, "d", "left")
        .groupBy("doc_id").agg(
            F.max("n").alias("n_shingles"),
            F.min("component_id").alias("component_id"),
            F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"),
        )
    )
    if own.isEmpty():
        return found
    # A link between two sets of one document is in the degree of both.
    inner = _linked_within(own, texts, options).groupBy("g").agg(F.sum("links").alias("twice"))
    union = (
        own.join(degree, "d", "left").groupBy("g").agg(F.sum(F.coalesce("n_links", F.lit(0))).alias("all"))
        .join(inner, "g").select(F.col("g").alias("doc_id"), F.expr("all - twice div 2").alias("united"))
    )
    return found.join(union, "doc_id", "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("united", "n_links").alias("n_links")
    )


@lean
def _pivot_bound(options: JaccardOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = _read_points(column_of(batch, "point")), _read_points(column_of(batch, "q"))
            n, m = column_of(batch, "n").to_numpy(), column_of(batch, "m").to_numpy()
            keep = pa.array(_overlap_bound(p, q) >= least_overlap(n, m, options.percent))
            yield pa.RecordBatch.from_arrays([column_of(batch, c).filter(keep) for c in "ab"], names=["a", "b"])
    return run


def one_of_each_group(documents: DataFrame, options: JaccardOptions | None = None) -> DataFrame:
    """The document of the smallest doc_id of each component; of rows with one doc_id, one; all rows without id."""
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    features, classes, roots = _linked_classes(texts, options or JaccardOptions())
    rows = _with_components(features, classes, roots, _several_sets(features, classes))
    found = written(rows.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "components")
    kept = without_ids(documents, found.where("doc_id <> component_id"))
    again = written(documents.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return without_ids(kept, again).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
