"""Examples: slices of the grid and of the sequence, assembled to nested columns per region."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from genotiles.functions.arrays import one_hot_arrow
from genotiles.functions.memory import lean
from genotiles.operators.binning import TILE_BINS

CHUNK_BASES = 65_536


def _touched_tiles(regions: DataFrame, n_bins: int, bin_size: int, tile_bins: int) -> DataFrame:
    return regions.withColumn("__from", F.expr(f"sig_start div {bin_size}")).withColumn(
        "tile",
        F.explode(F.expr(
            f"sequence(__from div {tile_bins}, (__from + {n_bins - 1}) div {tile_bins})"
        )),
    )


def label_bins(
    regions: DataFrame, bins: DataFrame, n_bins: int, bin_size: int, tile_bins: int = TILE_BINS
) -> DataFrame:
    """Long labels ``(index, track, bin, mean)``: the grid bins under each region, covered ones only.

    The slice starts at the grid bin that holds ``sig_start``. Bins outside the grid read as 0, that
    is, they have no row here.
    """
    slices = _touched_tiles(regions.select("index", "chrom", "sig_start"), n_bins, bin_size, tile_bins)
    return (
        slices.join(bins, ["chrom", "tile"])
        .withColumn("__position", F.col("bin") - F.col("__from"))
        .where((F.col("__position") >= 0) & (F.col("__position") < n_bins))
        .select("index", "track", F.col("__position").alias("bin"), "mean")
    )


def _dense(entries: str, size: Column | int, fill: Column) -> Column:
    """Array of ``size`` from a column of (i, v) structs sorted by ``i``; an entry brings its gap along."""
    length = size if isinstance(size, Column) else F.lit(size)
    found = F.col(entries)
    gap = lambda n: F.array_repeat(fill, n.cast("int"))
    following = lambda k: F.coalesce(F.get(found, k + 1)["i"], length)
    filled = F.transform(
        found, lambda e, k: F.concat(F.array(e["v"]), gap(following(k) - e["i"] - 1))
    )
    spaced = F.concat(gap(F.coalesce(F.get(found, F.lit(0))["i"], length)), F.flatten(filled))
    return F.when(F.size(found) == length, found["v"]).otherwise(spaced)


def signal_tiles(bins: DataFrame, n_tracks: Column, tile_bins: int = TILE_BINS) -> DataFrame:
    """One matrix ``vals [T][tile_bins]`` per (chrom, tile) from long bins, such as those of ``last_wins_bins``.

    The grid's own matrices come from ``binning.grid_tiles``, without long bins. ``bins.track`` is the dense track index. Spark brings the cells of a tile together, sorted; a task
    then fills many matrices per Arrow batch. A tile is bounded by tracks x tile_bins, because its bins
    are distinct.
    """
    cells = bins.select(
        "chrom", F.col("tile").cast("bigint"), F.col("track").cast("bigint"), F.col("bin").cast("bigint"),
        F.col("mean").cast("float"), n_tracks.cast("bigint").alias("n_tracks"),
    )
    together = cells.repartition("chrom", "tile").sortWithinPartitions("chrom", "tile")
    return together.mapInArrow(_fill_tiles(tile_bins), "chrom string, tile bigint, vals array<array<float>>")


# Cells per output batch of the tile filler (64 MB of floats).
MAX_BATCH_CELLS = 1 << 24


def _group_starts(chrom: pa.Array, tile: np.ndarray) -> np.ndarray:
    """Rows at which another (chrom, tile) begins, row 0 left out."""
    if len(tile) < 2:
        return np.empty(0, dtype=np.int64)
    other = pc.not_equal(chrom[1:], chrom[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(other | (tile[1:] != tile[:-1])) + 1


def _fill_tiles(tile_bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: sorted cells to matrices. The last tile of a batch stays open until the next one."""

    def matrices(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        column = {name: rows[name].to_numpy() for name in ("tile", "track", "bin", "mean", "n_tracks")}
        chrom = rows["chrom"].combine_chunks()
        starts = np.concatenate([[0], _group_starts(chrom, column["tile"])]).astype(np.int64)
        ends = np.append(starts[1:], rows.num_rows)
        tracks = int(column["n_tracks"][0])
        width = tracks * tile_bins
        place = column["track"] * tile_bins + column["bin"] - column["tile"] * tile_bins
        step = max(1, MAX_BATCH_CELLS // width)
        for first in range(0, len(starts), step):
            own, until = starts[first:first + step], ends[first:first + step]
            lo, hi = own[0], until[-1]
            matrix = np.zeros((len(own), width), dtype=np.float32)
            matrix[np.repeat(np.arange(len(own)), until - own), place[lo:hi]] = column["mean"][lo:hi]
            lists = pa.ListArray.from_arrays(
                np.arange(len(own) * tracks + 1, dtype=np.int32) * tile_bins, pa.array(matrix.reshape(-1))
            )
            nested = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * tracks, lists)
            yield pa.RecordBatch.from_arrays(
                [chrom.take(pa.array(own)), pa.array(column["tile"][own]), nested], names=["chrom", "tile", "vals"]
            )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last_key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chrom, tile = batch.column("chrom"), batch.column("tile").to_numpy()
            starts = _group_starts(chrom, tile)
            if last_key is not None and (chrom[0].as_py(), tile[0]) != last_key:
                starts = np.concatenate([[0], starts])
            if len(starts):
                cut = int(starts[-1])
                yield from matrices([*waiting, batch.slice(0, cut)])
                waiting = [batch.slice(cut)]
            else:
                waiting.append(batch)
            last_key = (chrom[batch.num_rows - 1].as_py(), tile[-1])
        if waiting:
            yield from matrices(waiting)

    return fill


def nested_labels(
    regions: DataFrame,
    tiles: DataFrame,
    n_tracks: Column,
    n_bins: int,
    bin_size: int,
    tile_bins: int = TILE_BINS,
) -> DataFrame:
    """``(index, labels)`` with labels ``[T][B]`` cut out of the tiles.

    A region is exploded to the few tiles it touches, never to bins or tracks; every joined row carries
    one slice of the matrix. Tiles without any value are zero. Tracks in an array column ``flipped`` of the
    regions, if there is one, are negated.
    """
    flipped = ["flipped"] if "flipped" in regions.columns else []
    slices = _touched_tiles(regions.select("index", "chrom", "sig_start", *flipped), n_bins, bin_size, tile_bins)
    tile_start = F.col("tile") * tile_bins
    low = F.greatest(F.col("__from"), tile_start)
    high = F.least(F.col("__from") + n_bins, tile_start + tile_bins)
    slices = slices.withColumns({
        "__skip": (low - tile_start + 1).cast("int"), "__n": (high - low).cast("int"), "n_tracks": n_tracks,
    })
    cut = F.transform("vals", lambda row: F.slice(row, F.col("__skip"), F.col("__n")))
    empty = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), F.col("__n")), F.col("n_tracks"))
    pieces = slices.join(tiles, ["chrom", "tile"], "left").select(
        "index", "n_tracks", *flipped, "tile", F.coalesce(cut, empty).alias("piece")
    )
    # A window touches at most n_bins / tile_bins + 2 tiles, so a group is the example itself.
    grouped = pieces.groupBy("index").agg(
        F.first("n_tracks").alias("n_tracks"), *(F.first(c).alias(c) for c in flipped),
        F.array_sort(F.collect_list(F.struct("tile", "piece")))["piece"].alias("pieces"),
    )
    joined = F.transform(
        F.sequence(F.lit(0), F.col("n_tracks") - 1),
        lambda t: F.flatten(F.transform("pieces", lambda piece: F.get(piece, t))),
    )
    labels = F.when(F.size("pieces") == 1, F.get("pieces", F.lit(0))).otherwise(joined)
    if not flipped:
        return grouped.select("index", labels.alias("labels"))
    negated = F.transform(
        "labels", lambda row, t: F.when(F.array_contains("flipped", t), F.transform(row, lambda x: -x)).otherwise(row)
    )
    whole = grouped.select("index", "flipped", labels.alias("labels"))
    return whole.select("index", F.when(F.size("flipped") > 0, negated).otherwise(F.col("labels")).alias("labels"))


def assemble_tracks(regions: DataFrame, rows: DataFrame, n_tracks: Column, n_bins: int) -> DataFrame:
    """``(index, labels)`` for every region from rows ``(index, track, vals)``; absent tracks are zero."""
    entry = F.struct(F.col("track").cast("int").alias("i"), F.col("vals").alias("v"))
    # One entry per track: the group is the example itself.
    found = rows.groupBy("index").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    empty_row = F.array_repeat(F.lit(0.0).cast("float"), n_bins)
    none = F.array().cast("array<struct<i:int,v:array<float>>>")
    return (
        regions.select("index")
        .join(found, "index", "left")
        .select("index", F.coalesce("entries", none).alias("entries"), n_tracks.alias("n_tracks"))
        .select("index", _dense("entries", F.col("n_tracks"), empty_row).alias("labels"))
    )


def nested_from_long(long: DataFrame, keys: Sequence[str], n_bins: int, value: str = "mean") -> DataFrame:
    """``(keys..., track, vals)`` from long rows with at most ``n_bins`` distinct bins per group."""
    entry = F.struct(F.col("bin").cast("int").alias("i"), F.col(value).cast("float").alias("v"))
    grouped = long.groupBy(*keys, "track").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return grouped.select(
        *keys, "track", _dense("entries", n_bins, F.lit(0.0).cast("float")).alias("vals")
    )


# Bytes of chunks that a task hands on at once, about.
CUT_BYTES = 4 << 20


@lean
def _cut(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: texts to their pieces of ``chunk`` characters. Bytes that are no UTF-8 count as a character each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chrom, texts = batch.column("chrom"), batch.column("seq").cast(pa.binary())
            row: list[int] = []
            number: list[int] = []
            pieces: list[bytes] = []
            size = 0
            for i in range(batch.num_rows):
                letters = texts[i].as_py().decode("utf-8", "surrogateescape")
                for k, low in enumerate(range(0, len(letters), chunk)):
                    pieces.append(letters[low:low + chunk].encode("utf-8", "surrogateescape"))
                    row.append(i)
                    number.append(k)
                    size += len(pieces[-1])
                    if size >= CUT_BYTES:
                        yield chunks_of(chrom, row, number, pieces)
                        row, number, pieces, size = [], [], [], 0
            if pieces:
                yield chunks_of(chrom, row, number, pieces)

    def chunks_of(chrom: pa.Array, row: list[int], number: list[int], pieces: list[bytes]) -> pa.RecordBatch:
        columns = [chrom.take(pa.array(row)), pa.array(number, pa.int64()), pa.array(pieces, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["chrom", "chunk_no", "seq"])

    return run


def chunk_sequences(sequences: DataFrame, chunk: int = CHUNK_BASES) -> DataFrame:
    """Cut whole contig strings ``(chrom, seq)`` into numbered chunks.

    Spark finds a substring by counting characters from the start, so its chunks would cost with the square of a contig;
    tasks cut a text in one pass.
    """
    texts = sequences.select("chrom", "seq").where(F.col("seq") != "")
    return texts.mapInArrow(_cut(chunk), StructType([texts.schema["chrom"], StructField("chunk_no", LongType()), texts.schema["seq"]]))


def contigs_from_chunks(chunks: DataFrame) -> DataFrame:
    """Contig lengths from the chunk table."""
    return chunks.groupBy("chrom").agg(F.sum(F.length("seq")).cast("bigint").alias("len"))


def fetch_sequence(
    windows: DataFrame,
    chunks: DataFrame,
    context_length: int,
    *,
    key: Sequence[str] = ("index",),
    chunk: int = CHUNK_BASES,
) -> DataFrame:
    """``(key..., seq)``: the context of each window, padded with ``N`` to ``context_length``.

    ``windows`` carries ``chrom, read_start, read_end, left_pad``. Each window is exploded to the
    chunks it touches and joined on (chrom, chunk_no). A window without any base is all ``N``.
    """
    wanted = windows.select(*key, "chrom", "read_start", "read_end", "left_pad").withColumn(
        "chunk_no",
        F.explode_outer(F.when(
            F.col("read_end") > F.col("read_start"),
            F.expr(f"sequence(read_start div {chunk}, (read_end - 1) div {chunk})"),
        )),
    )
    lo = F.greatest(F.col("read_start") - F.col("chunk_no") * chunk, F.lit(0))
    hi = F.least(F.col("read_end") - F.col("chunk_no") * chunk, F.lit(chunk))
    piece = F.substring(F.col("seq"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    # A group is at most context_length / chunk + 2 pieces.
    pieces = wanted.join(chunks, ["chrom", "chunk_no"], "left").groupBy(*key).agg(
        F.first("left_pad").alias("left_pad"),
        F.array_sort(F.collect_list(F.struct("chunk_no", piece.alias("piece"))))["piece"].alias("pieces"),
    )
    # A contig that is known but has no chunk yields NULL pieces; array_join leaves them out.
    body = F.array_join("pieces", "")
    left = F.repeat(F.lit("N"), F.least(F.col("left_pad"), F.lit(context_length)).cast("int"))
    return pieces.select(*key, F.rpad(F.concat(left, body), F.lit(context_length), F.lit("N")).alias("seq"))


def encode_sequences(rows: DataFrame, out: str = "input_ids") -> DataFrame:
    """Replace ``seq`` by its 4 x L one-hot array; the last step of a build."""
    return rows.withColumn(out, one_hot_arrow("seq")).drop("seq")


def example_means(examples: DataFrame) -> DataFrame:
    """Per example and track the mean over bins, from nested labels only (one pass, no shuffle)."""
    return examples.select("index", F.posexplode("labels").alias("track", "vals")).select(
        "index", "track",
        (
            F.aggregate("vals", F.lit(0.0), lambda total, v: total + v.cast("double"))
            / F.size("vals")
        ).alias("mean"),
    )


def long_means(bins: DataFrame, n_bins: int) -> DataFrame:
    """Per example and track the mean over all ``n_bins`` bins, from long covered bins."""
    return bins.groupBy("index", "track").agg((F.sum("mean") / F.lit(float(n_bins))).alias("mean"))
