"""Files of examples: written by tasks from flat buffers, whole or not at all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from genotiles.functions.arrays import one_hot_numpy
from genotiles.operators import examples as X
from genotiles.plans import build as B
from genotiles.session import spread_scan
from genotiles.sinks import examples as XS, files as XF
from genotiles.sources import examples as XR

KEY = ["split", "index", "local_index", "interval", "labels", "input_ids"]


def placed(spark, n=50, ranges=3):
    """Examples with a place: sequences as strings, unlike splits, rows of a range out of order."""
    letters = F.element_at(F.array(*map(F.lit, "acgtN")), (F.pmod(F.col("id") * 7, F.lit(5)) + 1).cast("int"))
    split = F.when(F.col("id") % 3 == 0, "a b/é%").when(F.col("id") % 3 == 1, "train").otherwise("x=[y]")
    label = lambda t, b: (F.col("id") * 10 + t * 3 + b).cast("float")
    labels = F.array(*(F.array(*(label(t, b) for b in range(3))) for t in range(2)))
    place = F.shiftleft((F.col("id") % ranges).cast("bigint"), XS.PLACE_BITS) + F.col("id")
    return spark.range(n).select(
        split.alias("split"), F.lit("c").alias("chrom"), F.col("id").alias("index"), F.col("id").alias("local_index"),
        F.concat(F.lit("c:"), "id").alias("interval"), F.concat(letters, F.lit("ACGTx")).alias("seq"), labels.alias("labels"), place.alias("place"),
    )


def files_of(root):
    return sorted(p for p in root.rglob("*.parquet") if p.is_file())


@pytest.mark.parametrize(("group", "batch"), [(1, 1), (600, 1 << 20), (1 << 20, 100)])
def test_written_and_rewritten_rows_are_the_given_ones(spark, tmp_path, monkeypatch, group, batch):
    monkeypatch.setattr(XF, "GROUP_BYTES", group)
    monkeypatch.setattr(XF, "BATCH_BYTES", batch)
    given, root, target = placed(spark), str(tmp_path / "d"), str(tmp_path / "r")
    XS.write_examples(given, root, rows_per_file=4, codec="lz4", n_ranges=3)
    wanted = given.collect()
    found = {r["index"]: r for r in XR.read_examples(spark, root).collect()}
    assert len(found) == len(wanted)
    for r in wanted:
        got = found[r["index"]]
        assert (got["split"], got["local_index"], got["interval"], got["labels"]) == (r["split"], r["local_index"], r["interval"], r["labels"])
        np.testing.assert_array_equal(np.array(got["input_ids"]), one_hot_numpy(r["seq"]))
    # As Spark names them.
    by_spark = tmp_path / "s"
    given.select("split", "index").write.partitionBy("split").parquet(str(by_spark))
    assert {p.name for p in (tmp_path / "d" / "examples").glob("split=*")} == {p.name for p in by_spark.glob("split=*")}
    for folder, limit in ((tmp_path / "d", 4), (tmp_path / "r", 3)):
        if folder.name == "r":
            XS.rewrite_dataset(spark, root, target, rows_per_file=3)
        names = files_of(folder)
        assert max(pq.read_metadata(p).num_rows for p in names) == limit
        assert all("arrow" in pq.read_metadata(p).created_by for p in names), "written from flat buffers"
        for p in names:
            order = pq.ParquetFile(p).read(columns=["index"])["index"].to_pylist()
            assert order == sorted(order) and (folder.name == "r" or len({i % 3 for i in order}) == 1)
    kinds = {pq.read_metadata(p).row_group(0).column(3).compression for p in files_of(tmp_path / "r")}
    assert kinds == {"ZSTD"}
    assert rows(XR.read_examples(spark, target), *KEY) == rows(XR.read_examples(spark, root), *KEY)
    assert XF.partition_folder("split", None) == XF.partition_folder("split", "") == "split=__HIVE_DEFAULT_PARTITION__"


def test_small_files_become_larger_ones(spark, tmp_path):
    root, target = str(tmp_path / "d"), str(tmp_path / "r")
    XS.write_examples(placed(spark, 60, 2), root, rows_per_file=1, n_ranges=2)
    XS.rewrite_dataset(spark, root, target)
    assert len(files_of(tmp_path / "d")) == 60 and len(files_of(tmp_path / "r")) < 30
    assert XR.read_examples(spark, target).count() == 60


def test_a_job_that_fails_leaves_the_splits_as_they_were(spark, tmp_path):
    root = str(tmp_path / "d")
    XS.write_examples(placed(spark), root, rows_per_file=4, n_ranges=3)
    before = files_of(tmp_path / "d")
    broken = placed(spark).withColumn("interval", F.when(F.col("index") == 47, F.raise_error(F.lit("no interval")).cast("string")).otherwise(F.col("interval")))
    with pytest.raises(Exception, match="no interval"):
        XS.write_examples(broken, root, rows_per_file=4, n_ranges=3)
    assert files_of(tmp_path / "d") == before and not list((tmp_path / "d" / "examples").glob("_new*"))
    XS.write_examples(placed(spark).where("split = 'train'").limit(5), root, rows_per_file=4, n_ranges=3)
    kept = {r["split"]: r["n"] for r in XR.read_examples(spark, root).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert kept["train"] == 5 and sum(kept.values()) == 5 + 50 - 17, "the other splits stay"


def test_an_attempt_cut_short_leaves_no_part_of_a_file(tmp_path):
    table = pa.table({"index": list(range(10)), "labels": [[[1.0]]] * 10})
    cut = XF.RolledFiles(str(tmp_path), "part-0", 4, {})
    cut.add(table.slice(0, 6))
    cut._write_group()
    assert sum(not p.name.startswith("_") for p in tmp_path.iterdir()) == 1
    for _ in range(2):
        again = XF.RolledFiles(str(tmp_path), "part-0", 4, {})
        for low in range(0, 10, 3):
            again.add(table.slice(low, 3))
        again.close()
    names = sorted(p for p in tmp_path.iterdir() if not p.name.startswith("_"))
    assert [pq.read_metadata(p).num_rows for p in names] == [4, 4, 2]
    assert sum((pq.ParquetFile(p).read()["index"].to_pylist() for p in names), []) == list(range(10))


def test_a_file_without_a_column_and_with_narrower_numbers(tmp_path):
    pq.write_table(pa.table({"index": pa.array([1, 2], pa.int32()), "more": ["x", "y"]}), tmp_path / "f.parquet")
    schema = pa.schema([("index", pa.int64()), ("labels", pa.list_(pa.list_(pa.float32())))])
    found = pa.concat_tables(XF._rows_of(str(tmp_path / "f.parquet"), schema))
    assert found.schema == schema and found.to_pylist() == [{"index": 1, "labels": None}, {"index": 2, "labels": None}]


def test_rewriting_counts_the_rows_that_stand_in_the_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "d")
    XS.write_examples(placed(spark), root, rows_per_file=4, n_ranges=3)
    found = {r["path"]: r["n_rows"] for r in XS.counted_files(XS.list_files(spark, XR.examples_path(root))).collect()}
    assert found == {str(p): pq.read_metadata(p).num_rows for p in files_of(tmp_path / "d")}
    report = XS.rewrite_dataset(spark, root, str(tmp_path / "r")).collect()
    for r in report:
        for side, folder in (("bytes_before", "d"), ("bytes_after", "r")):
            names = files_of(tmp_path / folder)
            assert r[side] == sum(p.stat().st_size for p in names if p.parent.name == f"split={r['split']}")
    whole = XF._rows_of
    monkeypatch.setattr(XF, "_rows_of", lambda path, schema: list(whole(path, schema))[:-1])
    with pytest.raises(RuntimeError, match="does not hold the rows"):
        XS.rewrite_dataset(spark, root, str(tmp_path / "short"))


def test_chunks_are_cut_by_characters_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(X, "CUT_BYTES", 50)
    texts = {"a": "ACGT" * 30 + "A", "b": "é€😀x" * 25, "c": "ACG", "d": "ACGTACG", "e": ""}
    frame = spark.createDataFrame([*texts.items(), ("n", None), (None, "ACGTACGT")], "chrom string, seq string")
    bad = spark.range(1).select(F.lit("bad").alias("chrom"), F.expr("cast(X'41FF43474180' as string)").alias("seq"))
    chunks = X.chunk_sequences(frame.union(bad), 7)
    found = rows(chunks.where("chrom NOT IN ('bad')"))
    assert found == sorted((k, i // 7, v[i:i + 7]) for k, v in texts.items() for i in range(0, len(v), 7))
    assert rows(chunks.where("chrom IS NULL").select("chunk_no", "seq")) == [(0, "ACGTACG"), (1, "T")]
    assert chunks.where("chrom = 'bad'").select(F.hex(F.col("seq").cast("binary"))).collect() == [("41FF43474180",)]
    assert "substring" not in chunks._jdf.queryExecution().executedPlan().toString()


def test_rows_of_few_row_groups_are_spread(spark, tmp_path):
    width, old = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    table = pa.table({"index": np.random.default_rng(1).integers(0, 1 << 40, 100_000)})
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        for groups, spread in ((1, True), (50, False)):
            pq.write_table(table, tmp_path / f"{groups}.parquet", row_group_size=100_000 // groups)
            scan = spark.read.parquet(str(tmp_path / f"{groups}.parquet"))
            assert scan.rdd.getNumPartitions() >= width
            found = spread_scan(scan)
            filled = found.groupBy(F.spark_partition_id()).count().count()
            assert filled >= width // 2 and (found is not scan) == spread
            assert found.agg(F.sum("index")).first() == scan.agg(F.sum("index")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_build_asks_for_contigs_and_tracks_once(spark, tmp_path):
    def counting(frame, seen):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return frame.mapInArrow(count, frame.schema)

    regions = spark.range(40).selectExpr("id AS index", "'c' || id % 5 AS chrom", "id * 3 AS start_pos", "id * 3 + 32 AS end_pos", "'fold' || id % 8 AS fold")
    sequences = spark.range(5).selectExpr("'c' || id AS chrom", "id AS chrom_rank", "repeat('ACGT', 100) AS seq", "400L AS len")
    signal = spark.range(100).selectExpr("cast(id % 2 AS int) AS track", "'c' || id % 5 AS chrom", "id * 3 AS start_pos", "id * 3 + 9 AS end_pos", "cast(id AS double) AS value")
    tracks = spark.createDataFrame([(0, "a.bw", False), (1, "b_minus.bw", True)], "track int, path string, is_minus boolean")
    of_contigs, of_tracks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    options = B.BuildOptions(geometry=B.Geometry(context_length=64, n_pred_bins=4, bin_size=8), tile_bins=4, chunk_bases=50)
    root = str(tmp_path / "d")
    B.build_dataset(
        root, regions, signal, counting(tracks, of_tracks), counting(sequences.drop("seq"), of_contigs),
        X.chunk_sequences(sequences.select("chrom", "seq"), 50), options,
    )
    assert XR.read_examples(spark, root).count() == 40
    assert (of_contigs.value, of_tracks.value) == (5, 2)
