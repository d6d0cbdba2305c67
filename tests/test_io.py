from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from genotiles.functions.arrays import one_hot_numpy
from genotiles.operators import augment, examples as X, regions as R, tracks as T
from genotiles.operators.sampling import first_rows, random_sample, stride_sample
from genotiles.plans import build as B
from genotiles.plans.scale import original_scaling, tmm_scaling
from genotiles.schemas import DEFAULT_SPLITS
from genotiles.sinks import examples as XS, tables as TS
from genotiles.sources import examples as XR, intervals as I, sequences as Q, tracks as TR
from genotiles.streaming import examples as SX, metrics as SM

GEOMETRY = B.Geometry(context_length=64, n_pred_bins=4, bin_size=8, shift_max_bp=8)
BED = "# header\nchrA\t0\t32\tfold0\n\nchrB\t100\t132\tfold3\nchrA\t200\t232\n  \nchrB\t40\t72\tfold1\n"


def text(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_labelled_bed_plain_and_gzip(spark, tmp_path):
    expected = [(0, "chrA", 0, 32, "fold0"), (1, "chrB", 100, 132, "fold3"), (2, "chrA", 200, 232, ""), (3, "chrB", 40, 72, "fold1")]
    assert rows(I.read_labelled_bed(spark, text(tmp_path, "r.bed", BED))) == expected
    packed = tmp_path / "r.bed.gz"
    packed.write_bytes(gzip.compress(BED.encode()))
    assert rows(I.read_labelled_bed(spark, str(packed))) == expected


def test_positions_follow_the_file_over_many_splits(spark, tmp_path):
    path = text(tmp_path, "big.bed", "".join(f"c\t{i}\t{i + 1}\tfold{i % 8}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        found = I.read_labelled_bed(spark, path)
        assert found.where("index != start_pos").count() == 0 and found.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_target_bed_and_chrom_sizes(spark, tmp_path):
    bed = "track x\nbrowser y\n#c\nchr1\t5\t9\textra\nchr2 7  11\nchr3\t1\n"
    assert rows(I.read_target_bed(spark, text(tmp_path, "t.bed", bed))) == [(0, "chr1", 5, 9), (1, "chr2", 7, 11)]
    sizes = "# sizes\nchr1\t1000\nchr2 500\nchr1\t1001\nbroken\n"
    assert rows(I.read_chrom_sizes(spark, text(tmp_path, "s.sizes", sizes))) == [("chr1", 0, 1001), ("chr2", 1, 500)]
    with pytest.raises(ValueError):
        I.read_chrom_sizes(spark, text(tmp_path, "empty.sizes", "# nothing\n"))
    index = text(tmp_path, "g.fai", "chrA\t300\t6\t60\t61\nchrB\t7\t9\t60\t61\n")
    assert rows(I.read_sequence_index(spark, index)) == [("chrA", 0, 300), ("chrB", 1, 7)]
    with pytest.raises(Exception, match="short sequence index"):
        I.read_sequence_index(spark, text(tmp_path, "bad.fai", "chrA\t300\n")).collect()


@pytest.mark.parametrize("split_bytes", ["16384", "134217728"])
def test_fasta_over_file_splits(spark, tmp_path, split_bytes):
    rng = np.random.default_rng(0)
    genome = {f"c{i}": "".join(rng.choice(list("ACGTNacgt"), n)) for i, n in enumerate([50_000, 3, 80, 61, 30_000])}
    lines = []
    for name, seq in genome.items():
        lines += [f">{name} description"] + [seq[i:i + 61] for i in range(0, len(seq), 61)]
    path = text(tmp_path, "g.fa", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        chunks = Q.read_fasta(spark, path, 1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, seq in genome.items():
        own = sorted((r["chunk_no"], r["seq"]) for r in chunks if r["chrom"] == name)
        assert "".join(s for _, s in own) == seq
        assert all(len(s) == 1000 for _, s in own[:-1])
    lengths = X.contigs_from_chunks(spark.createDataFrame(chunks))
    assert rows(lengths) == sorted((n, len(s)) for n, s in genome.items())


def test_fasta_contigs_go_on_from_block_to_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_LINES", 4)
    genome = {"one": "ACGTN" * 41, "two": "", "three": "GGC", "four": "TTACG" * 30, "five": "A"}
    lines = "".join(f">{n} x\n" + "".join(s[i:i + 10] + "\n" for i in range(0, len(s), 10)) for n, s in genome.items())
    found = rows(Q.read_fasta(spark, text(tmp_path, "blocks.fa", lines), 32))
    assert found == sorted((n, i // 32, s[i:i + 32]) for n, s in genome.items() for i in range(0, len(s), 32))


def test_track_listing_and_metadata(spark, tmp_path):
    folder = tmp_path / "bw"
    folder.mkdir()
    for name, content in (("b.bw", "same"), ("a.bw", "same"), ("c.bw", "more"), ("x.txt", "")):
        (folder / name).write_text(content)
    found = TR.tracks_in_folder(spark, str(folder))
    assert [(r["source_index"], r["path"].rsplit("/")[-1]) for r in found.orderBy("source_index").collect()] == [(0, "a.bw"), (1, "b.bw"), (2, "c.bw")]
    with pytest.raises(ValueError):
        TR.tracks_in_folder(spark, str(folder), "*.bigWig")
    asked = TR.requested_tracks(spark, [f' "{folder}/a.bw" ', f"{folder}/gone.bw", f"{folder}/b.bw", f"{folder}/a.bw"])
    listed = TR.list_files(spark, str(folder), content=True)
    assert rows(T.missing_tracks(asked, listed), "source_index") == [(1,)]
    kept = TR.identify(T.existing_tracks(asked, listed, drop_missing=True))
    mapped = T.dedupe_map(kept, "content")
    assert rows(T.final_tracks(mapped, "content"), "track_index", "source_index") == [(0, 0)]
    with pytest.raises(FileNotFoundError):
        TR.read_metadata(spark, str(tmp_path))
    (tmp_path / "track_metadata.json").write_text(json.dumps({"bin_size": 32, "track_records": [{"track_index": 0}, {"track_index": 1}]}, indent=1))
    document = TR.read_metadata(spark, str(tmp_path))
    assert document.first()["bin_size"] == 32 and rows(TR.track_records(document)) == [(0,), (1,)]
    with pytest.raises(ValueError):
        TR.track_records(document.drop("track_records"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_scale_factor_tables(spark, tmp_path, fmt):
    tracks = spark.createDataFrame([(1, 5e6, "s1"), (0, 2e6, "s0")], "track_index int, library_size double, samplename string")
    path = str(tmp_path / f"factors.{fmt}")
    TS.write_scale_factors(original_scaling(tracks, 32), path, fmt)
    table = TR.read_scale_factors(spark, path, ["library_size"])
    assert table.columns[:4] == ["track_index", "scale_factor", "clip_soft", "clip_hard"]
    assert rows(table, "track_index", "clip_hard", "samplename") == [(0, 32.0, "s0"), (1, 80.0, "s1")]
    with pytest.raises(ValueError):
        TR.read_scale_factors(spark, path, ["nothing"])
    with pytest.raises(ValueError):
        TS.write_scale_factors(tracks, path, "xml")


def inputs(spark, tmp_path):
    rng = np.random.default_rng(3)
    genome = {"chrA": "".join(rng.choice(list("ACGT"), 400)), "chrB": "".join(rng.choice(list("ACGTN"), 250)), "tiny": "ACG"}
    fasta = "".join(f">{n}\n{s}\n" for n, s in genome.items())
    bed = "".join(f"{c}\t{s}\t{s + 32}\tfold{i % 8}\n" for i, (c, s) in enumerate(
        [(c, s) for s in range(0, 360, 24) for c in ("chrA", "chrB")])) + "tiny\t0\t2\tfold0\nnone\t0\t20\tfold0\n"
    folder = tmp_path / "signal"
    folder.mkdir(parents=True)
    data = {}
    for t, name in enumerate(("a_plus.bedGraph", "b_minus.bedGraph")):
        lines = []
        for chrom, seq in genome.items():
            for at in range(0, len(seq) - 5, 5):
                value = float(np.float32(rng.normal(5, 1)) * (-1 if "minus" in name else 1))
                data[(t, chrom, at)] = value
                lines.append(f"{chrom}\t{at}\t{at + 5}\t{value!r}")
        (folder / name).write_text("track type=bedGraph\n" + "\n".join(lines) + "\n")
    tracks = T.with_minus_flag(spark.createDataFrame(
        [(0, f"{folder}/a_plus.bedGraph"), (1, f"{folder}/b_minus.bedGraph")], "track_index int, path string"))
    tracks = tracks.withColumn("track", F.col("track_index")).withColumn("resolved_path", F.col("path"))
    signal = I.read_bedgraph(spark, str(folder), tracks)
    chunks = Q.read_fasta(spark, text(tmp_path, "g.fa", fasta), 50)
    contigs = X.contigs_from_chunks(chunks)
    return I.read_labelled_bed(spark, text(tmp_path, "r.bed", bed)), signal, tracks, contigs, chunks, genome, data


def options(strategy="grid", splits=None):
    return B.BuildOptions(geometry=GEOMETRY, splits=splits or {**DEFAULT_SPLITS, "all": []}, strategy=strategy, tile_bins=4, chunk_bases=50)


def test_build_end_to_end(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, genome, data = inputs(spark, tmp_path)
    root = str(tmp_path / "dataset")
    built = B.build_dataset(root, regions, signal, tracks, contigs, chunks, options(), rows_per_file=3)
    assert built == ["train", "validation", "test", "all"]
    found = XR.read_examples(spark, root).collect()
    bed = {r["index"]: r for r in regions.collect()}
    assert {r["index"] for r in found if r["split"] == "all"} == {i for i, r in bed.items() if r["chrom"] in ("chrA", "chrB")}
    for r in found:
        region = bed[r["index"]]
        assert r["interval"] == f"{region['chrom']}:{region['start_pos']}-{region['end_pos']}"
        middle = (region["start_pos"] + region["end_pos"]) // 2
        padded = "N" * 100 + genome[region["chrom"]] + "N" * 500
        context = padded[100 + middle - 40:100 + middle + 40]
        np.testing.assert_array_equal(np.array(r["input_ids"]), one_hot_numpy(context))
        first = max(0, middle - 16 - 8) // 8
        usable = len(genome[region["chrom"]]) // 8
        for t in range(2):
            bins = []
            for b in range(first, first + 6):
                covered = [data[(t, region["chrom"], p // 5 * 5)] for p in range(b * 8, b * 8 + 8) if (t, region["chrom"], p // 5 * 5) in data]
                bins.append(abs(np.mean(covered)) if covered and b < usable else 0.0)
            np.testing.assert_allclose(r["labels"][t], bins, rtol=1e-5)
    local = sorted((r["local_index"], r["index"]) for r in found if r["split"] == "train")
    assert [i for _, i in local] == sorted(i for _, i in local) and local[0][0] == 0
    streamed = SX.run_to_table(SX.stream_examples(spark, root, files_per_trigger=5).select("split", "index"), "test")
    assert rows(streamed, "split", "index") == sorted((r["split"], r["index"]) for r in found)
    again = B.build_dataset(root, regions, signal, tracks, contigs, chunks, options())
    assert again == [], "all splits are there"
    more = B.build_dataset(root, regions, signal, tracks, contigs, chunks, options(splits={"train": ["fold0"], "extra": ["fold2"]}))
    assert more == ["extra"], "a partial build keeps the other splits"
    counts = {r["split"]: r["n_rows"] for r in XS.split_summary(XR.read_examples(spark, root), ["train", "all", "extra"]).collect()}
    assert set(counts) == {"train", "all", "extra"}
    assert spark.read.json(f"{root}/build_params").first()["bin_size"] == 8

    target = str(tmp_path / "rewritten")
    report = XS.rewrite_dataset(spark, root, target, rows_per_file=2).collect()
    assert {r["split"] for r in report} == {"train", "validation", "test", "all", "extra"} and all(r["ratio"] > 0 for r in report)
    key = ["split", "index", "local_index", "interval", "labels", "input_ids"]
    assert rows(XR.read_examples(spark, target), *key) == rows(XR.read_examples(spark, root), *key)
    assert spark.read.text(f"{target}/build_params").count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        XS.rewrite_dataset(spark, root, target)
    XS.rewrite_dataset(spark, target, str(tmp_path / "moved"), remove_source=True)
    assert not (tmp_path / "rewritten").exists()

    means = XR.read_examples(spark, root, split="all", columns=["index", "labels"])
    factors = original_scaling(spark.createDataFrame([(0, 1e6), (1, 2e6)], "track_index int, library_size double"), 8)
    scaled = tmm_scaling(means, factors, 6, 8).orderBy("track_index").collect()
    assert scaled[0]["tmm_factor"] * scaled[1]["tmm_factor"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        tmm_scaling(means, factors.drop("library_size"), 6, 8)


def test_build_order_on_disk(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, *_ = inputs(spark, tmp_path)
    placed = XS.place_members(B.split_members(regions, options()), contigs, 3)
    lengths = {r["chrom"]: r["len"] for r in contigs.collect()}
    keys = [(r["split"], -lengths.get(r["chrom"], 0), r["chrom"], r["index"]) for r in placed.orderBy("place").collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("members", [55_497, 150_000, 2_000_000])
def test_write_tasks_follow_example_bytes(members):
    example = 4 * 524_288 + 4 * 2_299 * 6_144
    tasks = XS.write_tasks(members, example)
    assert 0.5 <= tasks * XS.TASK_BYTES / (members * example) <= 2
    assert XS.write_tasks(0, example) == 1


def test_one_task_per_range(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, *_ = inputs(spark, tmp_path)
    members = B.split_members(regions, options())
    placed = XS.place_members(members, contigs, 5)
    ranges = {r[0] for r in placed.select(F.shiftright("place", XS.PLACE_BITS)).distinct().collect()}
    assert len(ranges) == 5
    root = str(tmp_path / "narrow_tasks")
    B.build_dataset(root, regions, signal, tracks, contigs, chunks, options(), task_bytes=20_000)
    names = {p.name.split("-")[1] for p in (tmp_path / "narrow_tasks").rglob("part-*.parquet")}
    example = 4 * options().geometry.stored_context + 4 * tracks.count() * options().geometry.stored_bins
    expected = XS.write_tasks(members.count(), example, 20_000)
    assert expected > 1 and expected / 2 <= len(names) <= expected


def test_rewrite_copies_all_files_and_counts_empty_splits(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, *_ = inputs(spark, tmp_path)
    root = tmp_path / "described"
    B.build_dataset(str(root), regions, signal, tracks, contigs, chunks, options())
    (root / "dataset_metadata.json").write_text('{"bin_size": 8}')
    (root / "notes" / "deep").mkdir(parents=True)
    (root / "notes" / "deep" / "a.bin").write_bytes(bytes(range(256)))
    target = tmp_path / "moved_with_files"
    XS.rewrite_dataset(spark, str(root), str(target), remove_source=True)
    assert not root.exists()
    assert (target / "dataset_metadata.json").read_text() == '{"bin_size": 8}'
    assert (target / "notes" / "deep" / "a.bin").read_bytes() == bytes(range(256))
    counts = {r["split"]: r["n_rows"] for r in XS.split_summary(XR.read_examples(spark, str(target)), ["train", "none"]).collect()}
    assert counts["none"] == 0 and counts["train"] > 0


def test_document_of_a_build_is_one_file_and_holds_the_splits(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, *_ = inputs(spark, tmp_path)
    root = tmp_path / "with_document"
    counters = spark.createDataFrame([(5, 2)], "n_requested int, n_dropped int")
    B.build_dataset(str(root), regions, signal, tracks, contigs, chunks, options(), counters=counters, inputs={"bed_file": "a.bed"})
    document = json.loads((root / "dataset_metadata.json").read_text())
    assert document["splits"] == {k: list(v) for k, v in options().splits.items()}
    assert (document["bed_file"], document["n_requested"], document["build_strategy"]) == ("a.bed", 5, "grid")
    assert [r["track_index"] for r in document["final_track_records"]] == list(range(tracks.count()))
    read = TR.read_metadata(spark, str(root))
    assert read.first()["bin_size"] == options().geometry.bin_size
    assert TR.track_records(read).count() == tracks.count()


def test_records_of_the_document_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    names = F.when(F.col("id") % 3 == 0, F.concat(F.lit("a, \n\u00e9\"]"), F.col("id"))).alias("name")
    final = spark.range(0, 5000, 1, 7).select((4999 - F.col("id")).alias("track_index"), names)
    size, collect = 200, type(final).collect
    def bounded(df):
        got = collect(df)
        assert len(got) < size, "the driver got the records"
        return got
    monkeypatch.setattr("genotiles.sources.tracks.CHUNK_BYTES", 7)
    for chosen in (final, final.limit(1), final.where("false")):
        with monkeypatch.context() as watched:
            watched.setattr(type(final), "collect", bounded)
            TS.write_dataset_metadata(str(tmp_path), spark, {"bin_size": 8, "splits": {"all": []}}, chosen)
        document = json.loads((tmp_path / "dataset_metadata.json").read_text(encoding="utf-8"))
        assert (document["bin_size"], document["splits"]) == (8, {"all": []})
        wanted = [r.asDict() for r in chosen.orderBy("track_index").collect()]
        assert document["final_track_records"] == [{k: v for k, v in r.items() if v is not None} for r in wanted]
        assert TR.read_metadata(spark, str(tmp_path)).count() == 1


def test_rewrite_of_many_files_reports_a_damaged_copy(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / "a" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "a" / f"d{i % 3}" / f"f {i}%.bin").write_bytes(bytes([i]) * (i * 1000))
    (tmp_path / "a" / "_SUCCESS").write_text("")
    XS._copy_beside(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    old = {p.relative_to(tmp_path / "a"): p.read_bytes() for p in (tmp_path / "a").rglob("*") if p.is_file()}
    assert {p.relative_to(tmp_path / "b"): p.read_bytes() for p in (tmp_path / "b").rglob("*") if p.is_file()} == old
    broken = XS.copy_files
    monkeypatch.setattr(XS, "copy_files", lambda pairs: broken(pairs).withColumn("written_hash", F.lit("other")))
    with pytest.raises(RuntimeError, match="does not hold the files"):
        XS._copy_beside(spark, str(tmp_path / "a"), str(tmp_path / "c"))


def test_samples_choose_narrow_keys(spark):
    wide = spark.range(100).selectExpr("id AS index", "id AS local_index", "repeat('x', 10) AS labels")
    for sample in (random_sample(wide, 7, 1), first_rows(wide, 7), stride_sample(wide, 7)):
        plan = sample._jdf.queryExecution().executedPlan().toString()
        limits = [line for line in plan.splitlines() if "TakeOrderedAndProject" in line or "Limit" in line]
        assert limits and not any("labels" in line for line in limits)
        found = [r["index"] for r in sample.collect()]
        assert len(found) == 7 and found == sorted(found)


def test_exact_strategy_keeps_unknown_contigs_and_agrees_on_the_grid(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, *_ = inputs(spark, tmp_path)
    build = lambda strategy: {
        r["index"]: r for r in B.build_examples(
            regions, signal, tracks, contigs, chunks, options(strategy, {"all": []}), encode=False).collect()}
    grid, exact = build("grid"), build("exact")
    unknown = regions.where("chrom = 'none'").first()["index"]
    assert unknown not in grid and not np.array(exact[unknown]["labels"]).any()
    assert exact[unknown]["seq"] == "N" * 80
    same = [i for i, r in grid.items() if (int(r["interval"].split(":")[1].split("-")[0]) + 16 - 24) >= 0
            and (int(r["interval"].split(":")[1].split("-")[0]) - 8) % 8 == 0 and int(r["interval"].split("-")[1]) < 200]
    assert same
    for i in same:
        np.testing.assert_allclose(np.abs(grid[i]["labels"]), np.abs(exact[i]["labels"]), rtol=1e-6)


def test_codecs_and_options(spark):
    assert [XS.parquet_codec(c) for c in ("zstd", "lz4", "none", None)] == ["zstd", "lz4", "uncompressed", "uncompressed"]
    with pytest.raises(ValueError):
        XS.parquet_codec("rar")
    assert R.parse_splits(["a:x, y", "b:"], DEFAULT_SPLITS) == {"a": ["x", "y"], "b": []}
    assert R.parse_splits([], DEFAULT_SPLITS) == DEFAULT_SPLITS
    with pytest.raises(ValueError):
        R.parse_splits(["oops"], DEFAULT_SPLITS)
    with pytest.raises(ValueError):
        B.BuildOptions(strategy="fast")
    with pytest.raises(ValueError):
        B.Geometry(shift_max_bp=5)


def stored(spark, n=40, split="train"):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([
        (split, i, i, rng.integers(0, 2, (4, 16)).tolist(), rng.uniform(-1, 50, (2, 8)).tolist()) for i in range(n)
    ], "split string, index bigint, local_index bigint, input_ids array<array<tinyint>>, labels array<array<float>>")


def transform(spark, **options):
    tracks = spark.createDataFrame([(0, 1.0, 5.0, 30.0), (1, 2.0, 6.0, 40.0)], "track_index int, scale_factor double, clip_soft double, clip_hard double")
    return augment.make_transform(augment.track_vectors(tracks), shift_max_bins=2, context_length=8, n_pred_bins=4, bin_size=2, **options)


def numpy_transform(labels, scale, soft, hard):
    x = np.minimum(np.maximum(labels, 0) * scale, hard)
    x = (x + 1) ** 0.75 - 1
    knee = (soft + 1) ** 0.75 - 1
    return np.where(x > knee, knee - 1 + np.sqrt(np.maximum(x - knee + 1, 0)), x)


def test_read_time_transform_is_one_of_the_allowed_and_repeatable(spark):
    frame = stored(spark)
    raw = {r["index"]: r for r in frame.collect()}
    swap = spark.createDataFrame([([1, 0],)], "permutation array<int>")
    train = transform(spark, enable_rc_aug=True, rc_permutation=swap)
    found = {r["index"]: r for r in frame.transform(train).collect()}
    again = {r["index"]: r for r in frame.repartition(5).transform(train).collect()}
    seen = set()
    scale, soft, hard = (np.array(v)[:, None] for v in ([1.0, 2.0], [5.0, 6.0], [30.0, 40.0]))
    for i, r in found.items():
        assert r["labels"] == again[i]["labels"] and r["input_ids"] == again[i]["input_ids"]
        options = {}
        for s in range(5):
            seq = np.array(raw[i]["input_ids"])[:, 2 * s:2 * s + 8]
            lab = numpy_transform(np.array(raw[i]["labels"], dtype=np.float64)[:, s:s + 4], scale, soft, hard)
            options[(s, False)] = (seq, lab)
            options[(s, True)] = (seq[::-1, ::-1], lab[[1, 0], ::-1])
        matches = [k for k, (seq, lab) in options.items()
                   if np.array_equal(seq, np.array(r["input_ids"])) and np.allclose(lab, r["labels"], rtol=1e-5)]
        assert matches
        seen.update(matches)
    assert {s for s, _ in seen} == set(range(5)) and {f for _, f in seen} == {True, False}
    centre = frame.transform(transform(spark, center_crop=True)).orderBy("index").first()
    np.testing.assert_array_equal(np.array(centre["input_ids"]), np.array(raw[0]["input_ids"])[:, 4:12])


def test_streams_equal_batches(spark, tmp_path):
    frame = stored(spark, 60)
    path = str(tmp_path / "examples")
    frame.repartition(6).write.parquet(path)
    stream = lambda: SX.stream_parquet(spark, path, files_per_trigger=2)
    assert stream().isStreaming
    apply = transform(spark, center_crop=True)
    streamed = SX.run_to_table(SX.transform_stream(stream(), apply), "test")
    assert rows(streamed, "index", "labels", "input_ids") == rows(frame.transform(apply), "index", "labels", "input_ids")
    assert XS.split_summary(stream(), ["train"]).first()["n_rows"] is None
    pairs = lambda df: df.select(
        F.col("index"), F.posexplode("labels").alias("track", "target"),
    ).withColumn("pred", F.reverse("target"))
    statistics = SM.run_aggregate(SM.running_statistics(pairs(stream()), 3), "test")
    from genotiles.operators import metrics as M
    whole = M.accumulate_statistics(M.nested_statistics(pairs(frame), 3))
    names = [c for c in whole.columns if c != "track"]
    np.testing.assert_allclose(np.array(statistics.orderBy("track").select(*names).collect(), dtype=float),
                               np.array(whole.orderBy("track").select(*names).collect(), dtype=float))
    long = lambda df: pairs(df).select("index", "track", F.posexplode(F.arrays_zip("pred", "target")).alias("bin", "z")).select(
        "index", "track", "bin", F.col("z.pred").cast("double").alias("pred"), F.col("z.target").cast("double").alias("target"))
    state = SM.run_aggregate(SM.running_state(long(stream())), "test").orderBy("track").collect()
    batch = M.reconstruction_state(long(frame), ["track"]).orderBy("track").collect()
    np.testing.assert_allclose(np.array([list(r) for r in state], dtype=float), np.array([list(r) for r in batch], dtype=float))
    kept = SM.take_per_batch(SX.stride_stream(stream(), 20, 60), 20, "local_index", "test")
    assert [r["local_index"] for r in kept.collect()] == list(range(0, 60, 3))
    assert SX.stride_stream(stream(), 20, None).isStreaming


def test_build_from_paths_reads_back(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, *_ = inputs(spark, tmp_path)
    folder = tmp_path / "coverage"
    folder.mkdir()
    for r in tracks.collect():
        lines = [f"{s['chrom']}\t{s['start_pos']}\t{s['end_pos']}\t{s['value']}" for s in signal.where(F.col("track") == r["track"]).collect()]
        (folder / f"t{r['track']}{'_minus' if r['is_minus'] else ''}.bedgraph").write_text("\n".join(lines) + "\n")
    paths = sorted(str(p) for p in folder.iterdir())
    (folder / "copy.bedgraph").write_bytes((folder / paths[0].rsplit("/", 1)[1]).read_bytes())
    root, direct = str(tmp_path / "from_paths"), str(tmp_path / "direct")
    wanted = [*paths, str(folder / "copy.bedgraph"), str(folder / "absent.bedgraph")]
    B.build_from_paths(root, regions, contigs, chunks, options(), wanted, drop_missing=True)
    B.build_dataset(direct, regions, signal, tracks, contigs, chunks, options())
    key = ["split", "index", "labels", "input_ids"]
    assert rows(XR.read_examples(spark, root), *key) == rows(XR.read_examples(spark, direct), *key)
    records = TR.track_records(TR.read_metadata(spark, root))
    assert rows(records, "track_index", "path") == list(enumerate(paths))
    assert spark.read.json(f"{root}/dropped_tracks").count() == spark.read.json(f"{root}/missing_tracks").count() == 1


def test_another_reader_names_its_own_files(spark, tmp_path):
    regions, signal, tracks, contigs, chunks, *_ = inputs(spark, tmp_path)
    with pytest.raises(ValueError, match="glob"):
        B.build_from_paths(
            str(tmp_path / "none"), regions, contigs, chunks, options(), folder=str(tmp_path), read_signal=lambda s, p, t: signal
        )
    with pytest.raises(ValueError, match="no files"):
        B.build_from_paths(str(tmp_path / "none"), regions, contigs, chunks, options(), folder=str(tmp_path / "."))
