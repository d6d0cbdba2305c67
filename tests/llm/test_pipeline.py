from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from genotiles.llm.packing import PackingOptions, pack  # noqa: E402
from genotiles.llm.toxicity import toxicity_report  # noqa: E402

from .test_contamination import brute as contaminated_pairs  # noqa: E402
from .test_jaccard_join import brute as components_of  # noqa: E402


def cut(texts, length=200):
    """Texts without their repeated strings, by bytes; letters cut in the middle go."""
    import collections

    data = [t.encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdeimnorst", k=rng.randrange(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [prose(rng.randrange(12, 40)) for _ in range(8)]
    passages = [prose(70) for _ in range(4)]
    texts, toxic = [None, "", "short", None], [0, 0, 0, 0]
    for _ in range(400):
        kind = rng.random()
        w = prose(rng.randrange(30, 200)).split()
        if kind < 0.2:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["gromblek", "zurtling"]))
        elif kind < 0.35:
            w = w[:20] + rng.choice(passages).split() + w[20:]
        elif kind < 0.45:
            w = w[:20] + rng.choice(items).split() + w[20:]
        elif kind < 0.6 and texts[-1]:
            w = texts[-1].split()
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
        toxic.append(int("gromblek" in w or "zurtling" in w))
    path = tmp_path_factory.mktemp("tables")
    documents(texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def test_stages_against_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity_report(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    kept = [i for i in range(len(texts)) if not predicted[i]]
    assert 0 < len(kept) < len(texts)
    groups = components_of([texts[i] for i in kept], kept, 5, 80)
    kept = sorted({root for _, _, root in groups})
    left = dict(zip(kept, cut([texts[i] or "" for i in kept]), strict=True))
    leaks = {kept[d] for d, *_ in contaminated_pairs([left[i] for i in kept], items)}
    left = {i: t for i, t in left.items() if i not in leaks}
    assert leaks and len(kept) < len(groups)

    frames, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = current = corpus_pipeline.written(stage(spark, current, str(path)), name)
        if name != "packing":
            assert current.columns == docs.columns and current.schema.simpleString() == docs.schema.simpleString()
    got = {r["doc_id"]: r["text"] or "" for r in frames["benchmark"].collect()}
    assert got == left
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    expected = pack(rows, PackingOptions(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(frames["packing"]) == key(expected)
    assert key(corpus_pipeline.run(spark, str(path))) == key(expected)


def test_null_ids_repeated_rows_and_other_columns(spark, folder, documents):
    path, *_ = folder
    docs = documents(["a b c d e f", "a b c d e f", None, "other words here"], [3, 3, None, 9])
    docs = docs.selectExpr("*", "1 AS doc", "2L AS spans", "'x' AS root")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(path)), name)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["3", "9", "None"]
    assert docs.columns[-3:] == ["doc", "spans", "root"]


def test_empty_documents(spark, folder, documents):
    path, *_ = folder
    docs = documents([])
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(path)), name)
    assert docs.count() == 0
