from __future__ import annotations

import collections
import hashlib
import random

import pytest

from genotiles.llm.repeats import RepeatOptions, repeat_report, without_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def prose(n):
        return " ".join("".join(rng.choices("abcdeéß", k=rng.randrange(1, 8))) for _ in range(n))
    passages = [prose(k) for k in (30, 60, 90, 200)]
    texts = [None, "", "a" * 199, "a" * 200, "b" * 201, "c" * 5000, "ab" * 150, "xyz" * 400, prose(3000)]
    for _ in range(60):
        parts = [prose(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(passages), prose(rng.randrange(0, 30))]
        texts.append(" ".join(parts))
    for _ in range(25):
        t = rng.choice(texts) or "z"
        i = rng.randrange(len(t) + 1)
        texts.append(rng.choice([t, t[:i] + "#" + t[i:], t[i:], t[:i], t + t]))
    return texts


@pytest.mark.parametrize("options", [RepeatOptions(), RepeatOptions(group=1), RepeatOptions(length=50, gram=13)])
def test_against_all_strings(spark, documents, options):
    texts = corpus(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeat_report(documents(texts), options).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, options.length)


def test_chunks_of_long_texts(spark, documents, monkeypatch):
    from genotiles.llm import repeats
    monkeypatch.setattr(repeats, "_CHUNK", 700)
    texts = corpus(4)
    found = [(t or "").encode() for t in texts]
    options = RepeatOptions()
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc": [1], "twin": [2], "text": [found[8]]})
    rows = [r for b in repeats._run_batches(options)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["suffixes"] for r in rows) == len(found[8]) - 199


def test_repeated_rows_empty_table_and_other_columns(spark, documents):
    assert repeat_report(documents([])).count() == 0
    long = "".join(random.Random(1).choices("abc ", k=400))
    got = repeat_report(documents([long, long, "short", long[:250]], [5, 5, None, 7]))
    rows = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect())
    assert rows == [(-1, 5, 0, 0), (5, 400, 400, 1), (5, 400, 400, 1), (7, 250, 250, 1)]
    clash = spark.createDataFrame([(1, "t", 5, 6, "x")], "doc_id long, text string, doc int, twin int, kept string")
    row = without_repeats(clash).first()
    assert row["rest"].asDict() == {"doc_id": 1, "doc": 5, "twin": 6, "kept": "x"} and row["kept"] == b"t"
