from __future__ import annotations

import random
import re
import zlib

import pytest

from genotiles.llm.labelled import held_out, training_rows
from genotiles.llm.quality_classifier import quality_report
from genotiles.llm.quality_rules import rule_report
from genotiles.llm.toxicity import toxicity_report

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, documents):
    """Prose, shouting junk, and prose with insults; every second row is labelled."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdeimnorst", k=rng.randrange(2, 8))) for _ in range(400)]
    insults = ["gromblek", "zurtling", "vastard"]
    texts, quality, toxic = [], [], []
    for _ in range(900):
        w = rng.choices(vocabulary, k=rng.randrange(25, 120))
        kind = rng.random()
        if kind < 0.2:
            w = [x.upper() + "!!" for x in w]
        elif kind < 0.4:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        texts.append(" ".join(w) + ".")
        quality.append(int(kind >= 0.2))
        toxic.append(int(0.2 <= kind < 0.4))
    texts += ["", None, "short", "x" * 100_000, "a b " * 20_000]
    labels = [(i, quality[i], toxic[i]) for i in range(0, 900, 2)] + [(None, 1, 1), (7, None, None)]
    return documents(texts), spark.createDataFrame(labels, LABELS), quality, toxic


def test_held_out_toxicity(spark, corpus):
    documents, labels, _, toxic = corpus
    rows = {r["doc_id"]: r for r in toxicity_report(documents, labels).collect()}
    assert len(rows) == 905 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    unseen = [i for i in range(900) if rows[i]["held_out"] or i % 2]
    assert sum(rows[i]["predicted"] == toxic[i] for i in unseen) >= 0.97 * len(unseen)


def test_held_out_quality(spark, corpus):
    documents, labels, quality, _ = corpus
    rows = {r["doc_id"]: r for r in quality_report(documents, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    unseen = [i for i in range(900) if rows[i]["held_out"] or i % 2]
    assert sum(rows[i]["predicted"] == quality[i] for i in unseen) >= 0.97 * len(unseen)


def rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 400 else set(grams)
    hit = {i + k for i, g in enumerate(grams) if g in seen for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rule_counts(spark, documents, corpus):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices(["a", "é#", "|", "<b>", "ß　", "Ab"], k=rng.randrange(0, 12)))
    texts = [None, "", " \n\t\n", "one", "x\n x\nx\nx ", "a\n\n\na\n", "\r\n\r\n", "1 2 3 4 5 6 7 8 " * 30]
    texts += ["\n".join(rng.choices([line() for _ in range(4)] + [""], k=rng.randrange(1, 14))) for _ in range(200)]
    _, labels, *_ = corpus
    got = {r["doc_id"]: r for r in rule_report(documents(texts), labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == rules(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_drop_junk_and_keep_prose(spark, corpus):
    documents, labels, quality, _ = corpus
    rows = {r["doc_id"]: r for r in rule_report(documents, labels).collect()}
    assert sum(rows[i]["kept"] == bool(quality[i]) for i in range(900)) >= 0.97 * 900


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(3, 0, 1)]])
def test_missing_classes_and_empty_tables(spark, documents, labels):
    table = spark.createDataFrame(labels, LABELS)
    docs = documents(["some text"] * 4 + [None])
    assert toxicity_report(docs, table).count() == quality_report(docs, table).count() == rule_report(docs, table).count() == 5
    none = documents([])
    assert toxicity_report(none, table).count() == quality_report(none, table).count() == rule_report(none, table).count() == 0


def test_sample_is_bounded_and_repeatable(spark, documents):
    docs = documents([f"t{i}" for i in range(4000)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4000)], LABELS)
    first = training_rows(docs, labels, "quality", 3, 1, 500)
    assert 350 < first.count() < 650
    assert first.where(held_out("doc_id", 3, 1)).count() == 0
    assert sorted(first.collect()) == sorted(training_rows(docs, labels, "quality", 3, 1, 500).collect())
