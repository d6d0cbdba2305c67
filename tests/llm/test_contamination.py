from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from genotiles.llm.contamination import contaminated, without_contaminated


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(texts, items):
    out = []
    for d, text in enumerate(texts):
        have = shingle_set(text)
        for i, item in enumerate(items):
            need = shingle_set(item)
            if need and 100 * len(need & have) >= 80 * len(need):
                out.append((d, i, len(need), len(need & have)))
    return sorted(out)


def test_against_all_pairs(spark, documents):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices([f"v{i}" for i in range(300)], k=n))
    items = [prose(k) for k in (1, 3, 4, 5, 6, 9, 20, 20, 47, 59, 150)] + ["", None, "same words " * 12]
    texts = [None, "", items[0], items[1], items[1].upper(), prose(9000)]
    for _ in range(80):
        w = (rng.choice(items) or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = "changed"
        texts.append(prose(rng.randrange(0, 400)) + "\n" + "  ".join(w) + " " + prose(rng.randrange(0, 400)))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(texts)
    assert sorted(tuple(r) for r in contaminated(docs, benchmark).collect()) == brute(texts, items)
    left = {r["doc_id"] for r in without_contaminated(docs, benchmark).collect()}
    assert left == set(range(len(texts))) - {r[0] for r in brute(texts, items)}


def test_null_ids_repeated_rows_and_empty_tables(spark, documents):
    item = " ".join(f"q{i}" for i in range(30))
    benchmark = spark.createDataFrame([(None, item), (None, item), (3, None)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    docs = documents(["pre " + item, item + " post", "clean text", item], [None, None, 2, 4])
    assert sorted(str(tuple(r)) for r in contaminated(docs, benchmark).collect()) == ["(4, None, 26, 26)", "(None, None, 26, 26)"]
    assert [r["doc_id"] for r in without_contaminated(docs, benchmark).collect()] == [2]
    assert contaminated(documents([]), benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0
