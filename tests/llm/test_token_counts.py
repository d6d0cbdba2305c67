from __future__ import annotations

import random
import re

import public_tokenizers
import pytest

from genotiles.llm.token_counts import CountOptions, Pieces, token_report, zipf_scores

OPTIONS = CountOptions(public_tokenizers.path("piece_bpe_32k.model"))


def brute(token, scores, byte_score):
    """Best (score, fewest tokens) over all segmentations, by positions."""
    best = [(0.0, 0)] + [None] * len(token)
    for j in range(1, len(token) + 1):
        size = len(token[j - 1].encode())
        options = [(best[j - 1][0] + size * byte_score, -(best[j - 1][1] + size))]
        for i in range(max(0, j - 20), j):
            if token[i:j] in scores:
                options.append((scores[token[i:j]] + best[i][0], -(best[i][1] + 1)))
        score, number = max(options)
        best[j] = (score, -number)
    return best[-1][1]


@pytest.fixture(scope="module")
def scores():
    return zipf_scores(OPTIONS)


def test_shared_prefixes_against_each_word_alone(scores):
    rng = random.Random(4)
    alphabet = ["a", "b", "e", "th", "ing", "é", "ß", "中", "😀", "1", "▁", "an"]
    tokens = sorted({"▁" + "".join(rng.choices(alphabet, k=rng.randrange(0, 9))) for _ in range(3000)})
    assert Pieces(*scores).counts(tokens) == [brute(t, *scores) for t in tokens]


def test_counts_of_documents(spark, documents, scores):
    rng = random.Random(6)
    texts = [None, "", " \n\t ", "x" * 5000, "Der schöne Tag\nist da", "the the the", "naïve 中文 text"]
    texts += [" ".join(rng.choices(["alpha", "Alphabet", "betas", "été", "x1,", "　"], k=rng.randrange(0, 60))) for _ in range(200)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_report(documents(texts), OPTIONS).collect()}
    for i, text in enumerate(texts):
        assert got[i] == sum(brute("▁" + w, *scores) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_repeated_rows_null_ids_and_empty_table(spark, documents):
    assert token_report(documents([]), OPTIONS).count() == 0
    rows = token_report(documents(["a b", "a b", "c"], [1, 1, None]), OPTIONS).collect()
    assert len(rows) == 3 and len({r["n_tokens"] for r in rows if r["doc_id"] == 1}) == 1
