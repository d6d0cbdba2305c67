from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from genotiles.llm.interpolated_lm import BUCKETS, LmOptions, learn_weights, lm_scores


def brute(texts):
    """The model with counts in dictionaries, learned on each token of the slice."""
    rows = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in texts]
    crc = [zlib.crc32(str(i).encode()) for i in range(len(texts))]
    train = [c % 5 != 1 for c in crc]
    part = [t and c // 5 % 10 == 0 for t, c in zip(train, crc, strict=True)]

    def counted(use):
        words, pairs = collections.Counter(), collections.Counter()
        for tokens, u in zip(rows, use, strict=True):
            if u:
                words.update(tokens)
                pairs.update(zip(["<"] + tokens, tokens))
        words["<"] = sum(use)
        return words, pairs, sum(len(r) for r, u in zip(rows, use, strict=True) if u), len([w for w in words if w != "<" and words[w]])

    def estimates(counts, tokens):
        words, pairs, total, _ = counts
        for v, w in zip(["<"] + tokens, tokens):
            yield words[v], words[w], words[w] / max(total, 1), pairs[v, w] / max(words[v], 1)

    rest = counted([t and not p for t, p in zip(train, part, strict=True)])
    seen = [e for tokens, p in zip(rows, part, strict=True) if p for e in estimates(rest, tokens)]
    weights = learn_weights(
        np.array([min(int(e[0]).bit_length(), BUCKETS - 1) for e in seen], np.int64), np.ones(len(seen)), 1 / (rest[3] + 1),
        np.array([e[2] for e in seen]), np.array([e[3] for e in seen]), 200,
    )
    every = counted(train)
    _, _, total, distinct = every
    out = []
    for tokens, t in zip(rows, train, strict=True):
        e = list(estimates(every, tokens))
        mix = [weights[min(int(x[0]).bit_length(), BUCKETS - 1)] for x in e]
        score = sum(math.log10(m[0] / (distinct + 1) + m[1] * x[2] + m[2] * x[3]) for m, x in zip(mix, e, strict=True))
        base = sum(math.log10((x[1] + 0.5) / (total + 0.5 * (distinct + 1))) for x in e)
        out.append((not t, len(tokens), sum(x[1] > 0 for x in e), total, base, score))
    return out


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 5))) for _ in range(300)]
    follow = {w: rng.choices(vocabulary, k=3) for w in vocabulary}
    texts = [None, "", "  \n", "The the THE", "x" * 3000, "only here once"]
    for _ in range(500):
        w = [rng.choice(vocabulary)]
        while rng.random() < 0.97:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.7 else rng.choice(vocabulary))
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("options", [LmOptions(), LmOptions(block_tokens=600, range_entries=2000)])
def test_against_dictionaries(spark, documents, options):
    texts = corpus()
    got = {r["doc_id"]: tuple(r)[1:] for r in lm_scores(documents(texts).repartition(3), options).collect()}
    assert len(got) == len(texts)
    better = 0
    for i, row in enumerate(brute(texts)):
        assert got[i][:4] == row[:4]
        assert got[i][4] == pytest.approx(row[4], rel=1e-9)
        # Estimates are binned for learning, so the weights agree nearly.
        assert got[i][5] == pytest.approx(row[5], rel=5e-3, abs=1e-6)
        better += got[i][5] > got[i][4]
    assert better > 0.9 * len(texts)


def test_learned_weights_find_the_mixture():
    rng = np.random.default_rng(1)
    p1, p2 = rng.uniform(0.01, 0.3, 4000), rng.uniform(0.01, 0.9, 4000)
    weights = learn_weights(np.full(4000, 5), np.ones(4000), 1e-4, p1, p2, 500)
    likelihood = lambda w: np.log(w[0] * 1e-4 + w[1] * p1 + w[2] * p2).sum()
    assert weights[5].sum() == pytest.approx(1) and weights[0][2] == 0
    assert all(likelihood(weights[5]) >= likelihood(w) - 1e-2 for w in rng.dirichlet([1, 1, 1], 200))


def test_repeated_rows_null_ids_empty_tables_and_no_training_text(spark, documents):
    assert lm_scores(documents([])).count() == 0
    rows = lm_scores(documents(["a b", "a b", "c"], [1, 1, None])).collect()
    assert len(rows) == 3 and sum(r["doc_id"] is None for r in rows) == 1
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    (row,) = lm_scores(documents(["new words"], held[:1])).collect()
    assert tuple(row) == (held[0], True, 3, 0, 0, 0.0, pytest.approx(3 * math.log10(0.5)))
