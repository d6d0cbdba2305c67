from __future__ import annotations

import numpy as np
import pyarrow as pa

from genotiles.llm.interpolated_lm import lm_scores
from genotiles.llm.jaccard_join import linked_documents
from genotiles.llm.quality_rules import repeated_lines
from genotiles.llm.tokens import pieces, run_hashes, words


def built_pair(n):
    """Two words of n letters, each letter by the parity of its place's bits, and the other way round."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hashes(texts):
    found = []
    for _, _, data, starts in pieces(pa.array(texts)):
        found += words(data, starts).hash.tolist()
    return found


def test_built_words_have_hashes_of_their_own():
    made = [w for n in (16, 32, 64, 65, 128, 512, 1024, 2048, 4096) for w in built_pair(n)]
    assert len(set(hashes(made))) == len(made)


def test_hashes_do_not_depend_on_neighbours():
    texts = ["x" * n + " short " + "y" * (200 - n) for n in range(1, 200)]
    whole = hashes(texts)
    alone = [h for t in texts for h in hashes([t])]
    assert whole == alone
    data = np.frombuffer(b"ab" * 100, np.uint8)
    lows, highs = np.array([0, 100]), np.array([100, 200])
    assert len(set(run_hashes(data, lows, highs).tolist())) == 1


def test_built_words_through_the_operators(documents):
    one, other = built_pair(1024)
    links = {r["doc_id"]: r["component_id"] for r in linked_documents(documents([f"{one} {one} {one} {one}", f"{other} {other} {other} {other}"])).collect()}
    assert links == {0: 0, 1: 1}
    (_, _, data, starts), = pieces(pa.array([f"{one}\n{other}\n{one}"]))
    assert repeated_lines(data, starts).tolist() == [1]
    scored = {r["doc_id"]: r for r in lm_scores(documents([one] * 3 + [f"{other} {one}"] * 3, range(100, 106))).collect()}
    trained = [d for d in range(100, 106) if not scored[d]["held_out"]]
    tokens = sum(scored[d]["n_tokens"] for d in trained)
    seen = {1: 0, 2: 0}
    for d in trained:
        seen[2 if d > 102 else 1] += 1
    assert scored[100]["train_tokens"] == tokens
    distinct = 3 if seen[2] else 2
    base = lambda counts: sum(np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))) for c in counts)
    ends, ones = sum(seen.values()), seen[1] + seen[2]
    assert np.isclose(scored[103]["base_score"], base([seen[2], ones, ends]))
