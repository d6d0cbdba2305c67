from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from genotiles.llm.end_alignment import gallop
from genotiles.llm.tokenizer_alignment import AlignOptions, _Both, align_tokenizers, byte_letters
from tests.conftest import rows

OPTIONS = AlignOptions(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
A = Tokenizer.from_file(OPTIONS.byte_level)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=OPTIONS.piece_model)
LETTERS = byte_letters()


def tokens(text):
    """(id, bytes) of both sides, or None where a text has no tokens."""
    if not text:
        return None
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(s for _, s in a) != whole or b"".join(s for _, s in b) != whole:
        return None
    return a, b


def groups_of(a, b):
    """Groups as (ids of A, ids of B), by walking both lists byte by byte."""
    out, left, right = [], [], []
    i = j = at = bt = 0
    while i < len(a) or j < len(b):
        if at <= bt:
            at += len(a[i][1])
            left.append(a[i][0])
            i += 1
        else:
            bt += len(b[j][1])
            right.append(b[j][0])
            j += 1
        if at == bt:
            out.append((left, right))
            left, right = [], []
    return out


def expected(ids, texts):
    found, count = [], Counter()
    for text in texts:
        sides = tokens(text)
        groups = groups_of(*sides) if sides else []
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        found.append((sides, groups, links))
    highest = Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc, (sides, groups, links) in zip(ids, found, strict=True):
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc, len(sides[0]) if sides else 0, len(sides[1]) if sides else 0, len(groups), len(links),
            sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(spelled.encode()).hexdigest() if sides else "",
        ))
    return sorted(out, key=str)


def check(documents, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    got = sorted((tuple(r) for r in align_tokenizers(documents(texts, ids), OPTIONS).collect()), key=str)
    assert got == expected(ids, texts)


STRANGE = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n \nb", "a \n b", "x▁y", "▁", "<s> </s> <unk> <|endoftext|>",
    "<0x41>", "don't we're", "a b 　c", "\U0001f600‍\U0001f525 ok", "中文 日本語", "é ﬁ", "a\x00b", "x" * 5000, "ab " * 3000,
    "é" * 700, "1234567890 12 3", "\t\ttab", "a<|endoftext|>b", "�", "worłd Жук",
]


def test_against_a_walk_over_bytes(documents):
    rng = random.Random(3)
    words = ["hello", "world", "tokenizer", "the", "Étion", "naïve", "it's", "x1", "99,5", "(a)", "中", "\n", "a\tb", "running"]
    texts = STRANGE + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)]
    check(documents, texts + texts[:40])


def test_one_id_twice_and_no_id(documents):
    check(documents, ["a b", "a c", "a b", None], [7, 7, None, None])


def test_empty_table(documents):
    assert rows(align_tokenizers(documents([]), OPTIONS)) == []


def test_small_blocks_give_the_same(documents):
    texts = [f"word{i % 7} other things {i}" for i in range(60)] + STRANGE
    small = AlignOptions(OPTIONS.byte_level, OPTIONS.piece_model, block_bytes=200)
    got = sorted((tuple(r) for r in align_tokenizers(documents(texts).repartition(3), small).collect()), key=str)
    assert got == expected(range(len(texts)), texts)


def test_clashing_columns(spark):
    made = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, n_a int, pair int")
    assert [tuple(r) for r in align_tokenizers(made, OPTIONS).collect()] == expected([1], ["a b"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab's'll1é.,!?É \n\t\r  　\x1c\x85\U0001f600▁<>|")), max_size=30), max_size=5))
def test_words_and_whole_texts_have_the_same_tokens(texts):
    both = _Both(OPTIONS) if not hasattr(test_words_and_whole_texts_have_the_same_tokens, "both") else None
    both = both or test_words_and_whole_texts_have_the_same_tokens.both
    test_words_and_whole_texts_have_the_same_tokens.both = both
    has, (a, b), (a_to, b_to) = both.tokens(pa.array([*texts, None], pa.string()))
    for row, text in enumerate([*texts, None]):
        sides = tokens(text)
        assert has[row] == (sides is not None)
        for ids, to, side in ((a, a_to, 0), (b, b_to, 1)):
            low = to[row - 1] if row else 0
            assert ids[low : to[row]].tolist() == ([i for i, _ in sides[side]] if sides else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, unique=True), st.data())
def test_gallop_is_a_lower_bound(values, data):
    hay = np.array(sorted(values))
    needles = np.array(sorted(data.draw(st.lists(st.integers(0, int(hay[-1])), min_size=1))))
    start = np.array(data.draw(st.lists(st.integers(0, len(hay) - 1), min_size=len(needles), max_size=len(needles))))
    n = len(needles)
    got = gallop(hay, needles, start, np.zeros(n, np.int64), np.full(n, len(hay)))
    assert got.tolist() == np.searchsorted(hay, needles).tolist()
