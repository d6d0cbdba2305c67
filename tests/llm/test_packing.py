from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from genotiles.llm import encoding
from genotiles.llm.cutting_stock import patterns
from genotiles.llm.encoding import encoder
from genotiles.llm.packing import PackingOptions, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
OPTIONS = PackingOptions(PATH)
PLAIN = {as_text: Tokenizer.from_file(PATH) for as_text in (False, True)}
PLAIN[True].encode_special_tokens = True


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(
    st.sampled_from([*"ab's'll1é9.,!?Éÿªµʔ \n\n\t\r 　 \x1c\x85😀ß", "<|endoftext|>", ".\n", "\nThe"]), max_size=40
).map("".join), max_size=5))
def test_ids_of_words_are_ids_of_texts(texts):
    for as_text, plain in PLAIN.items():
        ids, starts = encoder(PATH, as_text).many(pa.array([*texts, None], pa.string()))
        got = [ids[i:j].tolist() for i, j in zip(starts, starts[1:])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def check(rows, texts, tokenizer, capacity=2048):
    ids = [(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for t in texts]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d, whole in enumerate(ids):
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(np.array(whole[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(whole)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), sum(map(len, ids))


def test_pieces_and_sequences(spark, documents, tokenizer):
    rng = random.Random(2)
    texts = [None, "", "  two  blanks ", "<|endoftext|>", "word " * 9000, "x" * 3000]
    texts += [" ".join(rng.choices(["alpha", "beta's", "été", "x1", "\n", "Long-word!"], k=rng.choice([3, 40, 300, 900]))) for _ in range(300)]
    sequences, tokens = check(pack(documents(texts), OPTIONS).collect(), texts, tokenizer)
    assert sequences * 2048 <= tokens * 1.03 + 2048


def test_one_length_in_many_buckets(spark, documents, tokenizer):
    texts = ["same text here"] * 700
    rows = pack(documents(texts), PackingOptions(PATH, bucket_rows=50)).collect()
    sequences, tokens = check(rows, texts, tokenizer)
    assert len(rows) == 700 and sequences * 2048 <= tokens * 2 + 2048


def test_repeated_rows_null_ids_and_empty_table(spark, documents):
    assert pack(documents([]), OPTIONS).count() == 0
    rows = pack(documents(["a b", "a b", "c"], [1, 1, None]), OPTIONS).collect()
    assert sorted(r["offset"] for r in rows if r["doc_id"] == 1)[1] > 0 and len(rows) == 3


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_demand(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, [1, 50, 5000, 3][seed] + 1, 256)
    found = patterns(demand, 256)
    assert all((c * np.arange(1, 257)).sum() <= 256 and b > 0 for c, b in found)
    assert (sum(c * b for c, b in found) == demand).all() if found else not demand.any()
    bins, least = sum(b for _, b in found), (demand * np.arange(1, 257)).sum() / 256
    assert bins <= max(least * 1.02, demand[128:].sum()) + 12


def test_special_tokens_in_texts(documents):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>\nb <|endoftext|"]
    plain = Tokenizer.from_file(PATH)
    assert plain.encode(texts[0], add_special_tokens=False).ids == [87, 220, 50256, 331]
    check(pack(documents(texts), OPTIONS).collect(), texts, plain)
    plain.encode_special_tokens = True
    check(pack(documents(texts), PackingOptions(PATH, special_as_text=True)).collect(), texts, plain)


def test_words_of_an_earlier_batch_are_not_tokenized_again(monkeypatch):
    calls, missing = [], encoding._Words.__missing__
    monkeypatch.setattr(encoding, "_ENTRIES", 10)
    monkeypatch.setattr(encoding._Words, "__missing__", lambda self, word: calls.append(word) or missing(self, word))
    texts = pa.array([" ".join(f"w{i}x{k}" for k in range(100)) for i in range(20)])
    encode = encoding.Encoder(PATH)
    first = encode.many(texts)
    met = len(calls)
    again = encode.many(texts)
    assert met >= 1900 and len(calls) == met
    assert all((a == b).all() for a, b in zip(first, again, strict=True))


@pytest.mark.parametrize("remembered", [0, 7, 1000])
def test_ids_from_a_small_memory(monkeypatch, remembered):
    monkeypatch.setattr(encoding, "_REMEMBERED", remembered)
    rng, encode, plain = random.Random(remembered), encoding.Encoder(PATH), PLAIN[False]
    words = ["", "é", "it's", "\n", "a\nb", "x" * 70, "日本", *(f"w{i}," for i in range(60))]
    for _ in range(30):
        texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(rng.randrange(6))]
        ids, starts = encode.many(pa.array(texts, pa.string()))
        assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert (np.diff(encode.memory.hash.astype(object)) > 0).all()
