from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genotiles.llm import audit_paths
from genotiles.llm.audit_paths import Audits, after_rows, beginning, joined, passages
from genotiles.llm.conversation_repair import RepairOptions, repair_report

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) of (role, text, fault) by whole strings: every state holds its least audit."""
    best = {"": (0, "", ())}

    def inserted(held):
        for _ in range(3):
            for roles, (cost, audit, made) in list(held.items()):
                role = "user" if roles in ("", "s", "a") else "assistant"
                offer(held, "u" if role == "user" else "a", (cost + 5, audit + "I", (*made, (role, ""))))
        return held

    def offer(held, state, new):
        if state not in held or new[:2] < held[state][:2]:
            held[state] = new

    best = inserted(best)
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, made) in best.items():
            offer(after, state, (cost + 2, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] and role[:1] in legal:
                offer(after, role[:1], (cost + more, audit + "K", (*made, (role, text))))
            target = "assistant" if state == "u" else "user"
            offer(after, target[0], (cost + more + 1, audit + "R", (*made, (target, text))))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def expected(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(key.encode()) % 20
            if code == 1:
                text = ""
            if code == 2:
                text = re.sub("[.!?]", "", text)
            if code == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, *_ in rows if t is not None}
        seen, marked = set(), []
        for _, role, text in rows:
            ending = text.rstrip(BLANK)[-1:]
            fault = (
                "blank" if not ending else "duplicate" if (role, text) in seen else "truncated" if ending not in ".!?" else None
            )
            seen.add((role, text))
            marked.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, made = cheapest(marked)
        faults = [f for *_, f in marked]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, table, options=None, parts=None):
    made = spark.createDataFrame(table, SCHEMA)
    got = repair_report(made.repartition(parts) if parts else made, options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(table)


def conversation(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "usage", "", None, " "]
    texts = ["Yes.", "No?", "cut off", "", "  ", None, "a.b.c!", "Ünder. ", "line\nline.", "end.\t\n", "。", "x" * 50]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    return [
        (conv, None if rng.random() < 0.05 else t + (rng.random() < 0.05) * 3, rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randint(0, 9)}.")
        for t in range(n)
    ]


def test_against_whole_strings(spark):
    rng = random.Random(5)
    table = [r for c in range(250) for r in conversation(rng, c, rng.randint(1, 12))]
    table += table[:60]
    table += [(None, 1, "user", "Hi."), (None, None, None, None), (900, None, "user", "a."), (900, None, "assistant", "b.")]
    check(spark, table)


@pytest.mark.parametrize("segment_rows", [1, 3, 7])
def test_long_conversations_are_cut(spark, segment_rows):
    rng = random.Random(segment_rows)
    table = conversation(rng, 1, 120) + conversation(rng, 2, 35) + conversation(rng, 3, 2) + [(4, 5, "user", "same.")] * 20
    check(spark, table, RepairOptions(segment_rows=segment_rows), parts=5)


def test_nothing_left(spark):
    ids = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    table = [(c, 0, "user", "Gone.") for c in ids]
    check(spark, table)
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in repair_report(spark.createDataFrame(table, SCHEMA)).collect()} == {(0, 0, 0, 0, 0, 0, "", empty)}


def test_empty_table_and_other_columns(spark):
    assert repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    made = spark.createDataFrame([(1, 5, "user", "A.", 7, b"x", "K")], SCHEMA + ", times long, digest binary, audit string")
    assert [tuple(r) for r in repair_report(made).collect()] == expected([(1, 5, "user", "A.")])


def test_long_text(spark):
    check(spark, [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "ok."), (1, 2, "user", "x" * 3_000_000)])


ROWS = "suaoSUAOx"


def best_string(rows):
    """Cost and audit by trying every string of edits, with up to two inserts in a place."""
    found = None
    legal = re.compile("(s?(ua)+)?")
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and r == "x" for e, r in zip(edits, rows)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * inserts[0] + "".join(e + "I" * i for e, i in zip(edits, inserts[1:]))
            cost = 5 * sum(inserts) + sum(
                {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and r.isupper()) for e, r in zip(edits, rows)
            )
            if found is not None and (cost, audit) >= found:
                continue
            kept = iter(r.lower() for e, r in zip(edits, rows) if e == "K")
            made, last = "", ""
            for edit in audit:
                if edit in "RI":
                    last = "a" if last == "u" else "u"
                    made += last
                elif edit == "K":
                    last = next(kept)
                    made += last
            if legal.fullmatch(made):
                found = (cost, audit)
    return found


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_short_conversation(n):
    for rows in itertools.product(ROWS, repeat=n):
        rows = "".join(rows)
        assert joined([passages(rows, True)] if rows else []) == best_string(rows)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list(ROWS)), max_size=60), st.lists(st.integers(0, 60)), st.booleans(), st.booleans())
def test_cuts_change_nothing(rows, cuts, begins, clash):
    cuts = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    prime = audit_paths._PRIME
    try:
        # With a tiny modulus nearly all hashes collide.
        audit_paths._PRIME = 3 if clash else prime
        got = joined([passages(part, begins and i == 0) for i, part in enumerate(parts)])
    finally:
        audit_paths._PRIME = prime
    faults = {"x": "blank"}
    want = cheapest([
        ({"s": "system", "u": "user", "a": "assistant"}.get(r.lower(), "other"), "t", faults.get(r, "truncated" if r.isupper() else None)) for r in rows
    ])
    assert got == want[:2]


def test_beginnings_are_shared():
    audits = Audits()
    after_rows("ua" * 3000, beginning(audits), audits)
    # A few nodes a row, however long the audits are.
    assert len(audits.edit) < 15 * 6000
    assert max(audits.depth) >= 6000
