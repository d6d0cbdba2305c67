"""Repair of the structure of conversations: cheapest edits to `system? (user assistant)+`, with an audit of each.

How it runs: rows are brought down to what the repair looks at (initial of the role, blank, seen before, truncated) and a digest
of the text; equal rows are counted first, and a row is a duplicate by the first place of its role and digest, an aggregate
joined back. These narrow rows are sorted by ranges of conversation and place, so a conversation of any length is spread
over tasks. A task turns each conversation's rows in its range into segments: what the rows do to each state in which they may
be met, at what cost and with which audit (`audit_paths`). One more shuffle brings the segments of a conversation before
its texts, sorted; a task joins the segments and feeds the repaired rows to the hash one by one, so neither a conversation's
rows nor its texts are ever held together. (The hash of one conversation is one chain over its text; nothing can share that.)

Order of a conversation's rows: turn (nulls first), role, SHA-256 of the text. Cases: a null role or text is one blank, a
null id or turn in the damage's key too; a null conv_id is a conversation of its own. A role without a first letter, or with
another than s, u and a, can't be kept. Repeated rows are duplicates. Empty texts are blank. An empty table gives no rows.
Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genotiles.llm.audit_paths import DELETE, FORCED, INSERT, KEEP, joined, passages
from genotiles.llm.tables import written
from genotiles.llm.tokens import column_of

#: Characters that separate words, marks that end a sentence, what the damage's remainders do.
BLANKS = " \t\n\x0b\x0c\r"
MARKS = ".!?"
DROPPED, EMPTIED, UNMARKED, REPEATED, MISATTRIBUTED = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class RepairOptions:
    #: Rows whose audits are in memory at once; longer conversations are cut.
    segment_rows: int = 4096
    #: Short runs of rows that a task remembers the passages of.
    remembered: int = 1 << 15


def damaged(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """conv_id, turn, role, text and times (how often the row stands there) after the planted damage; nulls are one blank."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    fault = F.col("fault")
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % modulus).alias("fault"))
        .where(fault != DROPPED)
        .select(
            "conv_id", "turn", F.when(fault == MISATTRIBUTED, "user").otherwise(F.col("role")).alias("role"),
            F.when(fault == EMPTIED, "").when(fault == UNMARKED, F.translate("text", MARKS, "")).otherwise(F.col("text")).alias("text"),
            F.when(fault == REPEATED, 2).otherwise(1).cast("long").alias("times"),
        )
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with has_turn and digest, which with turn and role give their place in the conversation."""
    return rows.withColumns({
        "turn": F.col("turn").cast("long"), "has_turn": F.col("turn").isNotNull(), "digest": F.unhex(F.sha2("text", 256)),
    })


PLACE = ("has_turn", "turn", "role", "digest")


def _letter(role: str) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def narrow_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, letter, times, blank, truncated and first (whether role and text were not seen earlier)."""
    ending = F.rtrim(F.col("text"), F.lit(BLANKS))
    counted = (
        _placed(rows).withColumn("ending", F.substring(ending, -1, 1))
        .groupBy("conv_id", *PLACE).agg(F.sum("times").alias("times"), F.first("ending").alias("ending"))
    )
    earliest = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("earliest")).select(
        F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"), "earliest"
    )
    same = F.equal_null("conv_id", "of_conv") & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    return counted.join(earliest, same).select(
        "conv_id", *PLACE, _letter("role").alias("letter"), "times", (F.col("ending") == "").alias("blank"),
        (~F.col("ending").isin(*MARKS)).alias("truncated"),
        F.equal_null(F.struct("has_turn", "turn"), F.col("earliest")).alias("first"),
    )


#: What a segment's rows have by themselves; letters and turns at its ends, for what lies between two segments.
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = (
    "number long, blank long, duplicate long, truncated long, illegal long, turns long, first_letter string, last_letter string, "
    "first_turn long, last_turn long, starts array<int>, ends array<int>, costs array<long>, audits array<string>"
)
_LEGAL = {"su", "ua", "au"}


class _Segment:
    """Rows of one conversation, in order, until they are cut."""

    def __init__(self, place: tuple, number: int, begins: bool):
        self.place, self.number, self.begins = place, number, begins
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.rows: list[str] = []
        self.size = 0
        self.first_letter = self.last_letter = None
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, letter: str, times: int, blank: bool, truncated: bool, fresh: bool) -> None:
        """times equal rows; fresh: the first of them was not seen earlier."""
        counts = self.counts
        if self.last_letter is None:
            self.first_letter = letter
        elif self.last_letter + letter not in _LEGAL:
            counts["illegal"] += 1
        counts["illegal"] += times - 1
        self.last_letter = letter
        if turn is not None and turn != self.last_turn:
            counts["turns"] += 1
            if self.first_turn is None:
                self.first_turn = turn
            self.last_turn = turn
        if blank:
            counts["blank"] += times
            self.rows.append(FORCED * times)
        else:
            counts["duplicate"] += times - fresh
            counts["truncated"] += fresh and truncated
            self.rows.append((letter.upper() if truncated else letter) * fresh + FORCED * (times - fresh))
        self.size += times


def _segments(options: RepairOptions, schema: pa.Schema):
    """Partitions are sorted by conversation and place; a partition's first conversation may have begun before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[tuple[str, bool], list] = {}
        out: list[dict] = []

        def close(conv_id, segment: _Segment) -> None:
            rows = "".join(segment.rows)
            found = remembered.get((rows, segment.begins))
            if found is None:
                found = passages(rows, segment.begins)
                if len(rows) <= 16 and len(remembered) < options.remembered:
                    remembered[rows, segment.begins] = found
            starts, ends, costs, audits = map(list, zip(*found, strict=True))
            out.append({
                "conv_id": conv_id, **dict(zip(PLACE, segment.place, strict=True)), "number": segment.number, **segment.counts,
                "first_letter": segment.first_letter, "last_letter": segment.last_letter, "first_turn": segment.first_turn,
                "last_turn": segment.last_turn, "starts": starts, "ends": ends, "costs": costs, "audits": audits,
            })

        names = ("conv_id", *PLACE, "letter", "times", "blank", "truncated", "first")
        conv: object = None
        segment: _Segment | None = None
        begun = False
        for batch in batches:
            columns = [column_of(batch, name).to_pylist() for name in names]
            for conv_id, has_turn, turn, role, digest, letter, times, blank, truncated, first in zip(*columns, strict=True):
                if segment is not None and conv_id != conv:
                    close(conv, segment)
                    segment, begun = None, True
                conv = conv_id
                fresh, number = first, 0
                # Equal rows stand side by side; a great many of them are several segments of their place.
                while times:
                    if segment is not None and segment.size >= options.segment_rows:
                        close(conv, segment)
                        segment, begun = None, False
                    if segment is None:
                        segment = _Segment((has_turn, turn, role, digest), number, begun)
                        begun = False
                    part = min(times, options.segment_rows - segment.size)
                    segment.add(turn, letter, part, blank, truncated, fresh)
                    times, fresh, number = times - part, False, number + 1
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if segment is not None:
            close(conv, segment)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


#: Roles of changed and inserted rows, in turn.
_MADE = ("user", "assistant")


class _Conversation:
    """One conversation's segments, then its rows."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.segments: list[dict] = []
        self.audit: str | None = None
        self.hash = hashlib.sha256()

    def settle(self) -> None:
        self.cost, self.audit = joined([list(zip(*(s[c] for c in ("starts", "ends", "costs", "audits")), strict=True)) for s in self.segments])
        self.counts = {c: sum(s[c] for s in self.segments) for c in _COUNTS}
        self.lowest = self.highest = None
        for s, t in zip(self.segments, self.segments[1:], strict=False):
            self.counts["illegal"] += s["last_letter"] + t["first_letter"] not in _LEGAL
            self.counts["turns"] -= s["last_turn"] is not None and s["last_turn"] == t["first_turn"]
        turns = [s for s in self.segments if s["first_turn"] is not None]
        if turns:
            self.lowest, self.highest = turns[0]["first_turn"], turns[-1]["last_turn"]
        self.segments = []
        self.at, self.next_role, self.empty = 0, 0, True

    def _write(self, role: bytes, text: bytes) -> None:
        self.hash.update(role + b":" + text if self.empty else b"\n" + role + b":" + text)
        self.empty = False

    def _made(self, text: bytes) -> None:
        self._write(_MADE[self.next_role].encode(), text)
        self.next_role ^= 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self._made(b"")
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        if self.audit is None:
            self.settle()
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self._write(role, text)
            # After a kept system row a user's comes next, as at the beginning.
            self.next_role = int(role[:1] == b"u")
        elif edit != DELETE:
            self._made(text)

    def result(self) -> tuple:
        if self.audit is None:
            self.settle()
        self._inserts()
        counts = self.counts
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - counts["turns"]
        return (
            self.conv_id, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], self.cost,
            self.audit, self.hash.hexdigest(),
        )


_REPAIRED = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_IS_ID, _IS_SEGMENT, _IS_ROW = 0, 1, 2


def _repaired(schema: pa.Schema):
    """Partitions are sorted by conversation, kind and place: an id, its segments, its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation: _Conversation | None = None
        for batch in batches:
            done: list[tuple] = []
            kinds, times = column_of(batch, "kind").to_pylist(), column_of(batch, "times").to_pylist()
            ids = column_of(batch, "conv_id").to_pylist()
            roles, texts = (column_of(batch, c).cast(pa.large_binary()) for c in ("role", "text"))
            is_segment = pa.array([k == _IS_SEGMENT for k in kinds], pa.bool_())
            segments = iter(batch.filter(is_segment).to_pylist())
            for i, (conv_id, kind) in enumerate(zip(ids, kinds, strict=True)):
                if kind == _IS_ID:
                    if conversation is not None:
                        done.append(conversation.result())
                    conversation = _Conversation(conv_id)
                elif kind == _IS_SEGMENT:
                    conversation.segments.append(next(segments))
                else:
                    role, text = roles[i].as_py(), texts[i].as_py()
                    for _ in range(times[i]):
                        conversation.row(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if conversation is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(conversation.result(), schema, strict=True)], schema=schema)
    return run


def _schema_of(df: DataFrame, columns: tuple[str, ...], more: str) -> tuple[str, pa.Schema]:
    """Those columns of df and more, for Spark and for Arrow."""
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in columns]
    text = ", ".join([*kinds, more])
    return text, df.sparkSession.createDataFrame([], text).toArrow().schema


def repair(rows: DataFrame, ids: DataFrame, options: RepairOptions | None = None) -> DataFrame:
    """Per conv_id of ids (distinct): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    rows: conv_id, turn, role, text and times, without nulls in the last three.
    """
    options = options or RepairOptions()
    narrow = written(narrow_rows(rows), "narrow")
    text, schema = _schema_of(narrow, ("conv_id", *PLACE), _SEGMENT)
    segments = (
        narrow.repartitionByRange("conv_id", *PLACE).sortWithinPartitions("conv_id", *PLACE).mapInArrow(_segments(options, schema), text)
    )
    stream = (
        ids.select("conv_id", F.lit(_IS_ID).alias("kind"))
        .unionByName(segments.withColumn("kind", F.lit(_IS_SEGMENT)), allowMissingColumns=True)
        .unionByName(_placed(rows).withColumn("kind", F.lit(_IS_ROW)), allowMissingColumns=True)
    )
    out, out_schema = _schema_of(ids, ("conv_id",), _REPAIRED)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *PLACE, "number").mapInArrow(_repaired(out_schema), out)


def repair_report(conversations: DataFrame, options: RepairOptions | None = None) -> DataFrame:
    """The repair of every conversation after the planted damage."""
    return repair(damaged(conversations), conversations.select("conv_id").distinct(), options)
