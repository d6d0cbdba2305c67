"""Quality rules: counted rules, then a calibrated logistic regression over hashed word and byte n-grams.

The regression sees a text as the mean weight of its words and the mean weight of its byte n-grams, so no counts
per text are kept when scoring. It learns from a bounded sample of labelled rows; a fifth of the sample, chosen
by hash, is left out of learning and calibrates the probabilities (slope and intercept of the log odds).

Cases: null and empty texts have no words and fail the base rule; with labels of one class only, or none, the
method keeps all that the base rule keeps; repeated rows are judged each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.labelled import training_rows
from genotiles.llm.tables import with_field
from genotiles.llm.tokens import BYTE, SPACE, Words, column_of, distinct, mix, pieces, run_hashes, windows, words


@dataclass(frozen=True)
class RuleOptions:
    min_words: int = 20
    #: Words of a repeated window, and the percentage of words in such windows that fails.
    window: int = 8
    max_repeat_percent: int = 30
    #: Texts under this probability of label 1 are dropped.
    threshold: float = 0.3
    #: Labelled rows learned from at most, about.
    max_rows: int = 4_000
    #: Weights: 2^bits for words and as many for byte n-grams.
    bits: int = 16
    gram: int = 3
    epochs: int = 30
    rate: float = 2.0
    decay: float = 1e-4


SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sum(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.concatenate(([0], np.cumsum(mask)))
    return before[starts[1:]] - before[starts[:-1]]


def repeated_lines(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    rows = len(starts) - 1
    edge = np.unique(np.concatenate((starts, np.flatnonzero(data == 10) + 1)))
    low, high = edge[:-1], edge[1:] - (data[edge[1:] - 1] == 10)
    worded = np.concatenate(([0], np.cumsum(~SPACE[data])))
    use = worded[high] > worded[low]
    low, high = low[use], high[use]
    row = np.searchsorted(starts, low, side="right") - 1
    _, kept = distinct(run_hashes(data, low, high), row)
    return np.bincount(row, minlength=rows) - np.bincount(kept, minlength=rows)


def repeated_words(found: Words, size: int) -> np.ndarray:
    """Per row: words in windows of size words that occur twice or more in the row."""
    h, at = windows(found, size)
    if not len(h):
        return np.zeros(found.rows, np.int64)
    row = found.row[at]
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(found.row) + size, np.int64)
    change[at[twice]] += 1
    change[at[twice] + size] -= 1
    return np.bincount(found.row[np.cumsum(change)[: len(found.row)] > 0], minlength=found.rows)


def counts(data: np.ndarray, starts: np.ndarray, found: Words, options: RuleOptions) -> dict[str, np.ndarray]:
    letters = ~SPACE[data] & ((data & 0xC0) != 0x80)
    values = (
        np.diff(found.first()), _sum(letters, starts), _sum(SYMBOLS[data], starts), repeated_lines(data, starts),
        repeated_words(found, options.window),
    )
    return dict(zip(_COUNTS, values, strict=True))


def coordinates(
    data: np.ndarray, starts: np.ndarray, found: Words, options: RuleOptions
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coordinate, row) of all words and of all byte n-grams, case kept."""
    shift = np.uint64(64 - options.bits)
    size = np.diff(starts)
    row = np.repeat(np.arange(len(size)), size)
    n = len(data) - options.gram + 1
    if n <= 0:
        grams, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        grams = np.zeros(n, np.uint64)
        for i in range(options.gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + BYTE[data[i : i + n]]
        at = np.flatnonzero(row[:n] == row[options.gram - 1 :])
        grams = mix(grams[at])
    return [
        ((found.hash >> shift).astype(np.int64), found.row),
        ((grams >> shift).astype(np.int64) + (1 << options.bits), row[at]),
    ]


def _training_batches(options: RuleOptions):
    """Per labelled text its distinct coordinates with their shares, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts in pieces(column_of(batch, "text")):
                found = words(data, starts, lower=False)
                rows = high - low
                sets: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(rows)]
                for at, row in coordinates(data, starts, found, options):
                    keys, n = np.unique(row * np.int64(1 << 32) + at, return_counts=True)
                    ends = np.searchsorted(keys, np.arange(rows + 1) * np.int64(1 << 32))
                    for i in range(rows):
                        own = slice(ends[i], ends[i + 1])
                        sets[i].append((keys[own] & 0xFFFFFFFF, n[own] / max(1, n[own].sum())))
                yield pa.RecordBatch.from_arrays(
                    [
                        column_of(batch, "doc_id").slice(low, rows), column_of(batch, "label").slice(low, rows),
                        pa.array([np.concatenate([a for a, _ in s]).astype("<i4").tobytes() for s in sets], pa.binary()),
                        pa.array([np.concatenate([x for _, x in s]).astype("<f4").tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "label", "at", "share"],
                )
    return run


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], options: RuleOptions) -> tuple[np.ndarray, float]:
    """Weights and intercept by steps scaled per coordinate, over rows in the order given."""
    weights, squares = np.zeros(2 << options.bits), np.full(2 << options.bits, 1e-6)
    intercept, square = 0.0, 1e-6
    for _ in range(options.epochs):
        for at, share, label in rows:
            x = share * 10
            error = 1 / (1 + np.exp(-np.clip(weights[at] @ x + intercept, -35, 35))) - label
            gradient = error * x + options.decay * weights[at]
            squares[at] += gradient**2
            weights[at] -= options.rate * 0.1 * gradient / np.sqrt(squares[at])
            square += error**2
            intercept -= options.rate * 0.1 * error / square**0.5
    return weights * 10, intercept


def calibrate(odds: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log odds, by Newton steps; targets are drawn in a little so that they are finite."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([odds, np.ones(len(odds))], axis=1)
    found = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (found - [1.0, 0.0]))
        found = found - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(found[0]), float(found[1])


def _learn(options: RuleOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, label, at, share in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                order = zlib.crc32(f"rules {i}".encode())
                rows.append((order, i, at, np.frombuffer(at, "<i4"), np.frombuffer(share, "<f4").astype(float), label))
        rows.sort(key=lambda r: r[:3])
        learned = [r[3:] for r in rows if r[0] % 5]
        kept = [r[3:] for r in rows if not r[0] % 5]
        at, weight = [-1], [35.0]
        if {r[2] for r in learned} == {0, 1}:
            weights, intercept = fit(learned, options)
            odds = np.array([weights[a] @ s + intercept for a, s, _ in kept])
            labels = np.array([label for _, _, label in kept])
            slope, offset = calibrate(odds, labels) if len({*labels.tolist()}) == 2 else (1.0, 0.0)
            used = np.flatnonzero(weights)
            at, weight = np.append(used, -1), np.append(weights[used] * slope, intercept * slope + offset)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(weight, pa.float64())], names=["at", "weight"])
    return run


def learn(documents: DataFrame, labels: DataFrame, options: RuleOptions) -> tuple[np.ndarray, float]:
    """Calibrated weights and intercept, learned in one task from the bounded sample."""
    # Every labelled row may teach: the rules are judged on documents, not on labels.
    sample = training_rows(documents, labels, "quality", 1, 1, options.max_rows)
    shares = sample.mapInArrow(_training_batches(options), "doc_id long, label int, at binary, share binary")
    table = shares.repartition(1).mapInArrow(_learn(options), "at long, weight double").toArrow()
    at, weight = table["at"].to_numpy(), table["weight"].to_numpy()
    weights = np.zeros(2 << options.bits, np.float32)
    weights[at[at >= 0]] = weight[at >= 0]
    return weights, float(weight[at < 0].sum())


def _judge(weights: np.ndarray, intercept: float, options: RuleOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, starts in pieces(column_of(batch, "text")):
                found = words(data, starts, lower=False)
                part = counts(data, starts, found, options)
                odds = np.full(found.rows, intercept)
                for at, row in coordinates(data, starts, found, options):
                    n = np.bincount(row, minlength=found.rows)
                    odds += np.bincount(row, weights[at], found.rows) / np.maximum(n, 1)
                part["quality"] = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
                parts.append(part)
            columns = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in (*_COUNTS, "quality")}
            few = columns["n_words"] < options.min_words
            failed = few | (100 * columns["n_repeat_words"] > options.max_repeat_percent * columns["n_words"])
            values = [pa.array(columns[c].astype(np.int64)) for c in _COUNTS]
            rules = pa.StructArray.from_arrays(
                [*values, pa.array(failed), pa.array(columns["quality"], pa.float64()), pa.array(~failed & (columns["quality"] >= options.threshold))],
                names=[*_COUNTS, "base_failed", "quality", "kept"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, rules], names=[*batch.schema.names, "rules_"])
    return run


_RULES = f"struct<{', '.join(f'{c}: long' for c in _COUNTS)}, base_failed: boolean, quality: double, kept: boolean>"


def judge_quality(documents: DataFrame, labels: DataFrame, options: RuleOptions | None = None) -> DataFrame:
    """All columns of documents, and `rules_`: the counts, base_failed, quality (probability of label 1), kept."""
    options = options or RuleOptions()
    weights, intercept = learn(documents, labels, options)
    return documents.mapInArrow(_judge(weights, intercept, options), with_field(documents, "rules_", _RULES))


def rule_report(documents: DataFrame, labels: DataFrame, options: RuleOptions | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and quality of every document."""
    return judge_quality(documents.select("doc_id", "text"), labels, options).select(
        "doc_id", *(F.col(f"rules_.{c}") for c in (*_COUNTS, "base_failed", "kept", "quality"))
    )
