"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs, pairs with one word between, and the
opening letters of its words (so that inflected and compound forms share weights). Learning rates are kept
per coordinate and the L1 term leaves most coordinates at zero, so the weights are a table of a few thousand
rows that every scoring task can hold; 2^bits bounds them.

Cases: null and empty texts have no features and get the intercept's score; a table without labels, or
with one class only, gives the class rate (0 without labels); rows repeated in documents are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.labelled import held_out, training_rows
from genotiles.llm.tables import lean, with_field
from genotiles.llm.tokens import LOWER, column_of, combine, distinct, pieces, run_hashes, windows, words


@dataclass(frozen=True)
class ToxicityOptions:
    modulus: int = 4
    remainder: int = 2
    threshold: float = 0.3
    #: Labelled rows learned from at most.
    max_rows: int = 16_000
    #: 2^bits coordinates.
    bits: int = 21
    #: Letters (bytes) of a word's opening.
    prefix: int = 5
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 4


def features(data: np.ndarray, starts: np.ndarray, options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Hashed coordinates and rows of all features of a piece, repeats included."""
    found = words(data, starts)
    pair, pair_at = windows(found, 2, salt=2)
    _, skip_at = windows(found, 3)
    skip = combine([found.hash[skip_at], found.hash[skip_at + 2]], salt=3)
    head = run_hashes(LOWER[data], found.start, np.minimum(found.end, found.start + options.prefix))
    hashes = np.concatenate((found.hash, pair, skip, combine([head], salt=4) if len(head) else head))
    rows = np.concatenate((found.row, found.row[pair_at], found.row[skip_at], found.row))
    return (hashes >> np.uint64(64 - options.bits)).astype(np.int64), rows


def _training_batches(options: ToxicityOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = column_of(batch, "label").to_numpy()
            ids = column_of(batch, "doc_id").to_numpy()
            for low, high, data, starts in pieces(column_of(batch, "text")):
                at, row = distinct(*features(data, starts, options))
                ends = np.searchsorted(row, np.arange(high - low + 1))
                sets = [at[ends[i] : ends[i + 1]].astype("<i4").tobytes() for i in range(high - low)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low:high]), pa.array(labels[low:high], pa.int32()), pa.array(sets, pa.binary())],
                    names=["doc_id", "label", "at"],
                )
    return run


def ftrl(rows: list[tuple[np.ndarray, int]], options: ToxicityOptions) -> tuple[np.ndarray, float]:
    """Weights and intercept after passes over (coordinates, label) rows in the order given."""
    size = 1 << options.bits
    z, n = np.zeros(size), np.zeros(size)
    z0, n0 = 0.0, 0.0

    def weight(zs, ns):
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - options.l1, 0)
        return -shrunk / ((options.beta + np.sqrt(ns)) / options.alpha + options.l2)

    for _ in range(options.epochs):
        for at, label in rows:
            w = weight(z[at], n[at])
            w0 = -z0 / ((options.beta + n0**0.5) / options.alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35)))
            g = p - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / options.alpha
            z[at] += g - step * w
            n[at] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / options.alpha * w0
            n0 += g * g
    return weight(z, n), -z0 / ((options.beta + n0**0.5) / options.alpha)


def _learn(options: ToxicityOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (i, label, np.frombuffer(at, "<i4"))
            for batch in batches
            for i, label, at in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
        ]
        rows.sort(key=lambda row: (zlib.crc32(str(row[0]).encode()), row[0], row[1], len(row[2])))
        weights, intercept = ftrl([(at, label) for _, label, at in rows], options) if rows else (np.zeros(1), -35.0)
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(weights[kept], intercept), pa.float64())],
            names=["at", "weight"],
        )
    return run


def learn(documents: DataFrame, labels: DataFrame, options: ToxicityOptions) -> tuple[np.ndarray, float]:
    """Learn the weights in one task from the bounded sample; they are at most 2^bits numbers."""
    sample = training_rows(documents, labels, "toxic", options.modulus, options.remainder, options.max_rows)
    sets = sample.mapInArrow(_training_batches(options), "doc_id long, label int, at binary")
    table = sets.repartition(1).mapInArrow(_learn(options), "at long, weight double").toArrow()
    at, weight = table["at"].to_numpy(), table["weight"].to_numpy()
    weights = np.zeros(1 << options.bits, dtype=np.float32)
    weights[at[at >= 0]] = weight[at >= 0]
    return weights, float(weight[at < 0].sum())


@lean
def _scores(at: np.ndarray, value: np.ndarray, intercept: float, options: ToxicityOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << options.bits, dtype=np.float32)
        table[at] = value
        for batch in batches:
            names = batch.schema.names
            found = []
            for low, high, data, starts in pieces(column_of(batch, "text")):
                where, row = features(data, starts, options)
                useful = table[where] != 0
                where, row = distinct(where[useful], row[useful])
                found.append(np.bincount(row, table[where], high - low))
            total = np.concatenate(found) if found else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(total + intercept, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, "toxicity_"])
    return run


def score_toxicity(
    documents: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None
) -> DataFrame:
    """All columns of documents, and `toxicity_`, the probability that the text is toxic."""
    options = options or ToxicityOptions()
    weights, intercept = learn(documents, labels, options)
    at = np.flatnonzero(weights)
    return documents.mapInArrow(_scores(at, weights[at], intercept, options), with_field(documents, "toxicity_", "double"))


def toxicity_report(documents: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    options = options or ToxicityOptions()
    scored = score_toxicity(documents.select("doc_id", "text"), labels, options)
    return scored.select(
        "doc_id", held_out("doc_id", options.modulus, options.remainder).alias("held_out"),
        F.col("toxicity_").alias("score"), (F.col("toxicity_") >= options.threshold).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None) -> DataFrame:
    """The documents under the threshold."""
    options = options or ToxicityOptions()
    return score_toxicity(documents, labels, options).where(F.col("toxicity_") < options.threshold).drop("toxicity_")
