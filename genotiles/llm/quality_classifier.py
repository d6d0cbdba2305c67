"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class (label 0 and 1) is a normal density over transformed statistics of a text. A class covariance is shrunk
towards the pooled one and that towards its diagonal, so it can be factored however few rows the class has. Scores
come from the difference of the two log densities, each from the Mahalanobis length under the class's
Cholesky factor, which is inverted once on the driver.

Cases: null and empty texts have statistics too (zeros, transformed); with a class missing from the labels
every score is the other class's label (0.5 without labels); repeated rows are scored and learned from each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.labelled import held_out, training_rows
from genotiles.llm.tables import with_field
from genotiles.llm.tokens import SPACE, column_of, distinct, pieces, words


@dataclass(frozen=True)
class QualityOptions:
    modulus: int = 3
    remainder: int = 1
    threshold: float = 0.5
    #: Labelled rows learned from at most, about.
    max_rows: int = 200_000
    #: Share of the pooled covariance in a class's, and of its diagonal in the pooled one.
    pooled: float = 0.1
    diagonal: float = 0.1
    #: Added to variances of statistics that hardly vary.
    ridge: float = 1e-3
    #: The log odds are divided by this: the statistics are not normal, and their densities too sure.
    temper: float = 4.0


def _mask(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


_SHARES = (
    _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789"), _mask(b".,;:?'\"-"), _mask(b"!"),
    _mask(b"|"), _mask(b"#*$%&<>@~^_=+\\/{}[]"), _mask(b"\n"), _mask(bytes(range(128, 256))), SPACE,
)


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a piece."""
    rows = len(starts) - 1
    size = np.diff(starts)
    found = words(data, starts)
    count = np.diff(found.first())
    some, any_words = np.maximum(size, 1), np.maximum(count, 1)
    out = [np.log1p(size), np.log1p(count)]
    for mask in _SHARES:
        before = np.concatenate(([0], np.cumsum(mask[data])))
        out.append(np.log(1e-3 + (before[starts[1:]] - before[starts[:-1]]) / some))
    length = (found.end - found.start).astype(float)
    mean = np.bincount(found.row, length, rows) / any_words
    spread = np.sqrt(np.maximum(np.bincount(found.row, length**2, rows) / any_words - mean**2, 0))
    out += [np.log1p(mean), np.log1p(spread)]
    _, row = distinct(found.hash, found.row)
    out.append(np.bincount(row, minlength=rows) / any_words)
    letters = _SHARES[0] | _SHARES[1] | _SHARES[2] | _SHARES[8]
    last, first = (data[found.end - 1], data[found.start]) if len(found.end) else (data[:0], data[:0])
    for marked in (~letters[last], ~letters[first], _SHARES[0][first]):
        out.append(np.log(1e-3 + np.bincount(found.row[marked], minlength=rows) / any_words))
    return np.stack(out, axis=1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of (1, statistics) by label: a few rows per batch."""
    for batch in batches:
        label = column_of(batch, "label").to_numpy()
        for low, high, data, starts in pieces(column_of(batch, "text")):
            x = np.concatenate((np.ones((high - low, 1)), statistics(data, starts)), axis=1)
            for value in (0, 1):
                own = x[label[low:high] == value]
                total = own.T @ own
                i, j = np.indices(total.shape)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(total.size, value), pa.int32()), pa.array(i.ravel(), pa.int32()),
                        pa.array(j.ravel(), pa.int32()), pa.array(total.ravel()),
                    ],
                    names=["label", "i", "j", "total"],
                )


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the covariance's Cholesky factor, constant; or a fixed score."""

    classes: tuple
    temper: float
    fixed: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        density = [c - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, c in self.classes]
        odds = (density[1] - density[0]) / self.temper
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def learn(documents: DataFrame, labels: DataFrame, options: QualityOptions) -> Discriminant:
    """Means and covariances from one pass over the labelled rows; only the summed products reach the driver."""
    rows = training_rows(documents, labels, "quality", options.modulus, options.remainder, options.max_rows)
    table = (
        rows.select("text", "label").mapInArrow(_moments, "label int, i int, j int, total double")
        .groupBy("label", "i", "j").agg(F.sum("total").alias("total")).toPandas()
    )
    sums = {}
    for label, part in table.groupby("label"):
        width = int(part["i"].max()) + 1
        total = np.zeros((width, width))
        total[part["i"], part["j"]] = part["total"]
        if total[0, 0] > 0:
            sums[int(label)] = total
    if len(sums) < 2:
        return Discriminant((), options.temper, float(next(iter(sums), 0.5)))
    means = {c: t[0, 1:] / t[0, 0] for c, t in sums.items()}
    own = {c: t[1:, 1:] / t[0, 0] - np.outer(means[c], means[c]) for c, t in sums.items()}
    rows_of = {c: t[0, 0] for c, t in sums.items()}
    every = sum(rows_of.values())
    pooled = sum(own[c] * rows_of[c] for c in own) / every
    pooled = (1 - options.diagonal) * pooled + options.diagonal * np.diag(np.diag(pooled))
    classes = []
    for c in (0, 1):
        share = max(options.pooled, min(1.0, len(pooled) / rows_of[c]))
        covariance = (1 - share) * own[c] + share * pooled + options.ridge * np.eye(len(pooled))
        factor = np.linalg.cholesky(covariance)
        constant = np.log(rows_of[c] / every) * options.temper - np.log(np.diag(factor)).sum()
        classes.append((means[c], np.linalg.inv(factor), constant))
    return Discriminant(tuple(classes), options.temper)


def _score_batches(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(statistics(data, starts)) for _, _, data, starts in pieces(column_of(batch, "text"))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "quality_"])
    return run


def score_quality(documents: DataFrame, labels: DataFrame, options: QualityOptions | None = None) -> DataFrame:
    """All columns of documents, and `quality_`, the probability of label 1."""
    model = learn(documents, labels, options or QualityOptions())
    return documents.mapInArrow(_score_batches(model), with_field(documents, "quality_", "double"))


def quality_report(documents: DataFrame, labels: DataFrame, options: QualityOptions | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    options = options or QualityOptions()
    return score_quality(documents.select("doc_id", "text"), labels, options).select(
        "doc_id", held_out("doc_id", options.modulus, options.remainder).alias("held_out"),
        F.col("quality_").alias("score"), (F.col("quality_") >= options.threshold).cast("int").alias("predicted"),
    )
