"""Token counts of texts under a unigram model, words sharing the work of their common openings.

A text is cut at blanks into pre-tokens, each with the word-start mark before it. A pre-token's tokens are the
segmentation of the highest sum of scores. The distinct pre-tokens of a batch form a trie; the best score and
its token count of every prefix are computed once where the prefix is first met, walking the trie in sorted
order, and a pre-token's end keeps its count. Texts then add the counts of their words.

Pieces come from a public vocabulary file, which has no probabilities of its own; a piece of rank r gets
log(1 / (r + offset)), Zipf's law, normalised over the vocabulary. A character that no piece covers counts as
its UTF-8 bytes, each a token of the lowest score. Of equal scores the fewer tokens win.

Cases: null, empty and blank texts have no tokens; repeated rows are counted each; very long words cost time in
proportion to their length. What a worker remembers between batches is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from genotiles.llm.tables import with_field
from genotiles.llm.tokens import column_of, pieces, words

#: Pre-tokens that a worker remembers, and the longest of them in characters.
_ENTRIES, _LETTERS = 500_000, 64


@dataclass(frozen=True)
class CountOptions:
    #: File of a sentencepiece model, at the same path on all executors.
    vocabulary: str
    mark: str = "▁"
    #: Zipf's law is flattened for the first ranks.
    offset: float = 2.7


class Pieces:
    """Scores of the vocabulary's pieces as a letter trie."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.byte_score = byte_score
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = score

    def counts(self, tokens: list[str]) -> list[int]:
        """Of sorted, distinct pre-tokens the number of tokens.

        best[i] and count[i] hold the prefix of i letters; active[i] the pieces begun in it that may still grow,
        each with the score and count before it. All of it stays valid for the next word's shared opening.
        """
        best, count, active = [0.0], [0], [[]]
        found, before = [], ""
        for token in tokens:
            shared = 0
            for a, b in zip(token, before, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], active[shared + 1 :]
            for letter in token[shared:]:
                size = len(letter.encode())
                top, fewest = best[-1] + size * self.byte_score, count[-1] + size
                growing = []
                for node, score, number in [*active[-1], (self.root, best[-1], count[-1])]:
                    node = node.get(letter)
                    if node is None:
                        continue
                    growing.append((node, score, number))
                    value = node.get("")
                    if value is not None:
                        value += score
                        if value > top or (value == top and number + 1 < fewest):
                            top, fewest = value, number + 1
                best.append(top)
                count.append(fewest)
                active.append(growing)
            found.append(count[-1])
            before = token
        return found


def zipf_scores(options: CountOptions) -> tuple[dict[str, float], float]:
    """Scores by piece, and the score of a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=options.vocabulary)
    kept = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = log(sum(1 / (rank + options.offset) for rank in range(len(kept))))
    scores = {model.id_to_piece(i): -log(rank + options.offset) - total for rank, i in enumerate(kept)}
    return scores, -log(2 * len(kept) + options.offset) - total


_known: dict[CountOptions, tuple[Pieces, dict[bytes, int]]] = {}


def _worker(options: CountOptions) -> tuple[Pieces, dict[bytes, int]]:
    """The worker's pieces, and the counts of pre-tokens met before."""
    if options not in _known:
        _known[options] = (Pieces(*zipf_scores(options)), {})
    return _known[options]


def _count_batches(options: CountOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, met = _worker(options)
        for batch in batches:
            parts = [np.zeros(0, np.int64)]
            for _, _, data, starts in pieces(column_of(batch, "text")):
                found = words(data, starts, lower=False)
                _, first, place = np.unique(found.hash, return_index=True, return_inverse=True)
                raw = data.tobytes()
                own = [raw[i:j] for i, j in zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)]
                if len(met) > _ENTRIES:
                    met.clear()
                new = sorted((options.mark + w.decode("utf-8", "replace"), w) for w in own if w not in met)
                fresh = dict(zip((w for _, w in new), table.counts([t for t, _ in new]), strict=True))
                met.update((w, n) for w, n in fresh.items() if len(w) <= _LETTERS)
                number = np.array([fresh[w] if w in fresh else met[w] for w in own], np.int64)
                parts.append(np.bincount(found.row, number[place], found.rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(parts))], names=[*batch.schema.names, "tokens_"]
            )
    return run


def count_tokens(documents: DataFrame, options: CountOptions) -> DataFrame:
    """All columns of documents, and `tokens_`, the number of tokens of the text."""
    return documents.mapInArrow(_count_batches(options), with_field(documents, "tokens_", "long"))


def token_report(documents: DataFrame, options: CountOptions) -> DataFrame:
    """doc_id and n_tokens of every document."""
    return count_tokens(documents.select("doc_id", "text"), options).withColumnRenamed("tokens_", "n_tokens").drop("text")
