"""Groups of rows in sorted partitions, many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows looked at together, if no group is larger.
_ROWS = 8192


def complete_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys; the last group of a piece waits for its rest."""
    waiting: list[pa.Table] = []
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = pa.Table.from_batches([batch.slice(at, _ROWS)])
            first = group_starts(part, keys)
            if waiting and any(waiting[-1][k][-1] != part[k][0] for k in keys):
                yield pa.concat_tables(waiting).combine_chunks()
                waiting = []
            cut = int(first[-1])
            if cut:
                yield pa.concat_tables([*waiting, part.slice(0, cut)]).combine_chunks()
                waiting = []
            waiting.append(part.slice(cut))
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()


def group_starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups of equal keys start in a sorted table."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        values = table[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
