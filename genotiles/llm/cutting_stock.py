"""Cutting stock by column generation: how many bins of which content hold given counts of item lengths."""

from __future__ import annotations

import numpy as np


def best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of items (lengths 1..len(value)) of the most value within room."""
    best = np.zeros(room + 1)
    last = np.zeros(room + 1, dtype=np.int64)
    for space in range(1, room + 1):
        longest = min(space, len(value))
        total = best[space - longest : space][::-1] + value[:longest]
        item = int(total.argmax())
        if total[item] > best[space - 1]:
            best[space], last[space] = total[item], item + 1
        else:
            best[space] = best[space - 1]
    counts = np.zeros(len(value), dtype=np.int64)
    space = room
    while space > 0:
        if last[space]:
            counts[last[space] - 1] += 1
            space -= last[space]
        else:
            space -= 1
    return float(best[room]), counts


def _first_solution(demand: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """Columns of a basis: bins filled longest first, each used until it exhausts one length.

    A bin never holds a length exhausted before, so the columns are triangular; a length that ran out together
    with another gets bins of its own, used zero times.
    """
    left = demand.astype(float)
    columns, alone = [], np.ones(len(lengths), dtype=bool)
    while left.max() > 0:
        space, column = room, np.zeros(len(lengths))
        for i in np.flatnonzero(left)[::-1]:
            column[i] = space // lengths[i]
            space -= int(column[i]) * lengths[i]
        used = np.flatnonzero(column)
        times = left[used] / column[used]
        first = int(times.argmin())
        left[used] -= times[first] * column[used]
        left[used[first]] = 0
        left[left < 1e-9 * demand] = 0
        alone[used[first]] = False
        columns.append(column)
    for i in np.flatnonzero(alone):
        columns.append(np.eye(len(lengths))[i] * (room // lengths[i]))
    return np.stack(columns, axis=1)


def patterns(demand: np.ndarray, room: int, gap: float = 1e-3, most_rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(counts by length, bins) that hold exactly demand[i] items of length i + 1 in bins of room.

    The linear program over patterns starts from bins filled longest first. The knapsack prices a new pattern, at
    prices drawn half way to the best lower bound's so that they do not swing, and the simplex step takes it in.
    It ends when no pattern pays, or when the value is within gap of the bound. Whole bins are the solution
    rounded down; items left over go, longest first, to the fullest bin they fit.
    """
    lengths = np.flatnonzero(demand) + 1
    if not len(lengths):
        return []
    wanted = demand[lengths - 1].astype(float)
    held = _first_solution(wanted, lengths, room)
    inverse = np.linalg.inv(held)
    amount = np.maximum(inverse @ wanted, 0)
    center = lengths / room
    bound = center @ wanted
    value = np.zeros(int(lengths[-1]))
    for _ in range(most_rounds):
        price = inverse.sum(axis=0)
        for pull in (0.5, 0.0):
            asked = np.maximum(pull * center + (1 - pull) * price, 0)
            value[lengths - 1] = asked
            worth, counts = best_pattern(value, room)
            if asked @ wanted / worth > bound:
                bound, center = asked @ wanted / worth, asked / worth
            column = counts[lengths - 1].astype(float)
            pays = price @ column > 1 + 1e-9
            if pays:
                break
        if not pays or amount.sum() - bound <= max(0.5, gap * amount.sum()):
            break
        change = inverse @ column
        ratio = np.full(len(change), np.inf)
        np.divide(amount, change, out=ratio, where=change > 1e-9)
        out = int(ratio.argmin())
        step = ratio[out]
        amount -= step * change
        amount[out] = step
        np.maximum(amount, 0, out=amount)
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        held[:, out] = column
    return _whole_bins(demand, lengths, room, held, amount)


def _whole_bins(
    demand: np.ndarray, lengths: np.ndarray, room: int, held: np.ndarray, amount: np.ndarray
) -> list[tuple[np.ndarray, int]]:
    left = demand.astype(np.int64).copy()
    result = []
    for i in np.argsort(-amount, kind="stable"):
        counts = np.zeros(len(demand), dtype=np.int64)
        counts[lengths - 1] = held[:, i].astype(np.int64)
        used = np.flatnonzero(counts)
        bins = min(int(np.floor(amount[i] + 1e-6)), int((left[used] // counts[used]).min()))
        if bins > 0:
            left -= counts * bins
            result.append((counts, bins))
    open_bins: list[tuple[int, np.ndarray]] = []
    for length in np.flatnonzero(left)[::-1] + 1:
        for _ in range(int(left[length - 1])):
            fits = [i for i, (space, _) in enumerate(open_bins) if space >= length]
            i = min(fits, key=lambda k: open_bins[k][0], default=-1)
            if i < 0:
                open_bins.append((room, np.zeros(len(demand), dtype=np.int64)))
            space, counts = open_bins[i]
            counts[length - 1] += 1
            open_bins[i] = (space - int(length), counts)
    return result + [(counts, 1) for _, counts in open_bins]
