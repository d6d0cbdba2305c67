"""Token ends of two tokenizers over the same texts: their common ends by galloping, groups and links. Numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pairs of a group made one by one; larger groups are reduced to distinct ids first.
_SMALL_GROUP = 4096
#: Pairs held at once before equal ones are united.
_PAIRS = 1 << 22


def gallop(hay: np.ndarray, needles: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first index in [low, high) whose entry reaches its needle, searched outwards from start. All needles at once.

    hay ascends within every range and the range's last entry reaches the needle. Steps double until the
    needle is enclosed, then the enclosed range is halved.
    """
    above = hay[start] >= needles
    # Entries before `under` are too small; the entry at `over` is large enough.
    under, over = np.where(above, low, start + 1), np.where(above, start, high - 1)
    step, active = 1, np.arange(len(needles))
    while len(active):
        up = above[active]
        probe = np.where(up, start[active] - step, start[active] + step)
        inside = (probe >= under[active]) & (probe < over[active])
        active, probe, up = active[inside], probe[inside], up[inside]
        reaches = hay[probe] >= needles[active]
        over[active[reaches]] = probe[reaches]
        under[active[~reaches]] = probe[~reaches] + 1
        active = active[reaches == up]
        step *= 2
    active = np.flatnonzero(under < over)
    while len(active):
        middle = (under[active] + over[active]) >> 1
        reaches = hay[middle] >= needles[active]
        over[active[reaches]] = middle[reaches]
        under[active[~reaches]] = middle[~reaches] + 1
        active = active[under[active] < over[active]]
    return over


def within(count: np.ndarray) -> np.ndarray:
    """0, 1, … count - 1 for every entry, one after another."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Alignment:
    """Groups of the tokens of several texts: tokens before each group's end, and groups before each text's end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    groups: np.ndarray

    @property
    def a_count(self) -> np.ndarray:
        return np.diff(self.a_ends, prepend=0)

    @property
    def b_count(self) -> np.ndarray:
        return np.diff(self.b_ends, prepend=0)


def align(
    a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, a_texts: np.ndarray, b_texts: np.ndarray
) -> Alignment:
    """Groups between common ends. a, b: ids; sizes: bytes of each token; a_texts, b_texts: tokens before each text's end.

    The bytes of both sides are equal, so running sums over all texts tell the same places. In each text
    the shorter list of ends drives the search in the longer one, from the place in proportion to its rank.
    """
    a_at, b_at = np.cumsum(a_size), np.cumsum(b_size)
    a_n, b_n = np.diff(a_texts, prepend=0), np.diff(b_texts, prepend=0)
    common_a, common_b = [], []
    for drive, other, drive_at, other_at, chosen in (
        ((a_n, a_texts), (b_n, b_texts), a_at, b_at, a_n <= b_n), ((b_n, b_texts), (a_n, a_texts), b_at, a_at, b_n < a_n),
    ):
        count, length = drive[0][chosen], other[0][chosen]
        first, low = drive[1][chosen] - count, other[1][chosen] - length
        rank = within(count)
        low, length = np.repeat(low, count), np.repeat(length, count)
        token = rank + np.repeat(first, count)
        needles = drive_at[token]
        found = gallop(other_at, needles, low + rank * length // np.repeat(np.maximum(count, 1), count), low, low + length)
        hit = other_at[found] == needles
        pair = (token[hit], found[hit])
        common_a.append(pair[0] if drive_at is a_at else pair[1])
        common_b.append(pair[1] if drive_at is a_at else pair[0])
    a_ends, b_ends = np.sort(np.concatenate(common_a)) + 1, np.sort(np.concatenate(common_b)) + 1
    return Alignment(a, b, a_ends, b_ends, np.searchsorted(a_ends, a_texts, side="right"))


def digit_table(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 … ids - 1 from the left, with room for a mark after them, and how many there are."""
    numbers = np.arange(ids)
    size = np.char.str_len(numbers.astype(str)).astype(np.int64)
    width = int(size[-1])
    table = np.zeros((ids, width + 1), np.uint8)
    for place in range(width):
        digit = numbers // 10 ** np.maximum(size - 1 - place, 0) % 10 + 48
        table[place < size, place] = digit[place < size]
    return table, size


def spelled_groups(found: Alignment, digits: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """The groups of all texts as `a1,a2|b1;a3|b2,b3;`, and how many bytes each text's end is at."""
    table, size = digits
    a_n, b_n = found.a_count, found.b_count
    total = a_n + b_n
    place = within(total)
    is_a = place < np.repeat(a_n, total)
    ids = np.empty(len(place), np.int64)
    ids[is_a], ids[~is_a] = found.a, found.b
    mark = np.full(len(place), ord(","), np.uint8)
    ends = np.cumsum(total)
    mark[ends - 1], mark[ends - total + a_n - 1] = ord(";"), ord("|")
    rows, width = table[ids], size[ids]
    rows[np.arange(len(ids)), width] = mark
    text = rows[np.arange(table.shape[1]) <= width[:, None]]
    bytes_to = np.concatenate(([0], np.cumsum(width + 1)))
    return text.tobytes(), bytes_to[np.concatenate(([0], ends))[found.groups]]


def _united(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(count[order], first) if len(keys) else count


def linked_pairs(found: Alignment, b_ids: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text << bits | a * b_ids + b, number of such links), ascending: every text's distinct linked id pairs."""
    a_n, b_n = found.a_count, found.b_count
    a_first, b_first = found.a_ends - a_n, found.b_ends - b_n
    text = np.repeat(np.arange(len(found.groups)), np.diff(found.groups, prepend=0))
    pairs = a_n * b_n
    keys, counts = [], []
    small = np.flatnonzero(pairs <= _SMALL_GROUP)
    chunk = np.cumsum(pairs[small]) // _PAIRS
    for g in np.split(small, np.flatnonzero(np.diff(chunk)) + 1):
        n = pairs[g]
        place, wide = within(n), np.repeat(b_n[g], n)
        a = found.a[np.repeat(a_first[g], n) + place // wide].astype(np.int64)
        b = found.b[np.repeat(b_first[g], n) + place % wide]
        key, count = _united((np.repeat(text[g], n) << bits) | (a * b_ids + b), np.ones(len(place), np.int64))
        keys.append(key)
        counts.append(count)
    for g in np.flatnonzero(pairs > _SMALL_GROUP):
        a, a_times = np.unique(found.a[a_first[g] : found.a_ends[g]].astype(np.int64), return_counts=True)
        b, b_times = np.unique(found.b[b_first[g] : found.b_ends[g]], return_counts=True)
        keys.append(((text[g] << bits) | (a[:, None] * b_ids + b)).reshape(-1))
        counts.append((a_times[:, None] * b_times).reshape(-1))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _united(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 1 else (keys[0], counts[0])
