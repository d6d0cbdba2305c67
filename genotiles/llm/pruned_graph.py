"""A directed neighbour graph over the vectors of one shard, pruned robustly, searched by a beam. Whole batches with numpy.

Largest inner product becomes smallest distance by one more coordinate: with all vectors scaled into the unit ball, a
point gets sqrt(1 - |x|^2) and a query 0, so their squared distance is a constant less twice the inner product.
"""

from __future__ import annotations

import numpy as np

#: Points inserted, and queries searched, together.
_BATCH = 256


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Points scaled into the unit ball and lifted to its sphere (float32; vectors are finite, not zero)."""
    size = np.abs(vectors).max()
    x = vectors / size
    square = np.einsum("ij,ij->i", x, x)
    rest = np.sqrt(np.maximum(square.max() - square, 0))
    return np.concatenate((x, rest[:, None]), axis=1).astype(np.float32) / np.float32(np.sqrt(square.max()))


class PrunedGraph:
    """Out-neighbours of every point; -1 fills rows that have fewer than degree."""

    def __init__(
        self, points: np.ndarray, degree: int, beam: int, relax: float, near: np.ndarray | None = None,
        starts: np.ndarray | None = None, seed: int = 7,
    ):
        """Build the graph, or take a built one's near and starts."""
        self.points, self.degree, self.beam, self.relax = points, degree, beam, np.float32(relax)
        n = len(points)
        self.square = np.einsum("ij,ij->i", points, points)
        if near is not None:
            self.near, self.starts = near, starts
            return
        self.near = np.full((n, degree), -1, np.int64)
        self.entry = int(np.argmin(self.square - 2 * points @ points.mean(axis=0)))
        self.starts = np.array([self.entry])
        order = np.random.default_rng(seed).permutation(n)
        # The entry comes first; each batch is inserted into the graph of those before, and batches double.
        order = np.concatenate(([self.entry], order[order != self.entry]))
        done, size = 1, 8
        while done < n:
            self._insert(order[done : done + size], order[:done])
            done += size
            size = min(2 * size, _BATCH)
        self.starts = self._starts()

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, but for the queries' squares, of rows of ids (-1: infinite) to their row's query."""
        found = self.points[ids]
        away = self.square[ids] - 2 * np.matmul(found, q[:, :, None])[:, :, 0]
        away[ids < 0] = np.inf
        return away

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam nearest points found for every query, nearest first; -1 and infinity fill rows.

        Every round opens the width nearest unopened points of each beam; a search ends when its beam is all open.
        """
        rows = len(q)
        seen = np.zeros((rows, len(self.points) + 1), dtype=bool)
        seen[:, -1] = True
        seen[:, self.starts] = True
        from_start = self._distance(q, np.broadcast_to(self.starts, (rows, len(self.starts))))
        first = np.argsort(from_start, axis=1, kind="stable")[:, :beam]
        fill = ((0, 0), (0, beam - first.shape[1]))
        ids = np.pad(self.starts[first], fill, constant_values=-1)
        away = np.pad(np.take_along_axis(from_start, first, 1), fill, constant_values=np.inf)
        opened = ids < 0
        live = np.arange(rows)
        while len(live):
            closed = ~opened[live]
            turn = closed & (np.cumsum(closed, axis=1) <= width)
            some = turn.any(axis=1)
            live, turn = live[some], turn[some]
            if not len(live):
                break
            first = np.argsort(~turn, axis=1, kind="stable")[:, :width]
            chosen = np.where(np.take_along_axis(turn, first, 1), np.take_along_axis(ids[live], first, 1), -1)
            opened[live] |= turn
            fresh = np.where((chosen >= 0)[:, :, None], self.near[chosen], -1).reshape(len(live), -1)
            fresh[seen[live[:, None], fresh]] = -1
            # The same point from two opened ones counts once.
            fresh = -np.sort(-fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            used = max(1, int((fresh >= 0).sum(axis=1).max()))
            fresh = -np.sort(-fresh, axis=1)[:, :used]
            seen[live[:, None], fresh] = True
            all_ids = np.concatenate((ids[live], fresh), axis=1)
            all_away = np.concatenate((away[live], self._distance(q[live], fresh)), axis=1)
            all_open = np.concatenate((opened[live], fresh < 0), axis=1)
            order = np.argsort(all_away, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, order, 1)
            away[live] = np.take_along_axis(all_away, order, 1)
            opened[live] = np.take_along_axis(all_open, order, 1)
        return ids, away

    def _starts(self) -> np.ndarray:
        """The entry, and one more point for each part of the graph that no path from those before reaches."""
        reached = np.zeros(len(self.points) + 1, dtype=bool)
        reached[-1] = True
        starts, front = [self.entry], np.array([self.entry])
        while True:
            while len(front):
                reached[front] = True
                front = np.unique(self.near[front])
                front = front[~reached[front]]
            if reached.all():
                return np.array(starts)
            front = np.flatnonzero(~reached)[:1]
            starts.append(int(front[0]))

    def _prune(self, rows: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most degree diverse ones of each row's distinct candidates (-1 fills).

        The nearest is kept and takes out all candidates that lie nearer to it, by the factor relax, than to the row's
        point; then the nearest of what is left, and so on.
        """
        own = self.points[rows]
        from_own = np.maximum(self._distance(own, candidates) + self.square[rows][:, None], 0)
        order = np.argsort(from_own, axis=1, kind="stable")
        candidates, from_own = np.take_along_axis(candidates, order, 1), np.take_along_axis(from_own, order, 1)
        found = self.points[candidates]
        square = self.square[candidates]
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(found, found.transpose(0, 2, 1))
        alive = np.isfinite(from_own)
        kept = np.full((len(rows), self.degree), -1, np.int64)
        line = np.arange(len(rows))
        for place in range(self.degree):
            if not alive.any():
                break
            pick = alive.argmax(axis=1)
            has = alive[line, pick]
            kept[has, place] = candidates[line, pick][has]
            alive &= ~((self.relax**2 * between[line, pick] <= from_own) & has[:, None])
            alive[line, pick] = False
        return kept

    def _insert(self, batch: np.ndarray, before: np.ndarray) -> None:
        """Points get pruned edges to what a search for them meets, and edges back."""
        if len(before) <= self.beam:
            candidates = np.broadcast_to(before, (len(batch), len(before)))
        else:
            candidates, _ = self.search(self.points[batch], self.beam)
        self.near[batch] = self._prune(batch, candidates)
        source, target = np.repeat(batch, self.degree), self.near[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        count = np.diff(np.concatenate((first, [len(target)])))
        rank = np.arange(len(target)) - np.repeat(first, count)
        # Edges back beyond one round's width come in the next, so that no point is pruned among thousands at once.
        for low in range(0, int(count.max()), self.degree):
            part = (rank >= low) & (rank < low + self.degree)
            rows, at = np.unique(target[part], return_inverse=True)
            more = np.full((len(rows), self.degree), -1, np.int64)
            more[at, rank[part] - low] = source[part]
            both = np.concatenate((self.near[rows], more), axis=1)
            full = (both >= 0).sum(axis=1) > self.degree
            both[~full] = -np.sort(-both[~full], axis=1)
            self.near[rows[~full]] = both[~full, : self.degree]
            if full.any():
                self.near[rows[full]] = self._prune(rows[full], both[full])
