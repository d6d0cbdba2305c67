"""Cheapest repairs of a run of conversation rows, with the least audit among equals.

An audit is a string of edits: K keep, R change the role, D delete, I insert. Rows and audits meet in four states, by
the roles kept so far: 0 none, 1 a system row, 2 a user row last, 3 an assistant row last. 0 and 3 may end a conversation.

Audits are linked nodes: an edit and the node before it, so audits with the same beginning share it. A node knows its
ancestors 1, 2, 4, … edits back and a rolling hash of its audit; two audits of equal cost are compared by the
longest beginning they share, found by halving over the ancestors' hashes, and a beginning taken for shared
is compared edit by edit once, so that a collision of hashes changes nothing.

Two audits of the same rows and cost never continue one another: the longer would hold more inserts and cost more. So
the order of two such audits is also that of all their continuations, and a state needs its least one only.
"""

from __future__ import annotations

STATES = 4
KEEP, RENAME, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a truncated row that stays.
RENAME_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Rows by letter: s, u, a by the initial of the role, o for others; capital where the row is truncated; x must go.
FORCED = "x"
#: Where keeping a row of that initial leads, and a row (or an insert) made a user's or an assistant's.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
_MADE = {0: 2, 1: 2, 2: 3, 3: 2}
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51

#: What a state holds: cost and node.
State = tuple[int, int] | None


def _options(letter: str) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state after a row of that letter: (state before, cost, edit) of all edits that lead there."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(STATES)]
    for state in range(STATES):
        out[state].append((state, DELETE_COST, DELETE))
        if letter != FORCED:
            more = TRUNCATED_COST if letter.isupper() else 0
            kept = _KEPT[letter.lower()].get(state)
            if kept is not None:
                out[kept].append((state, more, KEEP))
            out[_MADE[state]].append((state, RENAME_COST + more, RENAME))
    return tuple(map(tuple, out))


_ROWS = {letter: _options(letter) for letter in "suaoSUAO" + FORCED}


class Audits:
    """Audits as linked nodes; node 0 is the empty audit."""

    def __init__(self):
        self.edit = [""]
        self.depth = [0]
        self.hash = [0]
        #: Ancestors 1, 2, 4, … edits back, as far as there are any.
        self.back: list[list[int]] = [[]]
        #: Nodes whose audits were compared and found equal, by the node that stands for them.
        self.same: dict[int, int] = {}

    def add(self, before: int, edit: str) -> int:
        node = len(self.edit)
        self.edit.append(edit)
        self.depth.append(self.depth[before] + 1)
        self.hash.append((self.hash[before] * _BASE + ord(edit)) % _PRIME)
        back, at, level = [before], before, 0
        while level < len(self.back[at]):
            at = self.back[at][level]
            back.append(at)
            level += 1
        self.back.append(back)
        return node

    def spelled(self, node: int) -> str:
        edits = []
        while node:
            edits.append(self.edit[node])
            node = self.back[node][0]
        return "".join(reversed(edits))

    def _ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.back[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _stand_in(self, node: int) -> int:
        while node in self.same:
            node = self.same[node]
        return node

    def _equal(self, x: int, y: int) -> bool:
        """Whether two audits of one length are equal, edit by edit; what was compared before is not again."""
        met = []
        x, y = self._stand_in(x), self._stand_in(y)
        while x != y:
            if self.edit[x] != self.edit[y]:
                return False
            met.append((x, y))
            x, y = self._stand_in(self.back[x][0]), self._stand_in(self.back[y][0])
        for x, y in met:
            self.same[x] = y
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of x comes before that of y."""
        shorter = self.depth[x] < self.depth[y]
        depth = min(self.depth[x], self.depth[y])
        p, q = self._ancestor(x, depth), self._ancestor(y, depth)
        if self.hash[p] == self.hash[q]:
            return shorter if self._equal(p, q) else self.spelled(x) < self.spelled(y)
        level = depth.bit_length()
        while level:
            level -= 1
            if level < len(self.back[p]):
                above, beside = self.back[p][level], self.back[q][level]
                if self.hash[above] != self.hash[beside]:
                    p, q = above, beside
        # The edits of p and q differ, and what is before them has one hash.
        if self._equal(self.back[p][0], self.back[q][0]):
            return self.edit[p] < self.edit[q]
        return self.spelled(x) < self.spelled(y)


def _better(audits: Audits, found: State, cost: int, before: int, edit: str) -> State:
    if found is None or cost < found[0]:
        return cost, audits.add(before, edit)
    if cost > found[0]:
        return found
    node = audits.add(before, edit)
    return (cost, node) if audits.less(node, found[1]) else found


def _inserted(audits: Audits, at: list[State]) -> None:
    """Rows may be inserted: one, or a user's and an assistant's."""
    for before, after in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if at[before] is not None:
            cost, node = at[before]
            at[after] = _better(audits, at[after], cost + INSERT_COST, node, INSERT)


def beginning(audits: Audits) -> list[State]:
    """Before the first row: nothing yet, or inserted rows."""
    at: list[State] = [(0, 0), None, None, None]
    _inserted(audits, at)
    return at


def after_rows(rows: str, at: list[State], audits: Audits) -> list[State]:
    """The cheapest and then least audits in every state after the rows."""
    for letter in rows:
        new: list[State] = [None] * STATES
        for state, options in enumerate(_ROWS[letter]):
            best: State = None
            for before, cost, edit in options:
                held = at[before]
                if held is not None:
                    best = _better(audits, best, held[0] + cost, held[1], edit)
            new[state] = best
        _inserted(audits, new)
        at = new
    return at


#: (state before or -1 for a conversation's beginning, state after, cost, audit)
Passage = tuple[int, int, int, str]


def passages(rows: str, begins: bool) -> list[Passage]:
    """What rows do to every state they may be met in."""
    out = []
    for start in (-1,) if begins else range(STATES):
        audits = Audits()
        at: list[State] = beginning(audits) if begins else [(0, 0) if s == start else None for s in range(STATES)]
        out += [(start, end, held[0], audits.spelled(held[1])) for end, held in enumerate(after_rows(rows, at, audits)) if held]
    return out


def joined(segments: list[list[Passage]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation from the passages of its segments, in order.

    What each state holds is known as (rank, inserts): audits less the inserts at their end are all told apart
    by their rank, as none of them continues another. So only the strings of one segment are compared at a time.
    """
    held = {-1: (0, 0, 0)}
    if not segments or segments[0][0][0] != -1:
        held = {0: (0, 0, 0), 2: (INSERT_COST, 0, 1), 3: (2 * INSERT_COST, 0, 2)}
    first = {state: INSERT * inserts for state, (_, _, inserts) in held.items()}
    trail: list[dict[int, tuple[int, str]]] = []
    for segment in segments:
        best: dict[int, tuple[int, int, str, int, str]] = {}
        for start, end, cost, audit in segment:
            if start in held:
                before, rank, inserts = held[start]
                offer = (before + cost, rank, INSERT * inserts + audit, start, audit)
                if end not in best or offer < best[end]:
                    best[end] = offer
        bases = {end: (offer[1], offer[2].rstrip(INSERT)) for end, offer in best.items()}
        rank_of = {base: n for n, base in enumerate(sorted(set(bases.values())))}
        held = {end: (offer[0], rank_of[bases[end]], len(offer[2]) - len(bases[end][1])) for end, offer in best.items()}
        trail.append({end: (offer[3], offer[4]) for end, offer in best.items()})
    cost, _, _, state = min((c, rank, inserts, s) for s, (c, rank, inserts) in held.items() if s in (-1, 0, 3))
    audit = []
    for step in reversed(trail):
        state, edits = step[state]
        audit.append(edits)
    audit.append(first[state])
    return cost, "".join(reversed(audit))
