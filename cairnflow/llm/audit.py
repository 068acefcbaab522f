"""Cheapest edits of a sequence of roles, as strings of edits that share their beginnings.

Edits of a row: K keeps it, R gives it the role that is due, D deletes it; I inserts a row of the role that is due. The
roles that come out start with at most one system row and then alternate user, assistant, ending with assistant, or are
none at all. Of equally cheap strings of edits the least in ASCII order counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("user", "assistant")
DUE = (USER, USER, ASSISTANT, USER)
"""The state that an inserted or re-roled row leads to, by the state before it."""
REROLE = INSERT = CLIPPED = 3
DELETE = 4
"""What edits cost; CLIPPED is added for a truncated row that is not deleted."""

Row = tuple[str, bool, bool]
"""Initial of the role, whether the row has to go, whether it is truncated."""
States = list[tuple[int, int] | None]


class Trails:
    """Strings as paths to a root: each node has its last letter, its ancestors 1, 2, 4, ... letters back and the rolling
    hash of the whole string. Two strings are compared at the end of their longest common prefix, which hashes of
    ancestors find; equal hashes are then confirmed letter by letter, as far as the paths are not known to be equal, so
    that over all comparisons every node is confirmed about once."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus = modulus
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[0]]
        self.equal = [0]

    def add(self, parent: int, letter: str) -> int:
        node, up = len(self.letter), [parent]
        while len(up) <= len(self.up[up[-1]]) and up[-1]:
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * 257 + ord(letter)) % self.modulus)
        self.up.append(up)
        self.equal.append(node)
        return node

    def lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            up, gap = self.up[node], self.depth[node] - depth
            node = up[min(gap.bit_length() - 1, len(up) - 1)]
        return node

    def known(self, node: int) -> int:
        """The node that stands for all those known to spell the same string."""
        while self.equal[node] != node:
            self.equal[node] = self.equal[self.equal[node]]
            node = self.equal[node]
        return node

    def split(self, a: int, b: int) -> tuple[int, int] | None:
        """Of two nodes of one depth, the ancestors at the first letter that differs; None if they spell the same."""
        walked, first = [], None
        while self.known(a) != self.known(b):
            if self.letter[a] != self.letter[b]:
                first, walked = (a, b), []
            walked.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        if first is None:
            for x, y in walked:
                self.equal[self.known(x)] = self.known(y)
        return first

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.hash[x] != self.hash[y]:
            k = len(self.up[x])
            while k:
                k -= 1
                if k < min(len(self.up[x]), len(self.up[y])) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            x_before, y_before = self.up[x][0], self.up[y][0]
            found = self.split(x_before, y_before) or (x, y)
        else:
            found = self.split(x, y)
        if found is None:
            return self.depth[a] < self.depth[b]
        return self.letter[found[0]] < self.letter[found[1]]

    def spelled(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Repair:
    """The cheapest edits from one state to every other, over the rows given so far."""

    def __init__(self, state: int = START, opening: bool = True, trails: Trails | None = None):
        """opening: whether rows may be inserted before the first one, as at the start of a conversation."""
        self.trails = trails or Trails()
        self.states: States = [None] * 4
        self.states[state] = (0, 0)
        if opening:
            self._insert()

    def _offer(self, states: States, state: int, cost: int, parent: int, letter: str) -> None:
        old = states[state]
        if old is not None and old[0] < cost:
            return
        node = self.trails.add(parent, letter)
        if old is None or cost < old[0] or self.trails.less(node, old[1]):
            states[state] = (cost, node)

    def _insert(self) -> None:
        """Inserted rows, from the cheapest state on; inserting is never free, so a state is settled when it is its turn."""
        left = {0, 1, 2, 3}
        while reached := [s for s in left if self.states[s] is not None]:
            s = min(reached, key=lambda s: self.states[s][0])
            left.discard(s)
            cost, node = self.states[s]
            if DUE[s] in left:
                self._offer(self.states, DUE[s], cost + INSERT, node, "I")

    def row(self, initial: str, gone: bool, truncated: bool) -> None:
        states: States = [None] * 4
        extra = CLIPPED if truncated else 0
        for s, best in enumerate(self.states):
            if best is None:
                continue
            cost, node = best
            self._offer(states, s, cost + DELETE, node, "D")
            if gone:
                continue
            self._offer(states, DUE[s], cost + REROLE + extra, node, "R")
            if initial == "s" and s == START:
                self._offer(states, SYSTEM, cost + extra, node, "K")
            elif initial == ("a" if DUE[s] == ASSISTANT else "u"):
                self._offer(states, DUE[s], cost + extra, node, "K")
        self.states = states
        self._insert()

    def ends(self) -> list[tuple[int, str] | None]:
        """Cost and edits to every state."""
        return [None if best is None else (best[0], self.trails.spelled(best[1])) for best in self.states]


def best_end(ends: Sequence[tuple[int, str] | None]) -> int:
    """The state to end in: nothing came out, or an assistant's row was the last."""
    return min((s for s in (START, ASSISTANT) if ends[s] is not None), key=lambda s: ends[s])


def repaired(rows: Iterable[Row], trails: Trails | None = None) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    run = Repair(trails=trails)
    for r in rows:
        run.row(*r)
    ends = run.ends()
    return ends[best_end(ends)]


def applied(audit: str, rows: Iterable[dict], state: int = START) -> list[dict]:
    """The rows (turn, role, text) that edits give, each with its edit; inserted ones have no turn and no text."""
    out, source = [], iter(rows)
    for edit in audit:
        row = {"turn": None, "text": "", "role": ""} if edit == "I" else dict(next(source))
        if edit == "D":
            continue
        if edit in "IR":
            row["role"] = ROLES[DUE[state] == ASSISTANT]
        state = SYSTEM if edit == "K" and state == START and row["role"][:1] == "s" else DUE[state]
        out.append(row | {"edit": edit})
    return out
