"""Regular expressions over bytes as minimal deterministic automata in arrays.

A pattern is read into a tree, the tree becomes a nondeterministic automaton, the subset construction makes it
deterministic, and states that no continuation tells apart are merged. Patterns may hold literals, classes of ASCII
characters, groups, ``(?i:...)``, ``|`` and the quantifiers ``? * + {m} {m,} {m,n}``; other signs are refused.
"""

from __future__ import annotations

import numpy as np

#: A byte that no UTF-8 text holds; it takes every automaton that searches back to its start.
SEPARATOR = 0xFF


class _Reader:
    """Pattern to tree: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str) -> None:
        self.left = list(pattern)

    def whole(self):
        tree = self.choice(False)
        if self.left:
            raise ValueError(f"unexpected {self.left[0]!r}")
        return tree

    def choice(self, either_case: bool):
        parts = [self.sequence(either_case)]
        while self.left[:1] == ["|"]:
            self.left.pop(0)
            parts.append(self.sequence(either_case))
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self, either_case: bool):
        parts = []
        while self.left and self.left[0] not in "|)":
            parts.append(self.repeated(self.atom(either_case)))
        return ("cat", parts)

    def repeated(self, part):
        while self.left and self.left[0] in "?*+{":
            sign = self.left.pop(0)
            if sign == "{":
                at = self.left.index("}")
                least, comma, most = "".join(self.left[:at]).partition(",")
                del self.left[: at + 1]
                low, high = int(least), int(most) if most else None if comma else int(least)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            part = ("rep", part, low, high)
        return part

    def atom(self, either_case: bool):
        sign = self.left.pop(0)
        if sign == "(":
            if self.left[:2] == ["?", ":"]:
                del self.left[:2]
            elif self.left[:3] == ["?", "i", ":"]:
                del self.left[:3]
                either_case = True
            tree = self.choice(either_case)
            if self.left[:1] != [")"]:
                raise ValueError("group without an end")
            self.left.pop(0)
            return tree
        if sign == "[":
            return ("set", self.members(either_case))
        if sign in ".^$*+?{":
            raise ValueError(f"{sign!r} is not supported here")
        literal = self.escaped() if sign == "\\" else sign
        return ("cat", [("set", _cased({b}, either_case)) for b in literal.encode("utf-8")])

    def escaped(self) -> str:
        sign = self.left.pop(0)
        if sign == "x":
            code = int("".join(self.left[:2]), 16)
            del self.left[:2]
            return chr(code)
        if sign.isalnum():
            raise ValueError(f"escape {sign!r} is not supported")
        return sign

    def members(self, either_case: bool) -> frozenset[int]:
        found = set()
        if self.left[:1] == ["^"]:
            raise ValueError("negated classes are not supported")
        while self.left[0] != "]":
            first = self._member()
            last = first
            if self.left[0] == "-" and self.left[1] != "]":
                self.left.pop(0)
                last = self._member()
            found |= set(range(first, last + 1))
        self.left.pop(0)
        if max(found) > 127:
            raise ValueError("classes hold ASCII only")
        return _cased(found, either_case)

    def _member(self) -> int:
        sign = self.left.pop(0)
        return ord(self.escaped() if sign == "\\" else sign)


def _cased(members: set[int], either_case: bool) -> frozenset[int]:
    if either_case:
        members = {ord(c) for b in members for c in ((chr(b).lower(), chr(b).upper()) if b < 128 else chr(b))}
    return frozenset(members)


def _reversed(tree):
    if tree[0] == "cat":
        return ("cat", [_reversed(t) for t in tree[1][::-1]])
    if tree[0] == "alt":
        return ("alt", [_reversed(t) for t in tree[1]])
    return ("rep", _reversed(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    """States with moves on sets of bytes and moves on nothing."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The state reached from ``start`` by what ``tree`` matches."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if tree[0] == "alt":
            for part in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(part, begin)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def closures(self) -> list[int]:
        """For each state the bits of all states it reaches on nothing, itself included."""
        out = []
        for s in range(len(self.free)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            out.append(sum(1 << t for t in seen))
        return out


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class Automaton:
    """A minimal deterministic automaton over several patterns.

    ``step[state + kind[byte]]`` is the next state; states are multiples of ``width``. ``accepts[state // width]`` has
    a bit for each pattern that ends there. State 0 is the start. With ``search`` patterns may begin anywhere, and in
    state 0 nothing has begun; without it they begin at once, and ``dead`` is the state from which nothing matches.
    """

    def __init__(self, patterns: list[str], search: bool, backward: bool = False) -> None:
        nfa, begins, ends = _Nfa(), [], []
        for pattern in patterns:
            tree = _Reader(pattern).whole()
            begins.append(nfa.state())
            ends.append(nfa.add(_reversed(tree) if backward else tree, begins[-1]))
        self.kind, members = self._kinds({s for moves in nfa.moves for s, _ in moves})
        closure = nfa.closures()
        reach = [[0] * len(members) for _ in nfa.moves]
        for state, moves in enumerate(nfa.moves):
            for wanted, to in moves:
                for k, byte in enumerate(members):
                    if byte in wanted:
                        reach[state][k] |= closure[to]
        first = 0
        for begin in begins:
            first |= closure[begin]
        step, accepts = self._merged(*self._subsets(reach, len(members), first, search, ends))
        self.width = step.shape[1]
        self.step = (step * self.width).ravel()
        self.accepts = accepts
        idle = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accepts == 0))
        self.dead = -1 if search or not len(idle) else int(idle[0]) * self.width

    @staticmethod
    def _kinds(sets: set[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
        """Bytes that every set treats alike share a kind; the separator has kind 0 alone."""
        order = sorted(sets, key=sorted)
        seen: dict = {"separator": 0}
        kind, members = np.zeros(256, dtype=np.uint8), [SEPARATOR]
        for byte in range(256):
            if byte == SEPARATOR:
                continue
            key = tuple(byte in s for s in order)
            if key not in seen:
                seen[key] = len(members)
                members.append(byte)
            kind[byte] = seen[key]
        return kind, members

    @staticmethod
    def _subsets(reach, kinds: int, first: int, search: bool, ends: list[int]):
        number, order, rows = {first: 0}, [first], []
        for subset in order:
            own = list(_bits(subset))
            row = []
            for k in range(kinds):
                to = first if search else 0
                if k:
                    for state in own:
                        to |= reach[state][k]
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        accepts = np.array([sum(1 << p for p, end in enumerate(ends) if subset >> end & 1) for subset in order], dtype=np.int64)
        return np.array(rows, dtype=np.int64), accepts

    @staticmethod
    def _merged(step: np.ndarray, accepts: np.ndarray):
        """Split blocks of states until all states of a block move to the same blocks; the start stays first."""
        block = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:
            finer = np.unique(np.column_stack((block, block[step])), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        n = int(block.max()) + 1
        rank = np.full(n, -1)
        rank[block[0]] = 0
        rest = np.flatnonzero(rank < 0)
        rank[rest] = 1 + np.arange(len(rest))
        block = rank[block]
        one = np.empty(n, dtype=np.int64)
        one[block] = np.arange(len(block))
        return block[step[one]], accepts[one]


class Searcher:
    """One pass of an automaton that searches over bytes, in lanes that step together."""

    LANE, BLOCK = 256, 1 << 20

    def __init__(self, automaton: Automaton) -> None:
        self.step, self.kind = automaton.step, automaton.kind
        mask = np.repeat(automaton.accepts, automaton.width)
        self.mask, self.ends = mask, mask != 0

    def states(self, data: np.ndarray, enter: int) -> np.ndarray:
        """The state after each byte, from state ``enter`` on.

        Every lane first starts idle. Lanes whose neighbour on the left ended elsewhere run again, only as far
        as the states differ; what is left after some rounds (one long run) is done byte by byte.
        """
        n = len(data)
        lanes = -(-n // self.LANE)
        padded = np.full(lanes * self.LANE, SEPARATOR, dtype=np.uint8)
        padded[:n] = data
        kind = self.kind[padded].reshape(lanes, self.LANE).T.astype(np.int64)
        state = np.zeros(lanes, dtype=np.int64)
        entered = np.zeros(lanes, dtype=np.int64)
        entered[0] = state[0] = enter
        found = np.empty((self.LANE, lanes), dtype=np.int32)
        for i in range(self.LANE):
            state = self.step[state + kind[i]]
            found[i] = state
        for _ in range(4):
            due = np.concatenate(([enter], found[-1, :-1]))
            again = np.flatnonzero(due != entered)
            if not len(again):
                break
            entered[again] = due[again]
            state = due[again].astype(np.int64)
            for i in range(self.LANE):
                state = self.step[state + kind[i, again]]
                other = state != found[i, again]
                again, state = again[other], state[other]
                if not len(again):
                    break
                found[i, again] = state
        self._one_by_one(found, kind, entered, enter)
        return found.T.ravel()[:n]

    def _one_by_one(self, found: np.ndarray, kind: np.ndarray, entered: np.ndarray, enter: int) -> None:
        due = np.concatenate(([enter], found[-1, :-1]))
        done = -1
        for lane in np.flatnonzero(due != entered).tolist():
            while lane > done and lane < len(entered):
                state = int(found[-1, lane - 1]) if lane else enter
                before, kinds, own = found[:, lane].tolist(), kind[:, lane].tolist(), []
                for k, old in zip(kinds, before):
                    state = int(self.step[state + k])
                    if state == old:
                        break
                    own.append(state)
                found[: len(own), lane] = own
                done = lane
                if len(own) < self.LANE:
                    break
                lane += 1

    def regions(self, data: np.ndarray):
        """(start, end, bits of patterns) of the stretches between idle states in which a pattern ends."""
        state, begin, bits = 0, 0, 0
        for at in range(0, len(data), self.BLOCK):
            states = self.states(data[at: at + self.BLOCK], state)
            state = int(states[-1])
            idle = np.flatnonzero(states == 0)
            hits = np.flatnonzero(self.ends[states])
            of = np.searchsorted(idle, hits)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            held = dict(zip(of[first].tolist(), np.bitwise_or.reduceat(self.mask[states[hits]], first).tolist() if len(hits) else []))
            if not len(idle):
                bits |= held.get(0, 0)
                continue
            if bits := bits | held.pop(0, 0):
                yield begin, at + int(idle[0]), bits
            bits = held.pop(len(idle), 0)
            for k, own in held.items():
                yield at + int(idle[k - 1]) + 1, at + int(idle[k]), own
            begin = at + int(idle[-1]) + 1
        if bits:
            yield begin, len(data), bits
