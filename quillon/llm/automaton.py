"""Deterministic automata over bytes: rule regexes to one NFA, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ALL = (1 << 256) - 1


@dataclass(frozen=True)
class Automaton:
    """step[256 * state + byte] is the next state; accept[state] has bit r set where rule r has matched; state 0 starts.

    In a search automaton a state with a match keeps the rules that matched first (they stay set whatever follows, and no
    other rule is followed further: each segment with a match must be resolved for every rule). dead is the
    state from which nothing can match, or -1.
    """

    step: np.ndarray
    accept: np.ndarray
    dead: int
    _lists: list = field(default_factory=list, compare=False)

    def lists(self) -> tuple[list[int], list[int]]:
        """step and accept as lists, for walks of single bytes."""
        if not self._lists:
            self._lists.append((self.step.tolist(), self.accept.tolist()))
        return self._lists[0]

    @property
    def states(self) -> int:
        return len(self.accept)

    def resets(self) -> np.ndarray:
        """For each byte, whether it leads from every state without a match back to the start."""
        table = self.step.reshape(-1, 256)
        return (table[self.accept == 0] == 0).all(axis=0)


class Parser:
    """Regexes of bytes: literals, \\ escapes (\\xHH, \\n, \\t, \\r), classes, '.', groups, '|', and greedy ?, *, +, {m}, {m,}, {m,n}.

    A node is ("set", bytes as bits), ("cat", nodes), ("alt", nodes) or ("rep", least, most or None, node).
    """

    NAMED = {"n": 10, "t": 9, "r": 13}

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def parse(self) -> tuple:
        node = self._alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unmatched {self.text[self.at]} at {self.at}")
        return node

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _next(self) -> str:
        if self.at == len(self.text):
            raise ValueError("the pattern ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def _alternatives(self) -> tuple:
        branches = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def _sequence(self) -> tuple:
        parts = []
        while (c := self._peek()) and c not in "|)":
            parts.append(self._repeated(self._atom()))
        return ("cat", parts)

    def _atom(self) -> tuple:
        c = self._next()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self._alternatives()
            if self._next() != ")":
                raise ValueError("a group is not closed")
            return node
        if c == "[":
            return ("set", self._class())
        if c == ".":
            return ("set", ALL & ~(1 << 10))
        if c in "*+?{^$":
            raise ValueError(f"no automaton for {c} at {self.at - 1}")
        return ("set", self._folded(1 << (self._escape() if c == "\\" else self._code(c))))

    def _code(self, c: str) -> int:
        if ord(c) > 127:
            raise ValueError("only ASCII patterns")
        return ord(c)

    def _escape(self) -> int:
        c = self._next()
        if c == "x":
            return int(self._next() + self._next(), 16)
        if c.isalnum() and c not in self.NAMED:
            raise ValueError(f"no automaton for \\{c}")
        return self.NAMED.get(c, self._code(c))

    def _class(self) -> int:
        negated = self._peek() == "^"
        self.at += negated
        out, first = 0, True
        while first or self._peek() != "]":
            first = False
            low = self._member()
            high = low
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._member()
            out |= sum(1 << x for x in range(low, high + 1))
        self.at += 1
        out = self._folded(out)
        return ALL & ~out if negated else out

    def _member(self) -> int:
        c = self._next()
        return self._escape() if c == "\\" else self._code(c)

    def _folded(self, mask: int) -> int:
        if self.fold:
            for upper, lower in zip(range(65, 91), range(97, 123), strict=True):
                if mask >> upper & 1 or mask >> lower & 1:
                    mask |= 1 << upper | 1 << lower
        return mask

    def _repeated(self, node: tuple) -> tuple:
        while (c := self._peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                node = ("rep", int(low), int(high) if high else None if comma else int(low), node)
            else:
                node = ("rep", int(c == "+"), 1 if c == "?" else None, node)
        return node


class _Nfa:
    def __init__(self, backward: bool = False):
        self.free: list[list[int]] = []  # moves without a byte
        self.edges: list[list[tuple[int, int]]] = []  # (set of bytes as bits, to)
        self.backward = backward

    def state(self) -> int:
        self.free.append([])
        self.edges.append([])
        return len(self.free) - 1

    def add(self, node: tuple, at: int) -> int:
        """Adds a parsed regex from state `at`; returns its end state. backward: it reads its matches from their ends."""
        if node[0] == "set":
            to = self.state()
            self.edges[at].append((node[1], to))
            return to
        if node[0] == "cat":
            for part in reversed(node[1]) if self.backward else node[1]:
                at = self.add(part, at)
            return at
        if node[0] == "alt":
            end = self.state()
            for branch in node[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self.add(branch, start)].append(end)
            return end
        _, low, high, body = node
        for _ in range(low):
            at = self.add(body, at)
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(body, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.free[at].append(end)
            at = self.add(body, at)
        self.free[at].append(end)
        return end


def compile_rules(patterns: list[tuple[str, bool]], search: bool, marks: bool = False) -> Automaton:
    """(regex over ASCII, letters in either case) for each rule. search: matches may start at any byte. marks: the automaton
    reads a text from its end, and accepts at each byte at which some match of the rule begins."""
    nfa = _Nfa(marks)
    root = nfa.state()
    ends: dict[int, int] = {}
    for rule, (pattern, fold) in enumerate(patterns):
        start = nfa.state()
        nfa.free[root].append(start)
        ends[nfa.add(Parser(pattern, fold).parse(), start)] = 1 << rule

    # bytes that no edge tells apart share a class
    sets = sorted({mask for edges in nfa.edges for mask, _ in edges})
    by_class: dict[tuple, list[int]] = {}
    for b in range(256):
        by_class.setdefault(tuple(m >> b & 1 for m in sets), []).append(b)
    classes = list(by_class.values())

    def closed(state: int) -> int:
        out, todo = 0, [state]
        while todo:
            if not out >> (s := todo.pop()) & 1:
                out |= 1 << s
                todo += nfa.free[s]
        return out

    # sets of NFA states are bits of an int; moves[s][c]: the closed set that state s reaches by class c
    closure = [closed(s) for s in range(len(nfa.free))]
    moves = [[0] * len(classes) for _ in nfa.free]
    for s, edges in enumerate(nfa.edges):
        for mask, to in edges:
            for c, group in enumerate(classes):
                if mask >> group[0] & 1:
                    moves[s][c] |= closure[to]
    busy = sum(1 << s for s, edges in enumerate(nfa.edges) if edges)  # the others have no moves of their own

    final = sum(1 << s for s in ends)

    def matched(states: int) -> int:
        return sum(bit for s, bit in ends.items() if states >> s & 1) if states & final else 0

    start = closure[root]
    number, order, rows, accept = {(start, 0): 0}, [(start, 0)], [], []
    for states, had in order:
        accept.append(had if search else matched(states))
        row, todo, to = [], states & busy, [start if marks or search and not had else 0] * len(classes)
        while todo:
            low = todo & -todo
            todo ^= low
            to = [x | y for x, y in zip(to, moves[low.bit_length() - 1], strict=True)]
        for target in to:
            got = had | matched(target) if search else 0
            key = (0, got) if got else (target, 0)  # a segment with a match is looked at again for every rule: no more need be known
            if key not in number:
                number[key] = len(order)
                order.append(key)
            row.append(number[key])
        rows.append(row)
    return _minimised(np.array(rows, np.int64), np.array(accept, np.int64), classes)


def _minimised(rows: np.ndarray, accept: np.ndarray, classes: list[list[int]]) -> Automaton:
    """Refines the partition by what is accepted until no class of states splits; state 0 stays first."""
    _, part = np.unique(accept, return_inverse=True)
    mix = np.random.default_rng(7).integers(1, 2**63, rows.shape[1] + 1, dtype=np.uint64) | np.uint64(1)
    while True:
        seen = part.astype(np.uint64) * mix[0]
        for c in range(rows.shape[1]):
            seen += part[rows[:, c]].astype(np.uint64) * mix[c + 1]
        _, finer = np.unique(seen, return_inverse=True)
        if finer.max() == part.max():
            break
        part = finer
    kept, first = np.unique(part, return_index=True)
    if not (part[rows] == part[rows[first]][part]).all():
        raise ValueError("two classes of states met under one hash")
    rank = np.argsort(np.argsort(first))  # classes in order of their first state
    part, first = rank[part], np.sort(first)
    step = np.zeros((len(kept), 256), np.int32)
    for c, group in enumerate(classes):
        step[:, group] = part[rows[first, c]][:, None]
    acc = accept[first]
    loops = [s for s in range(len(kept)) if acc[s] == 0 and (step[s] == s).all()]
    return Automaton(step.ravel(), acc.astype(np.uint32), loops[0] if loops else -1)


def longest(a: Automaton, data: bytes, start: int, end: int, state: int = 0, best: int = -1) -> int:
    """End of the longest match that begins at start, or -1. For an automaton compiled without search."""
    (step, accept), dead = a.lists(), a.dead
    for i in range(start, end):
        state = step[(state << 8) + data[i]]
        if state == dead:
            break
        if accept[state]:
            best = i + 1
    return best


#: With fewer texts than this in step, they are scanned one after the other.
FEW = 24


def longest_all(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """longest() for each start and end, all in step."""
    best, at, left = np.full(len(starts), -1, np.int64), starts, np.flatnonzero(starts < ends)
    state, t = np.zeros(len(left), np.int32), 0
    while len(left) >= FEW:
        state = a.step[(state << 8) + data[at[left] + t]]
        t += 1
        best[left[a.accept[state] > 0]] = t
        go = (state != a.dead) & (at[left] + t < ends[left])
        left, state = left[go], state[go]
    best[best >= 0] += starts[best >= 0]
    for i, s in zip(left.tolist(), state.tolist(), strict=True):
        first, end = int(at[i]) + t, int(ends[i])
        stop = longest(a, data[first:end].tobytes(), 0, end - first, s)
        best[i] = first + stop if stop >= 0 else best[i]
    return best


def _by_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of segments by length, longest first, and how many are longer than t, for each t."""
    order = np.argsort(starts - ends, kind="stable")
    left = ends - starts
    return order, len(left) - np.cumsum(np.bincount(left, minlength=1)) if len(left) else np.zeros(1, np.int64)


def scan(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rules matched (as bits) in each segment [start, end) of data, all segments in step, one pass over the bytes."""
    found = np.zeros(len(starts), np.uint32)
    order, live = _by_length(starts, ends)
    at, left = starts[order].astype(np.int64), (ends - starts)[order]
    state = np.zeros(len(order), np.int32)
    t = 0
    while t < len(live) and live[t] >= FEW:
        k = live[t]
        state[:k] = a.step[(state[:k] << 8) + data[at[:k] + t]]
        t += 1
    if t < len(live):
        step, _ = a.lists()
        for i in range(live[t]):
            s = int(state[i])
            for b in data[at[i] + t : at[i] + left[i]].tobytes():
                s = step[(s << 8) + b]
            state[i] = s
    found[order] = a.accept[state]
    return found


def beginnings(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the segments at which a match begins, ascending. For an automaton compiled with marks."""
    order, live = _by_length(starts, ends)
    at, left = ends[order].astype(np.int64) - 1, (ends - starts)[order]
    state, out, t = np.zeros(len(order), np.int32), [np.zeros(0, np.int64)], 0
    takes = a.accept > 0
    while t < len(live) and live[t] >= FEW:
        k = live[t]
        state[:k] = a.step[(state[:k] << 8) + data[at[:k] - t]]
        out.append(at[:k][takes[state[:k]]] - t)
        t += 1
    if t < len(live):
        step, accept = a.lists()
        for i in range(live[t]):
            s, places, p = int(state[i]), [], int(at[i]) - t
            for b in reversed(data[at[i] - left[i] + 1 : p + 1].tobytes()):
                s = step[(s << 8) + b]
                if accept[s]:
                    places.append(p)
                p -= 1
            out.append(np.array(places, np.int64))
    return np.sort(np.concatenate(out))
