"""Regular expressions compiled to one minimal automaton over bytes.

Parsing gives an NFA, subset construction a DFA, partition refinement the minimal
one; the result is a transition array [state, byte] and a bit set of rules per state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1


class _Parser:
    """Literals, escapes, classes, groups, | ? * + {m} {m,} {m,n} and (?i: )."""

    def __init__(self, pattern: str) -> None:
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def either(self):
        options = [self.row()]
        while self.peek() == "|":
            self.take()
            options.append(self.row())
        return ("or", options) if len(options) > 1 else options[0]

    def row(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeat())
        return ("and", items)

    def repeat(self):
        item = self.atom()
        while self.peek() in ("?", "*", "+", "{"):
            c = self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                item = ("rep", item, int(low), int(high) if high else (None if comma else int(low)))
            else:
                item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def char(self) -> int:
        c = self.take()
        return self.escaped() if c == "\\" else ord(c)

    def bytes_of(self, chars: set[int]):
        if self.fold:
            chars |= {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha()}
        return ("set", frozenset(chars))

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            item = self.either()
            self.take()
            self.fold = before
            return item
        if c == "[":
            chars: set[int] = set()
            negated = self.peek() == "^"
            if negated:
                self.take()
            while self.peek() != "]":
                low = self.char()
                high = low
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.take()
                    high = self.char()
                chars |= set(range(low, high + 1))
            self.take()
            return self.bytes_of(set(range(256)) - chars if negated else chars)
        self.i -= 1
        return self.bytes_of({self.char()})


def _build(nfa: _Nfa, node, start: int) -> int:
    """Adds a node's states after ``start``; returns the state behind it."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        at = nfa.state()
        nfa.empty[start].append(at)
        nfa.step[at] = (node[1], end)
        return end
    if kind == "and":
        for item in node[1]:
            start = _build(nfa, item, start)
        return start
    if kind == "or":
        end = nfa.state()
        for item in node[1]:
            head = nfa.state()
            nfa.empty[start].append(head)
            nfa.empty[_build(nfa, item, head)].append(end)
        return end
    _, item, low, high = node
    for _ in range(low):
        start = _build(nfa, item, start)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.empty[start] += [loop, end]
        nfa.empty[_build(nfa, item, loop)] += [loop, end]
        return end
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(high - low):
        start = _build(nfa, item, start)
        nfa.empty[start].append(end)
    return end


@dataclass
class Automaton:
    """moves[state, byte]; accepts[state]: bit r for rule r. State 0 is the start."""

    moves: np.ndarray
    accepts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.moves)


def _mirrored(node):
    """The node for the same strings read backwards."""
    if node[0] == "and":
        return ("and", [_mirrored(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_mirrored(x) for x in node[1]])
    return (node[0], _mirrored(node[1]), *node[2:]) if node[0] == "rep" else node


def _skippable(node) -> bool:
    """Whether what a match begins with may be left out."""
    if node[0] == "and":
        return not node[1] or _skippable(node[1][0])
    if node[0] == "or":
        return any(map(_skippable, node[1]))
    return node[0] == "rep" and (node[2] == 0 or _skippable(node[1]))


def compile_rules(patterns: list[str], anchored: bool, backward: bool = False) -> Automaton:
    """One automaton for all rules.

    ``anchored``: matches from the first byte on; else matches that end at a byte.
    ``backward``: for bytes read from the last to the first, so ends become starts.
    A pattern must need its first byte (no leading ``?`` or ``*``), else a match could
    begin where the automaton seems to be at its start; such rules are refused.
    """
    nfa = _Nfa()
    root = nfa.state()
    finals: dict[int, int] = {}
    for r, pattern in enumerate(patterns):
        head = nfa.state()
        nfa.empty[root].append(head)
        tree = _Parser(pattern).either()
        if not anchored and not backward and _skippable(tree):
            raise ValueError(f"a match of {pattern} may begin with bytes that it does not need")
        finals[_build(nfa, _mirrored(tree) if backward else tree, head)] = 1 << r

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.step[s] or s in finals)

    sets = {x[0] for x in nfa.step if x}
    groups: dict[tuple, list[int]] = {}
    for b in range(256):  # bytes that no set tells apart move alike
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    start = closure([root])
    index, todo, rows = {start: 0}, [start], []
    while todo:
        now = todo.pop(0)
        row = np.zeros(256, np.int64)
        for alike in groups.values():
            ends = {nfa.step[s][1] for s in now if nfa.step[s] and alike[0] in nfa.step[s][0]}
            then = closure(ends) | (frozenset() if anchored else start)
            if then not in index:
                index[then] = len(index)
                todo.append(then)
            row[alike] = index[then]
        rows.append(row)
    moves = np.array(rows)
    accepts = np.array([sum({finals[s] for s in state if s in finals}) for state in index])
    return _minimal(moves, accepts)


def _minimal(moves: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Moore's refinement: split blocks until states of a block move to the same blocks."""
    columns = np.unique(moves, axis=1)
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        _, finer = np.unique(np.column_stack([block, block[columns]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = {int(block[0]): 0}  # the start's block first
    for b in block.tolist():
        order.setdefault(b, len(order))
    name = np.array([order[b] for b in block.tolist()])
    first = np.array([int(np.flatnonzero(name == k)[0]) for k in range(len(order))])
    return Automaton(name[moves[first]], accepts[first])


def scan(auto: Automaton, buf: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """State after each byte, from one pass over many lanes at a time.

    Lanes start in state 0 on a guess; a lane whose predecessor ended elsewhere is run
    again from there until all starts agree.
    """
    n = len(buf)
    width = -(-n // lanes) or 1
    lanes = -(-n // width) or 1
    padded = np.zeros(lanes * width, np.uint8)
    padded[:n] = buf
    cells = np.ascontiguousarray(padded.reshape(lanes, width).T)
    states = np.empty((width, lanes), np.uint16)
    table = (auto.moves * 256).astype(np.int32).ravel()
    begin = np.zeros(lanes, np.int32)
    todo = np.arange(lanes)
    while len(todo):
        now = begin[todo]
        whole = len(todo) == lanes
        for t in range(width):
            now = table[now + (cells[t] if whole else cells[t, todo])]
            if whole:
                states[t] = now >> 8
            else:
                states[t, todo] = now >> 8
        after = states[-1].astype(np.int32) * 256
        wrong = np.flatnonzero(after[:-1] != begin[1:]) + 1
        begin[wrong] = after[wrong - 1]
        todo = wrong
    return states.T.reshape(-1)[:n]


#: Lanes from which on bytes are stepped together.
_WIDE = 24


class Runner:
    """The anchored automaton of all rules, run from given starts."""

    def __init__(self, auto: Automaton) -> None:
        self.auto = auto
        dead = [s for s in range(auto.size) if not auto.accepts[s] and (auto.moves[s] == s).all()]
        self.dead = dead[0] if dead else -1
        self.moves, self.accepts = auto.moves.tolist(), auto.accepts.tolist()

    def ends(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """End of the longest match of each start's rule before its stop (the start itself: none)."""
        end, state, at = start.copy(), np.zeros(len(start), np.int64), start.copy()
        lanes = np.flatnonzero(at < stop)
        while len(lanes) > _WIDE:
            now = self.auto.moves[state[lanes], buf[at[lanes]]]
            at[lanes] += 1
            state[lanes] = now
            hit = lanes[(self.auto.accepts[now] >> rule[lanes]) & 1 > 0]
            end[hit] = at[hit]
            lanes = lanes[(now != self.dead) & (at[lanes] < stop[lanes])]
        for i in lanes.tolist():
            now, bit, a = int(state[i]), int(rule[i]), int(at[i])
            for j, b in enumerate(buf[a : stop[i]].tobytes(), a + 1):
                now = self.moves[now][b]
                if now == self.dead:
                    break
                if self.accepts[now] >> bit & 1:
                    end[i] = j
        return end


class RuleSet:
    """All rules in one automaton: spans from one pass over the bytes and looks at what it marks."""

    def __init__(self, patterns: list[str]) -> None:
        self.count = len(patterns)
        self.forward = compile_rules(patterns, anchored=False)
        self.backward = compile_rules(patterns, anchored=False, backward=True)
        self.runner = Runner(compile_rules(patterns, anchored=True))

    def stretches(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pass leaves its start state, comes back, and saw a match end between: from, to."""
        states = scan(self.forward, buf)
        hits = np.flatnonzero(self.forward.accepts[states] != 0)
        edge = np.flatnonzero(np.diff(np.r_[0, (states != 0).astype(np.int8), 0]))
        lo, hi = edge[0::2], edge[1::2]
        held = np.unique(np.searchsorted(lo, hits, side="right") - 1)
        return lo[held], hi[held]

    def spans(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rule, start, end) of the leftmost longest matches that don't overlap, for each rule.

        The backward automaton marks all starts of matches in the stretches; from the
        first start of each rule and stretch the anchored one finds the end, and the next
        start behind it follows.
        """
        none = np.zeros(0, np.int64)
        lo, hi = self.stretches(buf) if len(buf) else (none, none)
        if len(lo) == 0:
            return none, none, none
        size = hi - lo + 1  # a byte that no rule holds parts the stretches
        edge = np.cumsum(size)
        place = np.repeat(lo - (edge - size), size) + np.arange(edge[-1])
        part = buf[np.minimum(place, len(buf) - 1)].copy()
        part[edge - 1] = 0xFF
        marks = self.backward.accepts[scan(self.backward, part[::-1].copy())][::-1]
        rules, starts, ends = [none], [none], [none]
        for r in range(self.count):
            at = np.sort(place[np.flatnonzero((marks >> r) & 1)])
            which = np.searchsorted(lo, at, side="right") - 1
            first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(at) else none
            now, stop = at[first], hi[which[first]]
            while len(now):
                end = self.runner.ends(buf, now, stop, np.full(len(now), r))
                found = end > now
                rules.append(np.full(int(found.sum()), r))
                starts.append(now[found])
                ends.append(end[found])
                after = np.searchsorted(at, np.maximum(end, now + 1))
                more = after < len(at)
                more[more] = at[after[more]] < stop[more]
                now, stop = at[after[more]], stop[more]
        return np.concatenate(rules), np.concatenate(starts), np.concatenate(ends)
