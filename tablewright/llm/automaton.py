"""Regular expressions of a small dialect to one minimal byte automaton for several rules at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Thompson construction over bytes: literals, ``\\xHH`` and ``\\n`` style escapes, classes, groups, ``|``, ``? * + {m} {m,}``.

    ``(?i:...)`` makes the ASCII letters of a group match in either case.
    """

    def __init__(self, nfa: "_Nfa", pattern: str):
        self.nfa, self.text, self.at, self.fold = nfa, pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def union(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        start, end = self.nfa.state(), self.nfa.state()
        for a, b in parts:
            self.nfa.empty[start].append(a)
            self.nfa.empty[b].append(end)
        return start, end

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.nfa.empty[end].append(a)
            end = b
        return start, end

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        a, b = self.atom()
        stop = self.at
        mark = self.peek()
        if mark not in ("?", "*", "+", "{"):
            return a, b
        self.take()
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(mark, (0, 0))
        if mark == "{":
            inside = ""
            while self.peek() != "}":
                inside += self.take()
            self.take()
            first, comma, last = inside.partition(",")
            low, high = int(first), (int(last) if last else None) if comma else int(first)
        resume = self.at

        def copy() -> tuple[int, int]:
            self.at = begin
            made = self.atom()
            self.at = resume
            assert stop <= resume
            return made

        start = end = self.nfa.state()
        for _ in range(low):
            a, b = copy()
            self.nfa.empty[end].append(a)
            end = b
        if high is None:
            a, b = copy()
            loop = self.nfa.state()
            self.nfa.empty[end].append(loop)
            self.nfa.empty[loop].append(a)
            self.nfa.empty[b].append(loop)
            end = loop
        else:
            last = self.nfa.state()
            for _ in range(high - low):
                self.nfa.empty[end].append(last)
                a, b = copy()
                self.nfa.empty[end].append(a)
                end = b
            self.nfa.empty[end].append(last)
            end = last
        return start, end

    def escaped(self) -> set[int]:
        c = self.take()
        if c == "x":
            return {int(self.take() + self.take(), 16)}
        return {{"n": 10, "r": 13, "t": 9}.get(c, ord(c))}

    def letters(self, found: set[int]) -> set[int]:
        if self.fold:
            found = found | {x ^ 32 for x in found if 65 <= (x & ~32) <= 90}
        return found

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            fold = self.fold
            if self.text.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            made = self.union()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.text}")
            self.fold = fold
            return made
        if c == "[":
            found: set[int] = set()
            if self.peek() == "^":
                raise ValueError("negated classes are not in the dialect")
            while self.peek() != "]":
                c = self.take()
                one = self.escaped() if c == "\\" else {ord(c)}
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    c = self.take()
                    to = self.escaped() if c == "\\" else {ord(c)}
                    one = set(range(min(one), max(to) + 1))
                found |= one
            self.take()
        elif c == "\\":
            found = self.escaped()
        else:
            found = {ord(c)}
        if max(found) > 127:
            raise ValueError("rules are over ASCII")
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.moves[a] = (self.letters(found), b)
        return a, b


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: dict[int, tuple[set[int], int]] = {}
        self.final: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        return len(self.empty) - 1

    def reversed(self) -> "_Nfa":
        """The automaton of the mirrored language of a single-rule automaton whose start is state 0."""
        out = _Nfa()
        for _ in self.empty:
            out.state()
        start = out.state()
        for a, targets in enumerate(self.empty):
            for b in targets:
                out.empty[b].append(a)
        split: dict[int, list[tuple[set[int], int]]] = {}
        for a, (found, b) in self.moves.items():
            split.setdefault(b, []).append((found, a))
        for b, arcs in split.items():
            for found, a in arcs:
                step = out.state()
                out.empty[b].append(step)
                out.moves[step] = (found, a)
        out.empty[start].extend(self.final)
        out.final = {0: 0}
        out.start = start
        return out


@dataclass
class Automaton:
    """``step[state * classes + byte_class]`` is the next state; ``accept[state]`` the bit set of rules that match up to here."""

    step: np.ndarray
    accept: np.ndarray
    byte_class: np.ndarray
    classes: int
    start: int
    dead: int

    def sync_bytes(self) -> np.ndarray:
        """For each byte whether every state goes to the start state on it."""
        table = self.step.reshape(-1, self.classes)
        return (table == self.start).all(axis=0)[self.byte_class]


def _subsets(nfa: _Nfa, start: int, unanchored: bool) -> tuple[list[list[int]], list[int], np.ndarray, int]:
    """Subset construction over classes of bytes that no rule tells apart."""
    kinds: dict[tuple[int, ...], int] = {}
    byte_class = np.zeros(256, np.int64)
    uses: list[list[int]] = [[] for _ in range(256)]
    for s, (found, _) in nfa.moves.items():
        for b in found:
            uses[b].append(s)
    for b in range(256):
        byte_class[b] = kinds.setdefault(tuple(uses[b]), len(kinds))
    sample = [0] * len(kinds)
    for b in range(255, -1, -1):
        sample[byte_class[b]] = b

    def closed(state: int) -> int:
        seen, todo = {state}, [state]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return sum(1 << s for s in seen if s in nfa.moves or s in nfa.final)

    # sets of states are bit sets; what a state leads to on each class is closed once
    again = closed(start) if unanchored else 0
    leads: dict[int, list[tuple[int, int]]] = {}
    for s, (found, t) in nfa.moves.items():
        after = closed(t)
        leads[s] = [(c, after) for c in range(len(kinds)) if sample[c] in found]
    root = closed(start)
    number, order, table = {root: 0}, [root], []
    at = 0
    while at < len(order):
        row, rest = [again] * len(kinds), order[at]
        while rest:
            low = rest & -rest
            rest ^= low
            for c, after in leads.get(low.bit_length() - 1, ()):
                row[c] |= after
        for c, target in enumerate(row):
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row[c] = number[target]
        table.append(row)
        at += 1
    finals = [(1 << s, 1 << k) for s, k in nfa.final.items()]
    accept = [sum({rule for bit, rule in finals if states & bit}) for states in order]
    return table, accept, byte_class, len(kinds)


def _minimised(table: list[list[int]], accept: list[int], byte_class: np.ndarray, classes: int) -> Automaton:
    """Merge states that no continuation tells apart, by refining the partition by what states accept."""
    step = np.array(table, np.int64).reshape(len(table), classes)
    block = np.unique(np.array(accept, np.int64), return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.column_stack([block, block[step]])
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    count = int(block.max()) + 1
    first = np.full(count, -1)
    first[block[::-1]] = np.arange(len(block))[::-1]
    small = block[step[first]]
    accepts = np.array(accept, np.int64)[first]
    still = (small == np.arange(count)[:, None]).all(axis=1) & (accepts == 0)
    dead = int(np.flatnonzero(still)[0]) if still.any() else -1
    return Automaton(small.reshape(-1).astype(np.int32), accepts, byte_class, classes, int(block[0]), dead)


def compile_rules(patterns: list[str]) -> tuple[Automaton, list[Automaton]]:
    """The combined unanchored automaton of all patterns, and the anchored automaton of each mirrored pattern."""
    nfa = _Nfa()
    start = nfa.state()
    mirrors = []
    for k, pattern in enumerate(patterns):
        a, b = _Parser(nfa, pattern).union()
        nfa.empty[start].append(a)
        nfa.final[b] = k
        own = _Nfa()
        own.state()
        a, b = _Parser(own, pattern).union()
        own.empty[0].append(a)
        own.final[b] = 0
        back = own.reversed()
        mirrors.append(_minimised(*_subsets(back, back.start, False)))
    return _minimised(*_subsets(nfa, start, True)), mirrors
