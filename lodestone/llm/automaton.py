"""Deterministic automata for byte patterns: subset construction and minimisation.

A pattern is a small tree of tuples, made by :func:`chars`, :func:`seq`,
:func:`alt`, :func:`opt`, :func:`plus`, :func:`star` and :func:`word`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

Pattern = tuple


def chars(members: Iterable[int] | bytes) -> Pattern:
    return ("chars", frozenset(members))


def seq(*parts: Pattern) -> Pattern:
    return ("seq", *parts)


def alt(*parts: Pattern) -> Pattern:
    return ("alt", *parts)


def opt(part: Pattern) -> Pattern:
    return ("alt", part, ("seq",))


def plus(part: Pattern) -> Pattern:
    return ("plus", part)


def star(part: Pattern) -> Pattern:
    return opt(plus(part))


def word(text: str, any_case: bool = False) -> Pattern:
    return seq(*(chars({text.lower()[i].encode()[0], text.upper()[i].encode()[0]} if any_case else {c}) for i, c in enumerate(text.encode())))


def reverse(pattern: Pattern) -> Pattern:
    kind, *parts = pattern
    if kind == "chars":
        return pattern
    parts = [reverse(p) for p in parts]
    return (kind, *(parts[::-1] if kind == "seq" else parts))


class _Nondeterministic:
    """Thompson's construction; steps[s] are (members, next), free[s] are empty moves."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.free) - 1

    def add(self, pattern: Pattern, start: int) -> int:
        """The end state of the pattern from a start state."""
        kind, *parts = pattern
        if kind == "chars":
            end = self.state()
            self.steps[start].append((parts[0], end))
            return end
        if kind == "seq":
            for part in parts:
                start = self.add(part, start)
            return start
        if kind == "plus":
            begin = self.state()
            self.free[start].append(begin)
            end = self.add(parts[0], begin)
            self.free[end].append(begin)
            return end
        end = self.state()
        for part in parts:
            branch = self.state()
            self.free[start].append(branch)
            self.free[self.add(part, branch)].append(end)
        return end

    def closures(self) -> list[int]:
        """Of each state, what empty moves reach from it, as a bit set."""
        found = []
        for first in range(len(self.free)):
            seen, todo = {first}, [first]
            while todo:
                new = [s for s in self.free[todo.pop()] if s not in seen]
                seen.update(new)
                todo += new
            found.append(sum(1 << s for s in seen))
        return found


def _bits(subset: int) -> list[int]:
    return [i for i, bit in enumerate(reversed(bin(subset))) if bit == "1"]


@dataclass(frozen=True)
class Automaton:
    """``move[state + class]`` is the next state; states are multiples of ``width``.

    ``classes`` maps a byte to its class.  ``accepts`` has, by state // width,
    the bits of the patterns that end there; these are the states from ``final``
    up.  State 0 is the start; ``dead`` is the state that nothing leaves (-1: none).
    """

    classes: bytes
    width: int
    move: np.ndarray
    accepts: np.ndarray
    final: int
    dead: int


def _classes(patterns: Iterable[Pattern]) -> tuple[bytes, int]:
    """Bytes that no pattern tells apart share a class."""
    sets: set[frozenset[int]] = set()

    def collect(pattern: Pattern) -> None:
        kind, *parts = pattern
        if kind == "chars":
            sets.add(parts[0])
        else:
            for part in parts:
                collect(part)

    for pattern in patterns:
        collect(pattern)
    ordered = sorted(sets, key=sorted)
    seen: dict[tuple[bool, ...], int] = {}
    return bytes(seen.setdefault(tuple(b in s for s in ordered), len(seen)) for b in range(256)), len(seen)


def compile_patterns(patterns: list[Pattern], anywhere: bool) -> Automaton:
    """One minimal automaton of all patterns; ``anywhere``: a match may begin at every byte."""
    classes, width = _classes(patterns)
    member = [classes.index(c) for c in range(width)]
    nfa = _Nondeterministic()
    begin = nfa.state()
    ends = {}
    for i, pattern in enumerate(patterns):
        start = nfa.state()
        nfa.free[begin].append(start)
        ends[nfa.add(pattern, start)] = i
    reach = nfa.closures()
    # Of each state, by class, all states that the class leads to.
    moves: list[dict[int, int]] = [{} for _ in reach]
    for s, steps in enumerate(nfa.steps):
        for members, to in steps:
            for c in range(width):
                if member[c] in members:
                    moves[s][c] = moves[s].get(c, 0) | reach[to]
    first = reach[begin]
    numbers, order, table = {first: 0}, [first], []
    for subset in order:
        row = [first if anywhere else 0] * width
        for s in _bits(subset):
            for c, to in moves[s].items():
                row[c] |= to
        for target in row:
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
        table.append([numbers[target] for target in row])
    accepts = np.array([sum(1 << i for s, i in ends.items() if subset >> s & 1) for subset in order])
    return _minimal(classes, width, np.array(table), accepts)


def _minimal(classes: bytes, width: int, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Moore's refinement: states stay together while they accept alike and move to equal groups."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    # The group of the start comes first, those that accept last.
    _, one = np.unique(group, return_index=True)
    place = np.lexsort((np.arange(len(one)) != group[0], accepts[one] > 0))
    rank = np.argsort(place)
    group, one = rank[group], one[place]
    move, accept = group[table[one]], accepts[one]
    dead = next((s for s in range(len(one)) if not accept[s] and (move[s] == s).all()), -1)
    return Automaton(classes, width, (move * width).astype(np.int32).reshape(-1), accept, int((accept == 0).sum()) * width, dead * width if dead >= 0 else -1)
