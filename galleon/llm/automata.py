"""Byte automata as transition arrays, and one pass of them over all texts of a batch.

A pass cuts the batch into lanes of equal length and takes one step in all lanes at a time, so numpy does the work of a
loop over bytes. A lane begins in the state that its last RUNUP bytes before lead to; where that guess isn't what the
lane before ended in, the lane is walked again byte by byte, so every state is exact whatever the texts hold.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of a lane, and bytes before it from which its first state is guessed.
LANE, RUNUP = 512, 16


class Automaton(NamedTuple):
    """kinds: class of each byte. step[state, class]: the next state; the last class stands between texts and leads to
    state 0. emit[state, class]: marks of the transition, as bits."""

    kinds: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each text begins in them, and the last ends."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[first[0] : first[-1]], first - first[0]


def marks(automaton: Automaton, data: np.ndarray, first: np.ndarray, backward: bool = False) -> np.ndarray:
    """What the automaton emits at each byte, when it reads every text from its begin, or backward from its end."""
    between, n = automaton.step.shape[1] - 1, len(first) - 1
    symbols = np.insert(automaton.kinds[data], first[1:] if backward else first[:-1], between)
    found = _pass(automaton, symbols[::-1] if backward else symbols)
    return np.delete(found[::-1] if backward else found, (first[1:] if backward else first[:-1]) + np.arange(n))


def _pass(automaton: Automaton, symbols: np.ndarray) -> np.ndarray:
    width = automaton.step.shape[1]
    step, emit = (automaton.step * width).astype(np.int32).ravel(), automaton.emit.ravel()
    lanes = max(1, -(-len(symbols) // LANE))
    padded = np.full(lanes * LANE, width - 1, np.uint8)
    padded[: len(symbols)] = symbols
    grid = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    at, out = np.zeros(lanes, np.int32), np.empty((LANE, lanes), emit.dtype)
    for j in range(LANE - RUNUP, LANE):
        at[1:] = step[at[1:] + grid[j, :-1]]
    begun = at.copy()
    for j in range(LANE):
        move = at + grid[j]
        emit.take(move, out=out[j], mode="clip")
        at = step.take(move)
    wrong = np.flatnonzero(begun[1:] != at[:-1]) + 1
    if len(wrong):
        step, emit = step.tolist(), emit.tolist()
    for i in wrong.tolist():
        while i < lanes and begun[i] != at[i - 1]:
            state = begun[i] = int(at[i - 1])
            for j in range(LANE):
                move = state + int(grid[j, i])
                out[j, i], state = emit[move], step[move]
            at[i] = state
            i += 1
    return out.T.reshape(-1)[: len(symbols)]


# --- automata of regexes -------------------------------------------------------------------------------------------


def parsed(regex: str, fold: bool = False) -> tuple:
    """A regex over ASCII as nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most).

    It may hold literals, classes, groups, alternatives and the quantifiers ? * + {m} {m,} {m,n}; with fold, letters
    stand for both cases.
    """
    at = 0

    def char() -> int:
        nonlocal at
        c = regex[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = regex[at]
        at += 1
        if c == "x":
            at += 2
            return int(regex[at - 2 : at], 16)
        return ord(c)

    def both(found: Iterable[int]) -> tuple:
        found = set(found)
        more = {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()} if fold else set()
        return "set", frozenset(found | more)

    def atom() -> tuple:
        nonlocal at
        if regex[at] == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if regex[at] != "[":
            return both([char()])
        at += 1
        found: set[int] = set()
        while regex[at] != "]":
            low = char()
            if regex[at] == "-" and regex[at + 1] != "]":
                at += 1
                found.update(range(low, char() + 1))
            else:
                found.add(low)
        at += 1
        return both(found)

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(regex) and regex[at] not in "|)":
            part = atom()
            if at < len(regex) and regex[at] in "?*+{":
                if regex[at] == "{":
                    end = regex.index("}", at)
                    low, _, high = regex[at + 1 : end].partition(",")
                    least, most = int(low), (int(high) if high else None) if "," in regex[at:end] else int(low)
                    at = end
                else:
                    least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[regex[at]]
                at += 1
                part = "rep", part, least, most
            parts.append(part)
        return "cat", parts

    def alternatives() -> tuple:
        nonlocal at
        found = [sequence()]
        while at < len(regex) and regex[at] == "|":
            at += 1
            found.append(sequence())
        return ("alt", found) if len(found) > 1 else found[0]

    return alternatives()


def mirrored(node: tuple) -> tuple:
    """The regex that matches the same texts read backward."""
    match node:
        case "set", _:
            return node
        case "rep", part, least, most:
            return "rep", mirrored(part), least, most
        case kind, parts:
            inner = [mirrored(p) for p in parts]
            return kind, inner[::-1] if kind == "cat" else inner


class _Nfa:
    """States with moves without a byte (free) and at most one set of bytes that leads on."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self, free: list[int] = (), on: tuple[frozenset, int] | None = None) -> int:
        self.free.append(list(free))
        self.on.append(on)
        return len(self.on) - 1

    def entry(self, node: tuple, then: int) -> int:
        """The state from which what the node matches leads to `then`."""
        match node:
            case "set", found:
                return self.state(on=(found, then))
            case "cat", parts:
                for p in reversed(parts):
                    then = self.entry(p, then)
                return then
            case "alt", parts:
                return self.state([self.entry(p, then) for p in parts])
            case "rep", part, least, most:
                if most is None:
                    loop = self.state()
                    self.free[loop] = [self.entry(part, loop), then]
                    then = loop
                else:
                    for _ in range(most - least):
                        then = self.state([self.entry(part, then), then])
                for _ in range(least):
                    then = self.entry(part, then)
                return then

    def closed(self, states: Iterable[int]) -> frozenset:
        """The states with all that are reached without a byte."""
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def compiled(rules: list[tuple], anywhere: bool) -> Automaton:
    """One automaton of all rules (nested tuples): after a byte it emits bit i where a match of rule i ends there.

    anywhere: matches may begin at every byte; else only at the first one, and the last state is one that nothing leaves.
    """
    nfa, ends = _Nfa(), []
    entries = []
    for rule in rules:
        ends.append(nfa.state())
        entries.append(nfa.entry(rule, ends[-1]))
    sets = sorted({on[0] for on in nfa.on if on}, key=sorted)
    looks = [tuple(b in s for s in sets) for b in range(256)]
    number = {look: i for i, look in enumerate(dict.fromkeys(looks))}
    sample = {number[look]: b for b, look in enumerate(looks)}
    begin = nfa.closed(entries)
    found, rows, accept = {begin: 0}, [], []
    todo = [begin]
    for state in todo:  # subset construction; the list grows while it is read
        accept.append(sum(1 << i for i, e in enumerate(ends) if e in state))
        row = []
        for k in range(len(number)):
            moved = nfa.closed([nfa.on[s][1] for s in state if nfa.on[s] and sample[k] in nfa.on[s][0]])
            moved = moved | begin if anywhere else moved
            if moved not in found:
                found[moved] = len(found)
                todo.append(moved)
            row.append(found[moved])
        rows.append([*row, 0])
    step, mask = minimal(np.array(rows), np.array(accept))
    emit = mask[step]
    emit[:, -1] = 0
    return Automaton(np.array([number[look] for look in looks], np.uint8), step, emit)


def minimal(step: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The automaton with states that no text tells apart made one: groups are split until their moves agree."""
    group = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = list(dict.fromkeys(group.tolist()))  # state 0's group comes first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    some = np.array([int(np.flatnonzero(group == g)[0]) for g in order])
    return place[group[step[some]]], accept[some].astype(np.uint32)
