"""A small regular-expression compiler: one minimal deterministic automaton over bytes for many rules.

Patterns use literals, ``\\xNN`` and punctuation escapes, classes, groups, ``|`` and ``? * + {m} {m,} {m,n}``.
Every byte class of a pattern is a position. Sets of positions, as the bits of one integer, are the states of the
subset construction; partition refinement makes the result minimal. Bytes that no rule tells apart share a column
of the transition array.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

ALL = frozenset(range(256))


class _Reader:
    """Pattern text to a tree: ('set', bytes) | ('seq', [..]) | ('alt', [..]) | ('rep', tree, least, most or None)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("seq", parts)

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return inner
        if c == "[":
            return ("set", self.char_class())
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"escape \\{c} is not known")
        return ord(c)

    def char_class(self) -> frozenset[int]:
        negated = self.peek() == "^" and bool(self.take())
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                d = self.take()
                high = self.escaped() if d == "\\" else ord(d)
            found |= set(range(low, high + 1))
        return ALL - found if negated else frozenset(found)

    def repeated(self, tree):
        while (c := self.peek()) in ("?", "*", "+", "{") and c:
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                least, _, most = self.text[self.at : end].partition(",")
                bounds = (int(least), int(most) if most else None if "," in self.text[self.at : end] else int(least))
                self.at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, *bounds)
        return tree


class _Positions:
    """Positions of all patterns: the bytes each takes, and the positions that may follow it, as bits."""

    def __init__(self):
        self.sets: list[frozenset[int]] = []
        self.follow: list[int] = []

    def _join(self, last: int, first: int) -> None:
        for i in bits_of(last):
            self.follow[i] |= first

    def add(self, tree) -> tuple[bool, int, int]:
        """Whether ``tree`` matches nothing, and its possible first and last positions."""
        kind = tree[0]
        if kind == "set":
            self.sets.append(tree[1])
            self.follow.append(0)
            own = 1 << len(self.sets) - 1
            return False, own, own
        if kind == "alt":
            parts = [self.add(t) for t in tree[1]]
            empty, first, last = False, 0, 0
            for e, f, z in parts:
                empty, first, last = empty or e, first | f, last | z
            return empty, first, last
        if kind == "seq":
            return self._chain([(t, False, False) for t in tree[1]])
        _, inner, least, most = tree
        if most is None:
            copies = [(inner, False, False)] * max(0, least - 1) + [(inner, least == 0, True)]
        else:
            copies = [(inner, k >= least, False) for k in range(most)]
        return self._chain(copies)

    def _chain(self, parts: list) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for tree, optional, loops in parts:
            e, f, z = self.add(tree)
            if loops:
                self._join(z, f)
            self._join(last, f)
            first, last, empty = first | f if empty else first, z | last if e or optional else z, empty and (e or optional)
        return empty, first, last


def bits_of(mask: int) -> list[int]:
    found = []
    while mask:
        low = mask & -mask
        found.append(low.bit_length() - 1)
        mask ^= low
    return found


def parsed(pattern: str):
    reader = _Reader(pattern)
    tree = reader.alternatives()
    if reader.peek():
        raise ValueError(f"{pattern!r}: not read from place {reader.at}")
    return tree


def backwards(tree):
    """The tree of the reversed strings."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", backwards(tree[1]), *tree[2:])
    return (tree[0], [backwards(t) for t in (tree[1][::-1] if tree[0] == "seq" else tree[1])])


def shortened(tree, depth: int):
    """The tree with at most ``depth`` copies of a repetition at its end: all that the tree matches begins with a match of it."""
    if tree[0] == "rep" and tree[1][0] == "set" and tree[2] > depth:
        return ("rep", tree[1], depth, None)
    if tree[0] == "seq" and tree[1]:
        return ("seq", [*tree[1][:-1], shortened(tree[1][-1], depth)])
    return tree


class Automaton:
    """Transition arrays for all rules at once.

    ``columns`` maps a byte to its column; ``table[state + column]`` is the next state, states being multiplied by
    the number of columns; accepting states come last, from ``first_accepting`` on, and ``found[state]`` has a bit
    for each rule of which a match ends there. ``dead`` is the state that nothing leaves, -1 where there is none.
    """

    def __init__(self, columns: bytes, table: list[int], first_accepting: int, found: dict[int, int], start: int, dead: int):
        self.columns, self.table, self.first_accepting, self.found, self.start, self.dead = columns, table, first_accepting, found, start, dead

    def __len__(self) -> int:
        return len(self.table) // (max(self.columns) + 1)

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(bytes read, bits of the rules of which a match ends there) in one pass; empty at once where nothing matches."""
        columns, table, first, found = data.translate(self.columns), self.table, self.first_accepting, self.found
        state = self.start
        for column in columns:
            state = table[state + column]
            if state >= first:
                break
        else:
            return []
        state, out = self.start, []
        for n, column in enumerate(columns, 1):
            state = table[state + column]
            if state >= first:
                out.append((n, found[state]))
        return out


def compile_rules(trees: list, anchored: bool = False, most_states: int = 100_000) -> Automaton:
    """The minimal automaton of pattern trees; it searches them everywhere, or matches them from one place on where ``anchored``."""
    positions = _Positions()
    parts = [positions.add(t) for t in trees]
    if any(e for e, _, _ in parts):
        raise ValueError("a pattern matches the empty string")
    begin = 1 << len(positions.sets)
    follow = [*positions.follow, 0]
    for _, first, _ in parts:
        follow[-1] |= first

    splits: dict[tuple, int] = {}
    distinct = list(dict.fromkeys(positions.sets))
    columns = bytes(splits.setdefault(tuple(b in s for s in distinct), len(splits)) for b in range(256))
    sample = [columns.index(bytes([c])) for c in range(len(splits))]
    takes = [sum(1 << i for i, s in enumerate(positions.sets) if b in s) for b in sample]
    always = 0 if anchored else begin

    numbers, order, rows = {begin: 0}, [begin], []
    for subset in order:
        reached = 0
        for i in bits_of(subset):
            reached |= follow[i]
        row = []
        for take in takes:
            target = reached & take | always
            if target not in numbers:
                if len(order) >= most_states:
                    raise ValueError(f"over {most_states} states")
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        rows.append(row)
    masks = [sum(1 << k for k, (_, _, last) in enumerate(parts) if subset & last) for subset in order]

    moves, block = np.array(rows, np.int64), np.unique(np.array(masks, object), return_inverse=True)[1]
    while True:  # states stay together while their marks and their targets' blocks agree
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    members = defaultdict(list)
    for i, b in enumerate(block.tolist()):
        members[b].append(i)
    ranked = sorted(members, key=lambda b: (masks[members[b][0]] != 0, members[b][0]))
    width = len(splits)
    place = {b: k * width for k, b in enumerate(ranked)}
    table = [place[int(block[t])] for b in ranked for t in rows[members[b][0]]]
    found = {place[b]: masks[members[b][0]] for b in ranked if masks[members[b][0]]}
    return Automaton(columns, table, min(found, default=len(table)), found, place[int(block[0])], place[int(block[numbers[0]])] if 0 in numbers else -1)
