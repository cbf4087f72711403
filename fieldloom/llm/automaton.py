"""Regular expressions over bytes to minimal deterministic automata in transition arrays.

A small grammar is enough for scanning rules: literals, \\xHH and \\-escapes, classes with ranges, groups,
alternation, and the quantifiers ? * + {m} {m,} {m,n}.  There are no anchors, back references or lazy forms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# --- syntax trees: ("set", frozenset) | ("cat", [..]) | ("alt", [..]) | ("rep", tree, least, most or None)


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def parse(self):
        tree = self.alternatives()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, tree):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                least, _, most = (body := self.s[self.i : end]).partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(least), int(most) if most else None if "," in body else int(least))
            else:
                tree = ("rep", tree, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return tree

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            tree = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.i += 1
            return tree
        if c == "[":
            return self.bracket()
        return self.chars({self.byte()})

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def bracket(self):
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.byte()
            found |= set(range(low, high + 1))
        self.i += 1
        return self.chars(set(range(256)) - found if negated else found)

    def chars(self, found: set[int]):
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isalpha() and b < 128}
        return ("set", frozenset(found))


def mirrored(tree):
    """The tree of the reversed language."""
    if tree[0] == "cat":
        return ("cat", [mirrored(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [mirrored(x) for x in tree[1]])
    if tree[0] == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def build(self, tree, at: int) -> int:
        """Add the tree from state `at`; the state after it."""
        kind = tree[0]
        if kind == "set":
            start, end = self.state(), self.state()
            self.empty[at].append(start)
            self.moves[start] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                at = self.build(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[self.build(part, at)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            at = self.build(inner, at)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.build(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(most - least):
            self.empty[at].append(end)
            at = self.build(inner, at)
        self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """States are numbered so that those with a mask come last; step[256 * state + byte] is the next state times 256."""

    step: list[int]
    masks: list[int]
    start: int
    first_hit: int

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest accepted string that starts at `at`, or -1."""
        state, end, step, first = self.start, -1, self.step, self.first_hit
        if state >= first:
            end = at
        for pos in range(at, len(data)):
            state = step[state + data[pos]]
            if state >= first:
                end = pos + 1
            elif not state:  # state 0 is dead in an anchored automaton
                break
        return end


def compile_rules(patterns: list[tuple[str, bool]], *, reverse: bool = False, anchored: bool = False, most_states: int = 50_000) -> Dfa:
    """One minimal automaton for all (pattern, fold case) rules; bit r of a state's mask says that rule r accepts.

    Unanchored: a match may start at any byte.  reverse: of the mirrored patterns, for a scan from the end.
    """
    nfa = _Nfa()
    entry = nfa.state()
    finals: dict[int, int] = {}
    for r, (pattern, fold) in enumerate(patterns):
        tree = _Parser(pattern, fold).parse()
        finals[nfa.build(mirrored(tree) if reverse else tree, entry)] = 1 << r
    # bytes that no set tells apart share a class
    told = np.zeros(256, dtype=np.int64)
    for chars in {m[0] for m in nfa.moves if m}:
        inside = np.zeros(256, dtype=np.int64)
        inside[list(chars)] = 1
        told = np.unique(told * 2 + inside, return_inverse=True)[1]
    kinds = int(told.max()) + 1
    sample = [int(np.flatnonzero(told == k)[0]) for k in range(kinds)]

    begin = nfa.closure([entry])
    number = {frozenset(): 0} if anchored else {}
    number[begin] = len(number)
    order, table = list(number), []
    for states in order:  # subset construction; grows while it is read
        row = []
        for byte in sample:
            after = nfa.closure({m[1] for s in states if (m := nfa.moves[s]) and byte in m[0]})
            after = after if anchored else after | begin
            if after not in number:
                if len(number) >= most_states:
                    raise ValueError(f"the rules need over {most_states} states")
                number[after] = len(number)
                order.append(after)
            row.append(number[after])
        table.append(row)
    masks = np.array([sum({finals[s] for s in states if s in finals}) for states in order], dtype=np.int64)
    table = np.array(table, dtype=np.int64)

    group = np.unique(masks, return_inverse=True)[1]
    while True:  # refine until states of a group move to the same groups
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = np.array([np.flatnonzero(group == g)[0] for g in range(int(group.max()) + 1)])
    hit = masks[first] != 0
    rank = np.argsort(np.where(np.arange(len(first)) == group[0], -1, hit), kind="stable") if anchored else np.argsort(hit, kind="stable")
    new = np.empty_like(rank)
    new[rank] = np.arange(len(rank))
    first = first[rank]
    wide = new[group[table[first]]][:, told] * 256
    shared = list(range(0, 256 * len(first), 256))  # one int object for each state
    return Dfa([shared[x // 256] for x in wide.ravel().tolist()], masks[first].tolist(), int(new[group[number[begin]]]) * 256, int((masks[first] == 0).sum()) * 256)
