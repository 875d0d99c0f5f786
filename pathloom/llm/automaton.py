"""Regexes over bytes compiled to minimal deterministic automata.

Whole rules are compiled, any number of them: forwards, to tell where matches end; backwards, to tell where they
start; and anchored, one rule at a time, to tell how far the longest match from a start goes. Together they give each rule's
leftmost-longest matches that do not overlap.

Supported syntax: literals, escapes, [classes], (groups), (?i:groups), alternation, and ? * + {n} {n,} {n,m}.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: States of one automaton. Rules that together need more are dealt over several, each of which reads the text once.
MOST_STATES = 20_000
_ESCAPES = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11}


class _Parser:
    """Turns a regex into nested tuples: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, least, most)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self._alt(False)
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return node

    def _alt(self, fold: bool):
        parts = [self._cat(fold)]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self._cat(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _cat(self, fold: bool):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self._repeat(self._atom(fold)))
        return ("cat", parts)

    def _repeat(self, node):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c, least, most = self.p[self.i], 0, None
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i + 1 : end].partition(",")
                least, most = int(low), int(high) if high else None if "," in self.p[self.i : end] else int(low)
                self.i = end
            elif c == "?":
                most = 1
            elif c == "+":
                least = 1
            self.i += 1
            node = ("rep", node, least, most)
        return node

    def _byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        if c.isalnum() and c not in _ESCAPES:
            raise ValueError(f"unsupported escape \\{c}")
        return _ESCAPES.get(c, ord(c))

    def _atom(self, fold: bool):
        if self.p[self.i] == "(":
            self.i += 1
            if self.p.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            node = self._alt(fold)
            if self.p[self.i : self.i + 1] != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return node
        if self.p[self.i] == "[":
            self.i += 1
            negate = self.p[self.i] == "^"
            self.i += negate
            found: set[int] = set()
            while self.p[self.i] != "]":
                low = high = self._byte()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self._byte()
                found.update(range(low, high + 1))
            self.i += 1
            found = set(range(256)) - found if negate else found
        else:
            found = {self._byte()}
        if fold:
            found |= {ord(x) for b in found if b < 128 for x in (chr(b).lower(), chr(b).upper())}
        return ("set", frozenset(found))


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def build(self, node, at: int, backwards: bool) -> int:
        """Adds node after state `at`; gives its end state."""
        if node[0] == "set":
            end = self.state()
            self.moves[at] = (node[1], end)
            return end
        if node[0] == "cat":
            for part in reversed(node[1]) if backwards else node[1]:
                at = self.build(part, at, backwards)
            return at
        if node[0] == "alt":
            end = self.state()
            for part in node[1]:
                self.free[at].append(start := self.state())
                self.free[self.build(part, start, backwards)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            at = self.build(part, self._after(at), backwards)
        end = self.state()
        if most is None:
            self.free[at].append(loop := self.state())
            self.free[loop].append(end)
            self.free[loop].append(start := self.state())
            self.free[self.build(part, start, backwards)].append(loop)
        else:
            for _ in range(most - least):
                self.free[at].append(end)
                at = self.build(part, self._after(at), backwards)
            self.free[at].append(end)
        return end

    def _after(self, at: int) -> int:
        self.free[at].append(new := self.state())
        return new

    def closure(self, state: int) -> set[int]:
        todo, seen = [state], {state}
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen


@dataclass
class Automaton:
    """State s and byte b go to table[s * classes + class_of[b]] (already times `classes`); states from
    first_accepting on accept the rules in the bits of accepts[s]; breaks marks bytes that no rule contains: no match spans
    one. dead: the state that no match leaves again, or -1 (times `classes`)."""

    table: np.ndarray
    class_of: np.ndarray
    classes: int
    first_accepting: int
    accepts: list[int]
    breaks: np.ndarray
    start: int
    dead: int

    @property
    def states(self) -> int:
        return len(self.accepts)

    @cached_property
    def limit(self) -> int:
        return self.first_accepting * self.classes

    @cached_property
    def steps(self) -> list[int]:
        """The table as a list, on which a step of a single lane is far cheaper. Never used on the driver, so never shipped."""
        return self.table.tolist()

    @cached_property
    def kinds(self) -> bytes:
        return self.class_of.tobytes()


class TooManyStates(ValueError):
    pass


def compile_rules(patterns: list[str], backwards: bool = False, anchored: bool = False, most: int = MOST_STATES) -> Automaton:
    """An automaton whose state after some bytes accepts rule i if a match of patterns[i] ends there (backwards: starts
    there, bytes being read from the end). anchored: only a match that begins with the first byte counts. More than
    `most` subsets raise TooManyStates."""
    nfa = _Nfa()
    start, ends = nfa.state(), []
    for p in patterns:
        nfa.free[start].append(own := nfa.state())
        ends.append(nfa.build(_Parser(p).parse(), own, backwards))
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    keys = [tuple(b in s for s in sets) for b in range(256)]
    order = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    class_of = np.array([order[k] for k in keys], np.uint8)
    final = {e: i for i, e in enumerate(ends)}
    # Sets of states are bits of an integer; states without a byte to go on and without a rule need none.
    reach = [sum(1 << t for t in nfa.closure(s) if nfa.moves[t] or t in final) for s in range(len(nfa.free))]
    of_set = {s: [i for k, i in order.items() if k[j]] for j, s in enumerate(sets)}
    moves = [(of_set[m[0]], reach[m[1]]) if m else ((), 0) for m in nfa.moves]
    # Subset construction; unless anchored the start is part of every subset, as a match may begin anywhere.
    first, again = reach[start], 0 if anchored else reach[start]
    if any(first >> e & 1 for e in ends):
        raise ValueError("a rule matches the empty text")
    number, todo, rows, masks = {first: 0}, [first], [], []
    for subset in todo:
        row, mask, left = [again] * len(order), 0, subset
        while left:
            low = left & -left
            left ^= low
            s = low.bit_length() - 1
            if s in final:
                mask |= 1 << final[s]
            kinds, to = moves[s]
            for c in kinds:
                row[c] |= to
        if len(number) > most:
            raise TooManyStates(f"{len(patterns)} rules need more than {most} states")
        for to in row:
            if to not in number:
                number[to] = len(number)
                todo.append(to)
        rows.append([number[to] for to in row])
        masks.append(mask)
    table = np.array(rows, np.int64)
    # Minimisation: refine the partition by accepted rules until no state's moves tell two states of a part apart.
    kinds_of_mask = {m: i for i, m in enumerate(dict.fromkeys(masks))}
    part = np.array([kinds_of_mask[m] for m in masks])
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, member = np.unique(part, return_index=True)
    by_mask = np.argsort(np.array([masks[i] != 0 for i in member.tolist()]), kind="stable")
    rank = np.empty(len(member), np.int64)
    rank[by_mask] = np.arange(len(member))
    classes = table.shape[1]
    small = rank[part[table[member[by_mask]]]]
    accepts = [masks[i] for i in member[by_mask].tolist()]
    breaks = np.array([not any(k) for k in keys])
    dead = int(rank[part[number[0]]]) * classes if anchored and 0 in number else -1
    return Automaton((small * classes).astype(np.int32).ravel(), class_of, classes, sum(not m for m in accepts), accepts, breaks, int(rank[part[0]]), dead)


def _walk(auto: Automaton, kinds: Iterable[int], state: int) -> list[tuple[int, int]]:
    """(step, state) of the accepting states that one lane comes into; a state it stays in is given once."""
    steps, limit, found = auto.steps, auto.limit, []
    for i, c in enumerate(kinds):
        to = steps[state + c]
        if to != state:
            if to >= limit:
                found.append((i, to))
            state = to
    return found


def scan(auto: Automaton, raw: np.ndarray, offsets: np.ndarray, lane: int = 512, few: int = 48) -> list[tuple[int, int, int]]:
    """(start, end, accepted rules) of the segments between breaks that hold a match.

    Every byte is read once. The rows are cut at breaks into lanes of about `lane` bytes, which step together while there are
    at least `few` of them; the rest of longer ones, in which no break comes, is walked one by one.
    """
    n = len(raw)
    if not n:
        return []
    gaps = np.flatnonzero(auto.breaks[raw]) + 1
    aims = np.searchsorted(gaps, np.arange(lane, n, lane))
    rows = offsets[:-1][np.diff(offsets) > 0]
    starts = np.unique(np.concatenate([rows, gaps[aims[aims < len(gaps)]]]))
    starts = starts[starts < n]
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    together = int(lengths[few - 1]) if few <= len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(together), "left")  # lanes longer than each step
    kinds = auto.class_of[raw]
    wide = kinds.astype(np.int32)
    table, limit = auto.table, auto.limit
    state = np.full(len(starts), auto.start * auto.classes, np.int32)
    at, hit_at, hit_state = starts.copy(), [], []
    for m in active.tolist():
        now = table[state[:m] + wide[at[:m]]]
        state[:m] = now
        if int(now.max()) >= limit:
            which = np.flatnonzero(now >= limit)
            hit_at.append(at[which])
            hit_state.append(now[which])
        at[:m] += 1
    for i in np.flatnonzero(lengths > together).tolist():
        own = _walk(auto, kinds[int(at[i]) : int(starts[i] + lengths[i])].tobytes(), int(state[i]))
        if own:
            both = np.array(own, np.int64)
            hit_at.append(both[:, 0] + at[i])
            hit_state.append(both[:, 1])
    if not hit_at:
        return []
    cuts = np.unique(np.concatenate([offsets, gaps]))
    piece = np.searchsorted(cuts, np.concatenate(hit_at), "right") - 1
    found: dict[int, int] = {}
    for p, s in np.unique(np.column_stack([piece, np.concatenate(hit_state) // auto.classes]), axis=0).tolist():
        found[p] = found.get(p, 0) | auto.accepts[s]
    ends = np.append(cuts, n)
    return [(int(cuts[p]), int(ends[p + 1]), mask) for p, mask in sorted(found.items())]


def starts_of(auto: Automaton, piece: bytes) -> tuple[np.ndarray, list[int]]:
    """Of a backwards automaton: (places, accepted rules), ascending, where matches start."""
    steps, limit, state, found = auto.steps, auto.limit, auto.start * auto.classes, []
    for i, c in enumerate(piece[::-1].translate(auto.kinds)):
        state = steps[state + c]
        if state >= limit:
            found.append((i, state))
    found.reverse()
    return np.array([len(piece) - 1 - i for i, _ in found], np.int64), [auto.accepts[s // auto.classes] for _, s in found]


def longest_from(auto: Automaton, kinds: memoryview, at: int) -> int:
    """Of an anchored automaton and a text's byte classes: the end of the longest match from `at`, or -1."""
    steps, limit, dead, state, end = auto.steps, auto.limit, auto.dead, auto.start * auto.classes, -1
    for i, c in enumerate(kinds[at:], at + 1):
        state = steps[state + c]
        if state >= limit:
            end = i
        elif state == dead:
            break
    return end


class Matcher:
    """All rules' leftmost-longest matches that do not overlap, rule by rule."""

    def __init__(self, patterns: list[str], most: int = MOST_STATES):
        self.banks = list(_banks(list(enumerate(patterns)), most))
        self.alone = [compile_rules([p], anchored=True) for p in patterns]

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) over the rows of raw, segment by segment of each bank."""
        for numbers, forwards, backwards in self.banks:
            for first, last, mask in scan(forwards, raw, offsets):
                piece = raw[first:last].tobytes()
                places, rules = starts_of(backwards, piece)
                for j, k in enumerate(numbers):
                    if not mask >> j & 1:
                        continue
                    own = places[np.array([m >> j & 1 for m in rules], bool)]
                    kinds, i = memoryview(piece.translate(self.alone[k].kinds)), 0
                    while i < len(own):
                        start = int(own[i])
                        end = longest_from(self.alone[k], kinds, start)
                        yield k, first + start, first + end
                        i = int(np.searchsorted(own, end))


def _banks(rules: list[tuple[int, str]], most: int) -> Iterator[tuple[list[int], Automaton, Automaton]]:
    """(rule numbers, forwards, backwards): one bank of all rules, or halves where that has too many states."""
    patterns = [p for _, p in rules]
    try:
        yield [k for k, _ in rules], compile_rules(patterns, most=most), compile_rules(patterns, backwards=True, most=most)
    except TooManyStates:
        if len(rules) == 1:
            raise
        yield from _banks(rules[: len(rules) // 2], most)
        yield from _banks(rules[len(rules) // 2 :], most)
