"""From patterns to tables that a scan can step through.

Each pattern has a small deterministic automaton of its own, built on the
driver by subset construction.  Its rules:

* a scan starts at every position, for every pattern, on its own;
* it goes on while some path of the pattern still fits, and reports a match
  only if the *last* fitting position is an accepting one: an accept passed
  earlier is forgotten;
* a character that a negated set excludes makes the pattern fail, which ends
  the scan without a report - except on the first character, where the
  exclusion has no effect at all.

The automata of many patterns are joined: what is alive after the same
characters is one state, so that patterns with common beginnings share their
steps and a scan of thousands of patterns takes one place per start.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

from .ast import AnyChar, CharSet, Lit, MAX_CODE, Pattern, PatternTooComplex

STATE_LIMIT = 20_000


class Nfa:
    """Edges (intervals or None for any, target set) and what follows each place.

    A place is what a path has reached; ``follow[p]`` are the edges it can take.
    """

    def __init__(self, pattern: Pattern):
        self.edges: list[tuple[tuple | None, int]] = []  # (intervals, place reached)
        self.follow: list[set[int]] = [set()]  # place 0: nothing read yet
        self.final: set[int] = set()
        for alt in pattern.alternatives:
            ends = {0}
            for item in alt.items:
                first, last = self._atom(item.atom)
                if first is None:  # the empty run
                    continue
                for p in ends:
                    self.follow[p] |= first
                if item.repeated:
                    for p in last:
                        self.follow[p] |= first
                ends = ends | last if item.optional else last
            self.final |= ends
        self.failing = [False] * len(self.follow)
        for p in getattr(self, "_fails", ()):
            self.failing[p] = True

    def _place(self) -> int:
        self.follow.append(set())
        return len(self.follow) - 1

    def _edge(self, intervals: tuple | None, place: int) -> int:
        self.edges.append((intervals, place))
        return len(self.edges) - 1

    def _atom(self, atom) -> tuple[set[int] | None, set[int]]:
        """(edges to begin with, places at the end)"""
        if isinstance(atom, Lit):
            if not atom.text:
                return None, set()
            first, place = None, None
            for c in atom.text:
                new = self._place()
                e = self._edge(((ord(c), ord(c)),), new)
                if place is None:
                    first = {e}
                else:
                    self.follow[place].add(e)
                place = new
            return first, {place}
        end = self._place()
        if isinstance(atom, AnyChar):
            return {self._edge(None, end)}, {end}
        if isinstance(atom, CharSet):
            if not atom.negated:
                return {self._edge(atom.intervals, end)}, {end}
            fail = self._place()
            if not hasattr(self, "_fails"):
                self._fails: list[int] = []
            self._fails.append(fail)
            return {self._edge(None, end), self._edge(atom.intervals, fail)}, {end}
        raise TypeError(atom)


def boundaries(pattern: Pattern) -> set[int]:
    """Code points at which a character class of the pattern begins."""
    out = {0}
    for a in pattern.alternatives:
        for i in a.items:
            if isinstance(i.atom, Lit):
                ivs = [(ord(c), ord(c)) for c in i.atom.text]
            else:
                ivs = getattr(i.atom, "intervals", ())
            for lo, hi in ivs:
                out |= {lo, hi + 1}
    return {x for x in out if x <= MAX_CODE}


@dataclass
class Dfa:
    """Automaton of one pattern over its own classes.  State 0 is the start;
    ``trans[s, c]`` is a state, or -1 (dead) or -2 (fail)."""

    starts: list[int]  # first code point of each class
    trans: np.ndarray
    accept: np.ndarray
    sets: list[frozenset[int]]  # places of each state, for listings


def compile_dfa(pattern: Pattern, limit: int = STATE_LIMIT) -> Dfa:
    nfa = Nfa(pattern)
    starts = sorted(boundaries(pattern))
    hits = []  # per edge: classes on which it goes
    for intervals, _ in nfa.edges:
        on = np.zeros(len(starts), bool)
        if intervals is None:
            on[:] = True
        else:
            for lo, hi in intervals:
                i = bisect_left(starts, lo)
                j = bisect_left(starts, hi + 1)
                on[i:j] = True
        hits.append(on)
    begin = frozenset([0])
    number, sets, rows = {begin: 0}, [begin], []
    at = 0
    while at < len(sets):
        s = sets[at]
        edges = sorted(set().union(*(nfa.follow[p] for p in s)))
        row = np.full(len(starts), -1, np.int32)
        seen: dict[tuple[int, ...], int] = {}
        if len(edges) == 1 and not nfa.failing[nfa.edges[edges[0]][1]]:  # inside a literal
            t = frozenset([nfa.edges[edges[0]][1]])
            if t not in number:
                number[t] = len(sets)
                sets.append(t)
            row[hits[edges[0]]] = number[t]
        for c in range(len(starts)) if len(edges) > 1 or (row < 0).all() else ():
            key = tuple(e for e in edges if hits[e][c])
            if not key:
                continue
            if key not in seen:
                t = frozenset(nfa.edges[e][1] for e in key)
                if at and any(nfa.failing[p] for p in t):
                    seen[key] = -2
                else:
                    if t not in number:
                        number[t] = len(sets)
                        sets.append(t)
                        if len(sets) > limit:
                            raise PatternTooComplex(f"{pattern.source!r} has more than {limit} states")
                    seen[key] = number[t]
            row[c] = seen[key]
        rows.append(row)
        at += 1
    accept = np.array([any(p in nfa.final for p in s) for s in sets])
    return Dfa(starts, np.array(rows), accept, sets)


class _TooMany(Exception):
    pass


@dataclass
class Group:
    """Automaton of several patterns that scan from the same start together.

    A state is the set of (pattern, state of its own automaton) still alive.
    ``emit[s, c]`` names the list of patterns that end with an accept when c
    follows; its last column is the end of the text.
    """

    trans: np.ndarray  # states x classes; -1: nothing is alive
    emit: np.ndarray  # states x (classes + 1); 0: nothing
    lists: list[tuple[int, ...]]


def group_automaton(dfas: list[tuple[int, Dfa]], cuts: np.ndarray, limit: int) -> Group:
    """Product of the automata, as far as one start can reach it."""
    k = len(cuts)
    base, rows, accept, owner = [], [], [], []
    n = 0
    for pid, d in dfas:
        col = np.searchsorted(np.array(d.starts), cuts, side="right") - 1
        t = d.trans[:, col].astype(np.int64)
        rows.append(np.where(t >= 0, t + n, t))
        accept.append(d.accept)
        owner.append(np.full(len(t), pid))
        base.append(n)
        n += len(t)
    big = np.concatenate(rows)
    accepts, owners = np.concatenate(accept), np.concatenate(owner)
    number: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    lists: dict[tuple[int, ...], int] = {(): 0}

    def state(members: np.ndarray) -> int:
        key = members.tobytes()
        if key not in number:
            if len(sets) >= limit:
                raise _TooMany
            number[key] = len(sets)
            sets.append(members)
        return number[key]

    state(np.array(base))
    trans, emit = [], []
    at = 0
    while at < len(sets):
        s = sets[at]
        t, e = np.full(k, -1, np.int32), np.zeros(k + 1, np.int32)
        if len(s) == 1:  # one pattern alone
            r = big[s[0]]
            for v in set(r.tolist()):
                if v >= 0:
                    t[r == v] = state(np.array([v]))
            if at and accepts[s[0]]:
                e[np.append(r == -1, True)] = lists.setdefault((int(owners[s[0]]),), len(lists))
            trans.append(t)
            emit.append(e)
            at += 1
            continue
        sub = big[s]  # members x classes
        live = np.flatnonzero((sub != -1).any(0))
        ends = accepts[s] if at else np.zeros(len(s), bool)  # nothing ends before its first character
        if len(live):
            cols, inv = np.unique(sub[:, live].T, axis=0, return_inverse=True)
            inv = inv.reshape(-1)
            for i, c in enumerate(cols):
                on = live[inv == i]
                if (c >= 0).any():
                    t[on] = state(c[c >= 0])
                won = owners[s[(c == -1) & ends]]
                if len(won):
                    e[on] = lists.setdefault(tuple(won.tolist()), len(lists))
        if ends.any():
            every = lists.setdefault(tuple(owners[s[ends]].tolist()), len(lists))
            dead = np.ones(k, bool)
            dead[live] = False
            e[:k][dead] = every
            e[k] = every
        trans.append(t)
        emit.append(e)
        at += 1
    return Group(np.array(trans), np.array(emit), list(lists))


@dataclass
class Table:
    """Groups of patterns in one table: what executors step through.

    Row 0 stands for "nothing alive"; the last class of ``emit`` is the end of a
    text.  ``first_state[first_at[c] : first_at[c + 1]]`` are the states after a
    first character of class c.  ``list_at``/``list_of`` are the pattern lists.
    """

    class_starts: np.ndarray
    trans: np.ndarray  # states x classes, int32
    emit: np.ndarray  # states x (classes + 1), int32
    first_at: np.ndarray
    first_state: np.ndarray
    list_at: np.ndarray
    list_of: np.ndarray
    eternal: np.ndarray  # states that no character can change or end

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.class_starts, self.trans, self.emit, self.first_at, self.first_state, self.list_at, self.list_of, self.eternal))


def build_table(dfas: list[tuple[int, Dfa]], limit: int = 200_000) -> Table:
    """(pattern id, automaton) pairs to a table.  Patterns whose product grows
    over ``limit`` states are split until each part stays below."""
    cuts = np.array(sorted({x for _, d in dfas for x in d.starts} or {0}), np.int64)
    k = len(cuts)
    todo, groups = [dfas] if dfas else [], []
    while todo:
        part = todo.pop()
        try:
            # many patterns should share states; what multiplies is split early
            groups.append(group_automaton(part, cuts, limit if len(part) == 1 else min(limit, 64 + 2 * sum(len(d.trans) for _, d in part))))
        except _TooMany:
            todo += [part[: len(part) // 2], part[len(part) // 2 :]]
    trans, emit, lists = [np.zeros((1, k), np.int32)], [np.zeros((1, k + 1), np.int32)], [()]
    classes, states, base = [], [], 1
    for g in groups:
        t = np.where(g.trans >= 0, g.trans + base, 0).astype(np.int32)
        go = np.flatnonzero(t[0])
        classes.append(go)
        states.append(t[0][go])
        trans.append(t)
        emit.append(np.where(g.emit > 0, g.emit + len(lists) - 1, 0).astype(np.int32))
        lists += g.lists[1:]
        base += len(t)
    trans, emit = np.concatenate(trans), np.concatenate(emit)
    c = np.concatenate([*classes, np.zeros(0, np.int64)]).astype(np.int64)
    st = np.concatenate([*states, np.zeros(0, np.int32)])
    order = np.argsort(c, kind="stable")
    own = (trans == np.arange(len(trans))[:, None]).all(1) & (emit[:, :k] == 0).all(1)
    own[0] = False
    at = np.append(0, np.cumsum([len(x) for x in lists]))
    return Table(cuts, trans, emit, np.searchsorted(c[order], np.arange(k + 1)), st[order], at, np.array([p for x in lists for p in x], np.int64), own)
