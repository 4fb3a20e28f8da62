"""A slow, direct simulation of the pattern rules, for tests alone.

It walks sets of paths through the syntax tree, one start at a time.
"""

from __future__ import annotations

from sievewright.patterns.ast import AnyChar, CharSet, Lit
from sievewright.patterns.parser import parse

DONE = ("done",)


def _enter(alts, a, i):
    """Positions from which characters are read, on coming to item i of alternative a."""
    items = alts[a].items
    if i == len(items):
        return {DONE}
    item = items[i]
    out = set()
    if isinstance(item.atom, Lit) and not item.atom.text:
        return _enter(alts, a, i + 1)
    out.add((a, i, 0))
    if item.optional:
        out |= _enter(alts, a, i + 1)
    return out


def _after(alts, a, i):
    """The same, on having read all of item i."""
    out = _enter(alts, a, i + 1)
    if alts[a].items[i].repeated:
        out.add((a, i, 0))
    return out


def _step(alts, places, c):
    """(places, failed, any edge taken)"""
    out, failed, moved = set(), False, False
    for p in places:
        if p == DONE:
            continue
        a, i, k = p
        atom = alts[a].items[i].atom
        if isinstance(atom, Lit):
            if atom.text[k] == c:
                moved = True
                out |= {(a, i, k + 1)} if k + 1 < len(atom.text) else _after(alts, a, i)
        elif isinstance(atom, AnyChar):
            moved = True
            out |= _after(alts, a, i)
        elif isinstance(atom, CharSet):
            inside = any(lo <= ord(c) <= hi for lo, hi in atom.intervals)
            if atom.negated:
                moved = True
                failed |= inside
                out |= _after(alts, a, i)
            elif inside:
                moved = True
                out |= _after(alts, a, i)
    return out, failed, moved


def matches(pattern: str, text: str) -> set[tuple[int, int]]:
    alts = parse(pattern).alternatives
    found = set()
    for s in range(len(text)):
        places = set().union(*(_enter(alts, a, 0) for a in range(len(alts)))) if alts else set()
        end = None
        for e in range(s, len(text)):
            new, failed, moved = _step(alts, places, text[e])
            if e > s and failed:
                end = None
                break
            if not moved:
                break
            places, end = new, e
        if end is not None and DONE in places:
            found.add((s, end))
    return found
