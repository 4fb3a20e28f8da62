"""A Bloom filter over the beginnings of patterns, as a gate before the automata.

A match can begin only where the first characters of some pattern stand.  For
patterns whose alternatives all begin with fixed text, the first characters -
up to ``GRAM``, as many as every pattern has - go into a Bloom filter; places of
a text whose own characters are not in it begin no scan.  A false positive only costs a scan that finds nothing,
so results are the same with and without the gate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from sievewright.patterns.ast import Lit, Pattern

U = np.uint64
#: Patterns from which on the gate is used by itself; fixed value.
ACTIVATION_PATTERNS = 5000
#: Share of false positives that the filter is sized for.
FALSE_POSITIVES = 0.05
#: Longest beginning that is looked at.
GRAM = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


@dataclass(frozen=True)
class BloomFilter:
    """Bits for 64-bit items; sized for their number and a share of false positives."""

    bits: np.ndarray
    hashes: int

    @classmethod
    def of(cls, items: np.ndarray, false_positives: float = FALSE_POSITIVES) -> BloomFilter:
        n = max(1, len(items))
        size = 1 << max(6, math.ceil(math.log2(-n * math.log(false_positives) / math.log(2) ** 2)))
        out = cls(np.zeros(size, bool), max(1, round(size / n * math.log(2))) if size / n < 16 else 8)
        at, step = out._places(items)
        for _ in range(out.hashes):
            out.bits[at] = True
            at = (at + step) & (size - 1)
        return out

    def _places(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of each item, and the step to its next ones."""
        h = _mixed(items)
        return (h & U(len(self.bits) - 1)).astype(np.int64), ((h >> U(40)) | U(1)).astype(np.int64)

    def might_contain(self, items: np.ndarray) -> np.ndarray:
        at, step = self._places(items)
        out = self.bits[at]
        left = np.flatnonzero(out)
        at, step = at[left], step[left]
        for _ in range(self.hashes - 1):  # most items are out after the first probe
            at = (at + step) & (len(self.bits) - 1)
            on = self.bits[at]
            out[left[~on]] = False
            left, at, step = left[on], at[on], step[on]
        return out


def beginnings(pattern: Pattern) -> list[str] | None:
    """What its alternatives begin with, up to GRAM characters; None if one may begin otherwise."""
    out = []
    for a in pattern.alternatives:
        first = a.items[0] if a.items else None
        if first is None or not isinstance(first.atom, Lit) or first.optional or not first.atom.text:
            return None
        out.append(first.atom.text[:GRAM])
    return out or None


#: What the characters of a beginning count by their place.
_PLACE = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(GRAM)]


def _items(grams: list[str]) -> np.ndarray:
    return np.array([sum(ord(c) * _PLACE[i] for i, c in enumerate(g)) % (1 << 64) for g in grams], U)


@dataclass(frozen=True)
class GramGate:
    """A filter over the first ``size`` characters of all patterns."""

    size: int
    filter: BloomFilter

    @classmethod
    def of(cls, patterns: list[Pattern]) -> GramGate | None:
        """The gate of a set of patterns, or None if one of them has no fixed beginning."""
        grams: set[str] = set()
        for p in patterns:
            got = beginnings(p)
            if got is None:
                return None
            grams.update(got)
        if not grams:
            return None
        size = min(map(len, grams))
        return cls(size, BloomFilter.of(_items(sorted({g[:size] for g in grams}))))

    def may_begin(self, codes: np.ndarray) -> np.ndarray:
        """Places at which some pattern may begin; texts stand end to end, so a place
        near the end of one is let through for what the next one begins with."""
        n = len(codes) - self.size + 1
        out = np.zeros(len(codes), bool)
        if n > 0:
            wide = codes.astype(U)
            item = wide[:n] * U(_PLACE[0])
            for i in range(1, self.size):
                item += wide[i : i + n] * U(_PLACE[i])
            out[:n] = self.filter.might_contain(item)
        return out
