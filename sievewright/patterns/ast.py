"""Syntax trees of the pattern language, and its errors."""

from __future__ import annotations

from dataclasses import dataclass, field


class PatternError(ValueError):
    """A pattern that can't be compiled."""


class PatternSyntaxError(PatternError):
    """The text is not a pattern."""


class UnsupportedPattern(PatternError):
    """A construct that the language knows but does not support (anchors)."""


class PatternTooComplex(PatternError):
    """The automaton of a single pattern exceeds the state limit."""


Interval = tuple[int, int]  # code points, both ends included
MAX_CODE = 0x10FFFF


@dataclass(frozen=True)
class Lit:
    """A run of characters that must all follow; may be empty."""

    text: str


@dataclass(frozen=True)
class AnyChar:
    """One character, line breaks included."""


@dataclass(frozen=True)
class CharSet:
    """One character of the intervals.  Negated, the characters of the
    intervals let the pattern fail, though they also get through."""

    intervals: tuple[Interval, ...]
    negated: bool = False


Atom = Lit | AnyChar | CharSet


@dataclass
class Item:
    """A fragment with the quantifiers put on it; several add up."""

    atom: Atom
    optional: bool = False  # ? or *
    repeated: bool = False  # + or *

    def min_length(self) -> int:
        if self.optional:
            return 0
        return len(self.atom.text) if isinstance(self.atom, Lit) else 1


@dataclass
class Alternative:
    items: list[Item] = field(default_factory=list)

    def min_length(self) -> int:
        return sum(i.min_length() for i in self.items)

    def literal(self) -> str | None:
        """The text, if this is one fixed text and nothing else."""
        if all(isinstance(i.atom, Lit) and not i.optional and not i.repeated for i in self.items):
            return "".join(i.atom.text for i in self.items)
        return None


@dataclass
class Pattern:
    source: str
    alternatives: list[Alternative]

    def min_length(self) -> int:
        """Least characters of a match; a match is never empty."""
        return max(1, min((a.min_length() for a in self.alternatives), default=1))

    def literals(self) -> list[str] | None:
        """The alternatives' texts if all are fixed, none is empty and none is a
        proper prefix of another.  Only then a match needs no look beyond it."""
        got = [a.literal() for a in self.alternatives]
        if not got or any(not x for x in got):
            return None
        texts = sorted(set(got))
        if any(y.startswith(x) for x, y in zip(texts, texts[1:], strict=False)):
            return None
        return texts

    def has_negated_set(self) -> bool:
        return any(isinstance(i.atom, CharSet) and i.atom.negated for a in self.alternatives for i in a.items)
