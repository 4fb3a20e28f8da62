"""Sets of patterns: immutable, deduplicated by their text, compiled once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession

from .ast import Pattern, PatternError
from .automaton import Dfa, Table, build_table, compile_dfa
from .parser import parse

#: Entries of a shard's table (8 bytes each) that is sent to executors.
SHARD_ENTRIES = 6_000_000
#: Patterns that are taken from a table.
MOST_PATTERNS = 2_000_000


@lru_cache(100_000)
def _parsed(source: str) -> Pattern:
    return parse(source)


@lru_cache(20_000)
def _dfa(source: str) -> Dfa:
    return compile_dfa(_parsed(source))


def tables_of(patterns: Iterable[tuple[str, int]], entries: int, dfa, build) -> list[Table]:
    """Tables of (text, id) in order of the text, each of at most about so many entries."""
    out, part, states, cuts = [], [], 2, set()
    for source, i in patterns:
        d = dfa(source)
        n, c = states + len(d.trans), cuts | set(d.starts)
        if part and n * len(c) > entries:
            out.append(build(part))
            part, n, c = [], 2 + len(d.trans), set(d.starts)
        part.append((i, d))
        states, cuts = n, c
    if part:
        out.append(build(part))
    return out


@lru_cache(8)
def _tables(patterns: tuple[tuple[str, int], ...], entries: int) -> tuple[Table, ...]:
    """The same, made on the driver; the last few sets are kept, as one set is matched with often."""
    return tuple(tables_of(patterns, entries, _dfa, build_table))


@dataclass(frozen=True)
class PatternSet:
    """Patterns with their ids (place in the list) and actions (names).

    ``add`` and ``remove`` give new sets; a pattern leaves with its last action.
    """

    sources: tuple[str, ...] = ()
    actions: tuple[tuple[str, ...], ...] = ()

    @classmethod
    def of(cls, sources: Iterable[str]) -> PatternSet:
        out = dict.fromkeys(sources)
        for s in out:
            _parsed(s)
        return cls(tuple(out), (("match",),) * len(out))

    @classmethod
    def from_df(cls, df: DataFrame, column: str = "pattern", most: int = MOST_PATTERNS) -> PatternSet:
        """Patterns of a column, in order of the column; nulls are left out.

        They come to the driver, which compiles them: more than ``most`` raise.
        """
        got = df.select(column).where(df[column].isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} patterns")
        return cls.of(r[0] for r in got)

    def add(self, source: str, action: str = "match") -> PatternSet:
        _parsed(source)
        if source in self.sources:
            i = self.sources.index(source)
            acts = self.actions[i] if action in self.actions[i] else (*self.actions[i], action)
            return PatternSet(self.sources, (*self.actions[:i], acts, *self.actions[i + 1 :]))
        return PatternSet((*self.sources, source), (*self.actions, (action,)))

    def remove(self, source: str, action: str = "match") -> PatternSet:
        if source not in self.sources:
            return self
        i = self.sources.index(source)
        left = tuple(a for a in self.actions[i] if a != action)
        if left:
            return PatternSet(self.sources, (*self.actions[:i], left, *self.actions[i + 1 :]))
        return PatternSet(self.sources[:i] + self.sources[i + 1 :], self.actions[:i] + self.actions[i + 1 :])

    def __len__(self) -> int:
        return len(self.sources)

    @cached_property
    def parsed(self) -> list[Pattern]:
        return [_parsed(s) for s in self.sources]

    def dfa(self, i: int) -> Dfa:
        return _dfa(self.sources[i])

    def tables(self, ids: Iterable[int] | None = None, entries: int = SHARD_ENTRIES) -> list[Table]:
        """Tables of the patterns, split so that each has a bounded number of
        entries.  Patterns are taken in order of their text, so that those with
        common beginnings share states."""
        chosen = range(len(self)) if ids is None else ids
        return list(_tables(tuple((self.sources[i], i) for i in sorted(chosen, key=self.sources.__getitem__)), entries))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(pattern_id, pattern, actions)"""
        return spark.createDataFrame(list(zip(range(len(self)), self.sources, map(list, self.actions), strict=True)), "pattern_id int, pattern string, actions array<string>")


def try_parse(source: str) -> tuple[Pattern | None, str | None]:
    """(pattern, None) or (None, error)."""
    try:
        return _parsed(source), None
    except PatternError as e:
        return None, f"{type(e).__name__}: {e}"
