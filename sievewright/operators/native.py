"""Patterns as regular expressions of the JVM: no Python on the executors.

What a scan reports is settled by the first character that ends it: if the
automaton is in an accepting state there and the character is one that no path
takes (and none that a negated set excludes), the scan is a match.  The words
"path to an accepting state, then such a character or the end of the text" form
a language of which a text has one beginning at most, as the automaton is
deterministic.  So a backtracking engine finds the right end or none, in
whatever order it tries.

The expression is got from the automaton by eliminating states, or, where that
would need a loop around more than a fixed run of characters (such loops recurse
in the JVM) and all accepting states are ended by the same characters, from the
tree of the pattern.

All starts of a piece of text are found in one walk: a gap of at least one
character up to the next place at which the expression fits, the expression
standing in a lookahead with its match in a group.  The sum of the gaps so far is
the place.

Texts are walked in pieces.  A bounded pattern takes pieces of ``CHUNK`` places
that overlap by its length.  An unbounded one needs characters that end every
scan of it: texts are cut in front of such characters, so no scan goes over a
cut.  A pattern that is unbounded and has none of them (``.*``) has no native way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.patterns import PatternSet
from sievewright.patterns.ast import MAX_CODE, AnyChar, Interval, Lit, Pattern
from sievewright.patterns.automaton import Dfa, PatternTooComplex, compile_dfa

#: Places of a piece.
CHUNK = 2048
#: Characters of an expression; a longer one has no native way.
MOST = 20_000
#: Longest match of a pattern whose pieces overlap.
MOST_OVERLAP = 512


class NoNativeWay(ValueError):
    """The pattern can't run as an expression; the text says why."""


# ---- expressions ---------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """An expression: its text, how tightly it holds together, and whether all its
    matches are runs of as many characters (then the JVM repeats it in a loop)."""

    text: str
    kind: str  # atom, cat, alt
    fixed: bool

    def within(self, kind: str) -> str:
        loose = self.kind == "alt" or kind == "atom" and self.kind == "cat"
        return f"(?:{self.text})" if loose else self.text


EMPTY = Part("", "cat", True)


def one_of(intervals: list[Interval]) -> Part:
    if intervals == [(0, MAX_CODE)]:
        return Part("(?s:.)", "atom", True)
    body = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in intervals)
    return Part(body if len(intervals) == 1 and intervals[0][0] == intervals[0][1] else f"[{body}]", "atom", True)


def joined(a: Part, b: Part) -> Part:
    if not a.text or not b.text:
        return b if not a.text else a
    return Part(a.within("cat") + b.within("cat"), "cat", a.fixed and b.fixed)


def either(a: Part | None, b: Part | None) -> Part | None:
    if a is None or b is None or a == b:
        return a or b
    return Part(f"{a.text}|{b.text}", "alt", False)


def repeated(a: Part | None) -> Part:
    if a is None or not a.text:
        return EMPTY
    if not a.fixed:
        raise NoNativeWay("a loop around alternatives")
    return Part(a.within("atom") + "*", "cat", False)


def spans(dfa: Dfa, classes: np.ndarray) -> list[Interval]:
    """The classes (a mask) as few intervals of characters."""
    out: list[Interval] = []
    for c in np.flatnonzero(classes).tolist():
        lo, hi = dfa.starts[c], dfa.starts[c + 1] - 1 if c + 1 < len(dfa.starts) else MAX_CODE
        if out and out[-1][1] + 1 == lo:
            lo = out.pop()[0]
        out.append((lo, hi))
    return out


# ---- from a pattern to its scan --------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """How a pattern is found: ``ended`` fits a match that a character or the end of
    the text ends, ``inner`` one that a character ends.  ``longest``: most characters of
    a scan; ``cut``: characters that end every scan."""

    ended: str
    inner: str
    longest: int | None
    cut: tuple[Interval, ...]


def _ahead(dfa: Dfa, state: int, at_end: bool) -> Part | None:
    """What must follow a match that ends in the state; None: nothing can."""
    kill = dfa.trans[state] == -1
    if kill.all():
        return EMPTY
    how = [one_of(spans(dfa, kill)).text] * bool(kill.any()) + ["\\z"] * at_end
    return Part(f"(?={'|'.join(how)})", "atom", False) if how else None


def _eliminated(dfa: Dfa, at_end: bool) -> Part | None:
    """Expression of all ways from the start to a match's end."""
    final = -1
    edges: dict[tuple[int, int], Part] = {}
    for s in range(len(dfa.trans)):
        for t in np.unique(dfa.trans[s][dfa.trans[s] >= 0]).tolist():
            edges[s, t] = one_of(spans(dfa, dfa.trans[s] == t))
        if s and dfa.accept[s] and (end := _ahead(dfa, s, at_end)) is not None:
            edges[s, final] = end
    left = set(range(1, len(dfa.trans)))
    while left:
        into = {s: [a for a, b in edges if b == s and a != s] for s in left}
        out = {s: [b for a, b in edges if a == s and b != s] for s in left}
        s = min(left, key=lambda x: (len(into[x]) * len(out[x]), x))
        loop = repeated(edges.pop((s, s), None)) if into[s] and out[s] else EMPTY
        for a in into[s]:
            for b in out[s]:
                edges[a, b] = either(edges.get((a, b)), joined(joined(edges[a, s], loop), edges[s, b]))
                if len(edges[a, b].text) > MOST:
                    raise NoNativeWay("the expression is too long")
        edges = {k: v for k, v in edges.items() if s not in k}
        left.remove(s)
    return edges.get((0, final))


def _of_tree(pattern: Pattern, dfa: Dfa, at_end: bool) -> Part | None:
    """Expression of the pattern as it is written, and what must follow."""
    ends = {dfa.trans[s].__eq__(-1).tobytes(): s for s in range(1, len(dfa.trans)) if dfa.accept[s]}
    if len(ends) != 1 or pattern.has_negated_set() or any(not a.min_length() for a in pattern.alternatives):
        raise NoNativeWay("accepting states that end in different ways")
    if any(sum(i.repeated for i in a.items) > 2 for a in pattern.alternatives):
        raise NoNativeWay("more than two loops")
    end = _ahead(dfa, next(iter(ends.values())), at_end)
    if end is None:
        return None
    body: Part | None = None
    for a in pattern.alternatives:
        whole = EMPTY
        for i in a.items:
            if isinstance(i.atom, Lit):
                p = EMPTY
                for c in i.atom.text:
                    p = joined(p, one_of([(ord(c), ord(c))]))
            elif isinstance(i.atom, AnyChar):
                p = one_of([(0, MAX_CODE)])
            elif i.atom.intervals:
                p = one_of(list(i.atom.intervals))
            else:
                p = Part("(?!)", "atom", False)
            if i.optional or i.repeated:
                p = Part(p.within("atom") + ("*" if i.optional and i.repeated else "+" if i.repeated else "?"), "cat", False)
            whole = joined(whole, p)
        body = either(body, whole)
    return joined(body, end)


def _longest(dfa: Dfa) -> int | None:
    """Most characters that a scan can take; None without a bound."""
    depth: dict[int, int] = {}
    todo = [(0, iter(set(dfa.trans[0][dfa.trans[0] >= 0].tolist())))]
    open_ = {0}
    while todo:
        s, rest = todo[-1]
        t = next(rest, None)
        if t is None:
            depth[s] = max((depth[x] + 1 for x in dfa.trans[s][dfa.trans[s] >= 0].tolist()), default=0)
            open_.discard(s)
            todo.pop()
        elif t in open_:
            return None
        elif t not in depth:
            open_.add(t)
            todo.append((t, iter(set(dfa.trans[t][dfa.trans[t] >= 0].tolist()))))
    return depth[0]


@lru_cache(10_000)
def scan_of(pattern_source: str) -> Scan:
    """The native way of a pattern, or NoNativeWay."""
    from sievewright.patterns.parser import parse

    pattern = parse(pattern_source)
    try:
        dfa = compile_dfa(pattern, 300)
    except PatternTooComplex as e:
        raise NoNativeWay(str(e)) from None
    longest = _longest(dfa)
    live = dfa.trans[1:]
    cut = tuple(spans(dfa, (live == -1).all(0))) if len(live) else ()
    if longest is None and not cut or longest is not None and longest > MOST_OVERLAP and not cut:
        raise NoNativeWay(f"no character ends every scan of {pattern_source!r}")
    try:
        parts = [_eliminated(dfa, e) for e in (True, False)]
    except NoNativeWay:
        parts = [_of_tree(pattern, dfa, e) for e in (True, False)]
    ended, inner = ("(?!)" if p is None else p.text for p in parts)
    if len(ended) > MOST:
        raise NoNativeWay("the expression is too long")
    return Scan(ended, inner, longest if longest is not None and longest <= MOST_OVERLAP else None, cut)


def has_native_way(pattern_source: str) -> bool:
    try:
        scan_of(pattern_source)
    except NoNativeWay:
        return False
    return True


def _common(a: list[Interval], b: list[Interval]) -> list[Interval]:
    return [(max(x, u), min(y, v)) for x, y in a for u, v in b if max(x, u) <= min(y, v)]


def others(a: list[Interval]) -> list[Interval]:
    """The characters that are not in sorted intervals."""
    edges = [0, *(x for lo, hi in a for x in (lo, hi + 1)), MAX_CODE + 1]
    return [(lo, hi - 1) for lo, hi in zip(edges[::2], edges[1::2], strict=True) if lo < hi]


def cut_groups(scans: list[tuple[int, Scan]]) -> list[tuple[list[Interval], list[tuple[int, Scan]]]]:
    """Unbounded patterns in few groups that can share their cuts."""
    out: list[tuple[list[Interval], list[tuple[int, Scan]]]] = []
    for i, s in scans:
        for k, (cut, members) in enumerate(out):
            both = _common(cut, list(s.cut))
            if both:
                out[k] = (both, [*members, (i, s)])
                break
        else:
            out.append((list(s.cut), [(i, s)]))
    return out


# ---- running it --------------------------------------------------------------------


#: Numbers that are added up one after the other before they are put together.
_SUMMED = 32


def running_sums(sizes: Column) -> Column:
    """Array of the sums of the first 1, 2, ... numbers; in blocks, as an array that grows by one is copied each time."""
    grown = lambda xs, first: F.aggregate(xs, F.array(first), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(_SUMMED)), lambda i: i <= F.size(sizes))
    blocks = F.transform(starts, lambda i: F.slice(sizes, i, F.lit(_SUMMED)))
    before = grown(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, first: F.slice(grown(b, first), F.lit(2), F.size(b))))


def _walk(piece: Column, expression: str) -> tuple[Column, Column]:
    """The gaps between all starts in a piece (lengths), and the matches there (texts)."""
    # a character before the piece, so that a gap is never empty; \\G, so that what has no more matches is walked once
    walk, text = f"\\G(?s:.)+?(?=({expression}))", F.concat(F.lit(" "), piece)
    return F.transform(F.regexp_extract_all(text, F.lit(walk), F.lit(0)), F.length), F.regexp_extract_all(text, F.lit(walk), F.lit(1))


def _matches(pieces: DataFrame, keys: list[str], walks: list[tuple[int, Column, Column]], most: int | None, matched_text: bool) -> DataFrame:
    """pieces (keys..., __at, __piece[, __last]) and, for each pattern, its gaps and texts there to
    matches; starts from ``most`` on belong to the next piece."""
    # gaps are columns before they are added up: what is used more than once is computed once
    w = pieces.select(*keys, "__at", *[c for i, g, x in walks for c in (g.alias(f"__g{i}"), x.alias(f"__x{i}"))])
    match = lambda i: lambda at, x: F.struct(F.lit(i).alias("pattern_id"), (at - 1).alias("at"), x.alias("text"))
    found = [F.zip_with(running_sums(F.col(f"__g{i}")), F.col(f"__x{i}"), match(i)) for i, _, _ in walks]
    m = w.select(*keys, "__at", F.explode(F.flatten(F.array(*found))).alias("__m"))
    if most is not None:
        m = m.where(F.col("__m.at") < most)
    start = F.col("__at") + F.col("__m.at")
    return m.select(*keys, F.col("__m.pattern_id").alias("pattern_id"), start.alias("start_pos"), (start + F.length("__m.text") - 1).alias("end_pos"), *[F.col("__m.text").alias("matched_text")] * matched_text)


def native_matches(df: DataFrame, patterns: PatternSet, ids: list[int], text_col: str, keys: list[str], matched_text: bool = False, chunk: int = CHUNK) -> list[DataFrame]:
    """(keys..., pattern_id, start_pos, end_pos[, matched_text]): one DataFrame, one scan of
    the texts, for all bounded patterns, and one for each group of unbounded ones."""
    scans = [(i, scan_of(patterns.sources[i])) for i in ids]
    scans = [(i, s) for i, s in scans if s.ended != "(?!)"]
    rows = df.select(*keys, F.col(text_col).alias("__text")).where(F.length("__text") > 0)
    out = []
    bounded = [(i, s) for i, s in scans if s.longest is not None]
    if bounded:
        wide = chunk + max(s.longest for _, s in bounded)
        at = F.sequence(F.lit(0), F.length("__text") - 1, F.lit(chunk))
        w = rows.select(*keys, "__text", F.explode(at).alias("__at"))
        w = w.select(*keys, "__at", F.substring(F.col("__text"), F.col("__at") + 1, F.lit(wide)).alias("__piece"), (F.col("__at") + wide >= F.length("__text")).alias("__last"))
        piece, last = F.col("__piece"), F.col("__last")
        walks = []
        for i, s in bounded:
            ended, inner = _walk(piece, s.ended), _walk(piece, s.inner)
            walks.append((i, *ended) if s.ended == s.inner else (i, *(F.when(last, a).otherwise(b) for a, b in zip(ended, inner, strict=True))))
        out.append(_matches(w, keys, walks, chunk, matched_text))
    for cut, members in cut_groups([(i, s) for i, s in scans if s.longest is None]):
        # up to the next character that ends all: no scan goes on behind it
        goes_on = others(cut)
        pieces = F.regexp_extract_all(F.col("__text"), F.lit(f"(?s:.{{1,{chunk}}})" + (one_of(goes_on).text + "*+" if goes_on else "")), F.lit(0))
        w = rows.select(*keys, pieces.alias("__pieces"))
        w = w.select(*keys, "__pieces", F.transform("__pieces", F.length).alias("__sizes"))
        w = w.select(*keys, F.explode(F.zip_with("__pieces", running_sums(F.col("__sizes")), lambda p, a: F.struct(p.alias("piece"), (a - F.length(p)).alias("at")))).alias("__p"))
        w = w.select(*keys, F.col("__p.at").alias("__at"), F.col("__p.piece").alias("__piece"))
        out.append(_matches(w, keys, [(i, *_walk(F.col("__piece"), s.ended)) for i, s in members], None, matched_text))
    return out
