"""Parser of the pattern language.

    pattern   literal runs, . [set] [^set] ? * + and | between alternatives
    run       all characters but | \\ . ^ $ ? * + [ ; so ( ) { } ] stand for
              themselves
    quantifier on the last fragment, and a run is one fragment: ab+ repeats ab
    set       characters and ranges a-z up to ]; a dash at the end is dropped,
              an end without ] is taken as one

Escapes don't exist (a backslash is an error), anchors are known but not
supported, and a quantifier needs a fragment before it in its alternative.
"""

from __future__ import annotations

from .ast import Alternative, AnyChar, Atom, CharSet, Interval, Item, Lit, Pattern, PatternSyntaxError, UnsupportedPattern


class _Parser:
    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.done: list[Alternative] = []
        self.items: list[Item] = []
        self.run: list[str] = []

    def fail(self, what: str) -> PatternSyntaxError:
        return PatternSyntaxError(f"{what} at {self.at} in {self.source!r}")

    def add(self, atom: Atom) -> None:
        self.items.append(Item(atom))

    def end_run(self) -> None:
        if self.run:
            self.add(Lit("".join(self.run)))
            self.run = []

    def parse(self) -> Pattern:
        while self.at < len(self.source):
            c = self.source[self.at]
            self.at += 1
            if c == "|":
                self.end_run()
                self.done.append(Alternative(self.items))  # also an empty one
                self.items = []
            elif c in "?*+":
                self.end_run()
                if not self.items:
                    raise self.fail(f"nothing before {c}")
                last = self.items[-1]
                last.optional |= c in "?*"
                last.repeated |= c in "*+"
            elif c == ".":
                self.end_run()
                self.add(AnyChar())
            elif c == "[":
                self.end_run()
                self.add(self.char_set())
            elif c == "\\":
                raise self.fail("escapes are not part of the language")
            elif c in "^$":
                raise UnsupportedPattern(f"anchor {c} at {self.at - 1} in {self.source!r}")
            else:
                self.run.append(c)
        self.end_run()
        if self.items:
            self.done.append(Alternative(self.items))  # a last | adds none
        return Pattern(self.source, self.done)

    def char_set(self) -> CharSet:
        if self.at >= len(self.source):
            raise self.fail("set without end")
        negated = self.source[self.at] == "^"
        self.at += negated
        singles: list[str] = []
        ranges: list[Interval] = []
        pending = False  # a dash was seen
        while self.at < len(self.source):
            c = self.source[self.at]
            self.at += 1
            if c == "]":
                break
            if c == "-":
                pending = True
            elif pending:
                if not singles:
                    raise self.fail("range without start")
                low = singles.pop()
                if low > c:
                    raise self.fail(f"range {low}-{c} is reversed")
                ranges += [(ord(x), ord(x)) for x in singles] + [(ord(low), ord(c))]
                singles, pending = [], False
            else:
                singles.append(c)
        ranges += [(ord(x), ord(x)) for x in singles]
        return CharSet(tuple(sorted(set(ranges))), negated)


def parse(source: str) -> Pattern:
    """Pattern text to its tree; raises PatternError."""
    return _Parser(source).parse()
