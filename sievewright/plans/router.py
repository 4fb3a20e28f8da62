"""Which way each pattern runs; decided on the driver, before Spark plans."""

from __future__ import annotations

from sievewright.operators.native import scan_of
from sievewright.patterns import PatternSet

JOIN, NATIVE, ARROW = "join", "native", "dfa"


def route(patterns: PatternSet, ids: list[int], strategy: str = "auto") -> dict[str, list[int]]:
    """Pattern ids by way.

    ``auto`` takes the kernel for all: its automaton shares the beginnings of
    all patterns and takes one step per character, nine times as fast as the
    join on six fixed texts (README).  ``join`` runs without Python on the
    executors; only patterns whose alternatives are all fixed texts, none a
    proper prefix of another, can be a join - for others a match depends on
    what follows it.  ``native`` runs patterns as expressions of the JVM, all
    but those that are unbounded without a character that ends them.
    """
    if strategy not in ("auto", JOIN, NATIVE, ARROW):
        raise ValueError(f"strategy {strategy!r} is not one of auto, join, native, dfa")
    if strategy == NATIVE:
        for i in ids:
            scan_of(patterns.sources[i])  # raises if there is none
        return {JOIN: [], NATIVE: list(ids), ARROW: []}
    if strategy == JOIN:
        for i in ids:
            if patterns.parsed[i].literals() is None:
                raise ValueError(f"{patterns.sources[i]!r} is no fixed text, so it can't run as a join")
        return {JOIN: list(ids), NATIVE: [], ARROW: []}
    return {JOIN: [], NATIVE: [], ARROW: list(ids)}


def explain_route(patterns: PatternSet, strategy: str = "auto") -> list[tuple[str, str]]:
    """(pattern, way) in order of the set."""
    got = route(patterns, list(range(len(patterns))), strategy)
    way = {i: k for k, ids in got.items() for i in ids}
    return [(s, way[i]) for i, s in enumerate(patterns.sources)]
