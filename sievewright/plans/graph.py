"""Listings of automata: states and edges as DataFrames, and Graphviz text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.patterns import PatternSet
from sievewright.patterns.ast import MAX_CODE
from sievewright.patterns.automaton import Nfa

EDGE = "pattern string, src int, dst int, label string"
NODE = "pattern string, node int, accept boolean, fail boolean"


def _name(lo: int, hi: int) -> str:
    if (lo, hi) == (0, MAX_CODE):
        return "."
    show = lambda c: chr(c) if 32 < c < 127 else f"U+{c:04X}"
    return show(lo) if lo == hi else f"{show(lo)}-{show(hi)}"


def nfa_graph(spark: SparkSession, patterns: PatternSet) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the pattern's paths."""
    nodes, edges = [], []
    for src, p in zip(patterns.sources, patterns.parsed, strict=True):
        nfa = Nfa(p)
        nodes += [(src, i, i in nfa.final, nfa.failing[i]) for i in range(len(nfa.follow))]
        for i, out in enumerate(nfa.follow):
            for e in sorted(out):
                ivs, to = nfa.edges[e]
                edges.append((src, i, to, "." if ivs is None else ",".join(_name(*x) for x in ivs)))
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def dfa_graph(spark: SparkSession, patterns: PatternSet) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the deterministic automata; a failing edge goes to -2."""
    nodes, edges = [], []
    for i, src in enumerate(patterns.sources):
        d = patterns.dfa(i)
        ends = [*(x - 1 for x in d.starts[1:]), MAX_CODE]
        nodes += [(src, s, bool(a), False) for s, a in enumerate(d.accept)]
        for s, row in enumerate(d.trans.tolist()):
            by: dict[int, list[list[int]]] = {}
            for c, t in enumerate(row):
                if t != -1:
                    spans = by.setdefault(t, [])
                    if spans and spans[-1][1] + 1 == d.starts[c]:
                        spans[-1][1] = ends[c]
                    else:
                        spans.append([d.starts[c], ends[c]])
            edges += [(src, s, t, ",".join(_name(*x) for x in spans)) for t, spans in by.items()]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def live_sets(spark: SparkSession, patterns: PatternSet, prefixes: list[str]) -> DataFrame:
    """(prefix, pattern_id, pattern, accepts): the patterns that a scan still
    follows after reading a prefix, and whether it could end there."""
    rows = []
    for prefix in prefixes:
        for i, source in enumerate(patterns.sources):
            d, state = patterns.dfa(i), 0
            for c in prefix:
                state = int(d.trans[state, np.searchsorted(d.starts, ord(c), side="right") - 1])
                if state < 0:
                    break
            if state >= 0:
                rows.append((prefix, i, source, bool(d.accept[state])))
    return spark.createDataFrame(rows, "prefix string, pattern_id int, pattern string, accepts boolean")


def graphviz(nodes: DataFrame, edges: DataFrame, name: str = "patterns") -> DataFrame:
    """(line_no, line) of a Graphviz file; write with ``orderBy('line_no')`` and text."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.lit(1).alias("o"), F.concat(F.lit("  "), quote(F.concat_ws("#", "pattern", F.col("node").cast("string"))), F.when(F.col("accept"), " [shape=doublecircle];").when(F.col("fail"), " [shape=box];").otherwise(" [shape=circle];")).alias("line"))
    e = edges.select(F.lit(2).alias("o"), F.concat(F.lit("  "), quote(F.concat_ws("#", "pattern", F.col("src").cast("string"))), F.lit(" -> "), quote(F.concat_ws("#", "pattern", F.col("dst").cast("string"))), F.lit(" [label="), quote(F.col("label")), F.lit("];")).alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, f"digraph {name} {{"), (3, "}")], "o int, line string")
    # one window: the automata of a pattern set, which the driver has listed itself
    return n.union(e).union(ends).select((F.row_number().over(Window.orderBy("o", "line")) - 1).alias("line_no"), "line")
