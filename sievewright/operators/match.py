"""Matching a pattern set against a text column.

``match_all`` is the main operator: one row per pattern and start.  How it runs
is decided before the plan exists (see ``plans.router``): in the automaton
kernel, or, for fixed texts and on request, as a join.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.patterns import PatternSet
from sievewright.plans.router import ARROW, JOIN, NATIVE, route
from sievewright.shipping import ship

from .bloom import ACTIVATION_PATTERNS, GramGate
from .dfa_kernel import counted_batches, match_batches, rows_with_match
from .literal_join import literal_matches, per_pattern
from .native import native_matches
from .prefilter import row_filter
from .shards import EVERY_BYTE, dealt_matches, tables_for

TEXT = "__text"


def gate_of(patterns: PatternSet, ids: list[int], bloom: str = "auto") -> GramGate | None:
    """The Bloom gate of the patterns.  ``auto`` uses it from ACTIVATION_PATTERNS
    patterns on; it needs a fixed beginning of every pattern, else there is none."""
    if bloom not in ("auto", "on", "off"):
        raise ValueError(f"bloom {bloom!r} is not one of auto, on, off")
    if bloom == "off" or bloom == "auto" and len(ids) < ACTIVATION_PATTERNS:
        return None
    return GramGate.of([patterns.parsed[i] for i in ids])


def _texts(df: DataFrame, patterns: PatternSet, ids: list[int], text_col: str, columns: list[str], prefilter: bool) -> DataFrame:
    """The columns, named c0, c1, ..., and, last, the text, of rows that may hold a match."""
    ship(df.sparkSession)
    rows = df.select(*[F.col(_quoted_name(c)).alias(f"c{i}") for i, c in enumerate(columns)], F.col(_quoted_name(text_col)).alias(TEXT))
    if prefilter:
        part = PatternSet(tuple(patterns.sources[i] for i in ids), tuple(patterns.actions[i] for i in ids))
        cond = row_filter(part, F.col(TEXT))
        rows = rows.where(cond) if cond is not None else rows
    return rows


def _quoted_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _kernel(rows: DataFrame, patterns: PatternSet, ids: list[int], shards: int | str, bloom: str, matched_text: bool, counters) -> DataFrame:
    fields = [*rows.schema.fields[:-1], T.StructField("pattern_id", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]
    fields += [T.StructField("matched_text", T.StringType())] * matched_text
    tables, gate = tables_for(rows.sparkSession, patterns, ids, shards), gate_of(patterns, ids, bloom)
    if isinstance(tables, DataFrame):
        return dealt_matches(rows, tables, patterns, fields, gate, matched_text)
    if counters is not None:
        for t in tables:
            counters.inc("dfa_states", len(t.trans))
            counters.inc("dfa_edges", int((t.trans > 0).sum()))
    fn = partial(match_batches, tables=tables, names=pa.array(patterns.sources, pa.string()), gate=gate, with_text=matched_text, counters=counters)
    return rows.mapInArrow(fn, T.StructType(fields))


def match_all(df: DataFrame, patterns: PatternSet, text_col: str = "text", keys: list[str] | None = None, strategy: str = "auto", prefilter: bool = True, shards: int | str = 1, bloom: str = "auto", matched_text: bool = False, counters=None) -> DataFrame:
    """(keys..., pattern_id, pattern, start_pos, end_pos): all matches of all
    patterns at all starts; places are code points from 0, both ends included.

    strategy: auto, join (fixed texts only), native or dfa.  shards: tables that
    the patterns are split into, by a hash of their text; ``auto`` takes as many as
    the cluster's cores ask for and the set has use for.  The texts are read once
    for all of them (see ``shards``).  bloom: see ``gate_of``.  matched_text: adds what matched.
    counters: ``stats.ObjectCounters`` to count states, scans and matches.
    Null texts match nothing.
    """
    keys = keys or [c for c in df.columns if c != text_col]
    parts, routed = [], route(patterns, list(range(len(patterns))), strategy)
    short = [f"c{i}" for i in range(len(keys))]
    if routed[JOIN]:
        lits = [(i, x) for i in routed[JOIN] for x in patterns.parsed[i].literals()]
        rows = _texts(df, patterns, routed[JOIN], text_col, keys, False)
        parts.append(with_pattern(literal_matches(rows, lits, TEXT, short, matched_text), patterns, short, matched_text))
    if routed[NATIVE]:
        rows = _texts(df, patterns, routed[NATIVE], text_col, keys, prefilter)
        parts += [with_pattern(m, patterns, short, matched_text) for m in native_matches(rows, patterns, routed[NATIVE], TEXT, short, matched_text)]
    if routed[ARROW]:
        rows = _texts(df, patterns, routed[ARROW], text_col, keys, prefilter)
        parts.append(_kernel(rows, patterns, routed[ARROW], shards, bloom, matched_text, counters))
    if not parts:
        none = df.select(*[F.col(_quoted_name(k)) for k in keys], F.lit(0).alias("pattern_id"), F.lit("").alias("pattern"), F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos"))
        return (none.withColumn("matched_text", F.lit("")) if matched_text else none).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.toDF(*keys, *out.columns[len(keys) :])


def with_pattern(matches: DataFrame, patterns: PatternSet, keys: list[str], matched_text: bool = False) -> DataFrame:
    """Adds the pattern's text to matches of the join: small sets as an array literal, large by a join."""
    cols = [*keys, "pattern_id", "pattern", "start_pos", "end_pos", *["matched_text"] * matched_text]
    if len(patterns) <= 1000:
        names = F.array(*[F.lit(s) for s in patterns.sources])
        return matches.withColumn("pattern", F.element_at(names, F.col("pattern_id") + 1)).select(*cols)
    names = matches.sparkSession.createDataFrame(list(enumerate(patterns.sources)), "pattern_id int, pattern string")
    return matches.join(per_pattern(names, len(patterns)), "pattern_id").select(*cols)


def with_actions(matches: DataFrame, patterns: PatternSet) -> DataFrame:
    """One row per match and action of its pattern, in a column ``action``."""
    acts = patterns.to_df(matches.sparkSession).select("pattern_id", F.explode("actions").alias("action"))
    return matches.join(per_pattern(acts, sum(map(len, patterns.actions))), "pattern_id")


def match_counts(df: DataFrame, patterns: PatternSet, text_col: str = "text", strategy: str = "auto", prefilter: bool = True, bloom: str = "auto") -> DataFrame:
    """(pattern, n): matches of each pattern, 0 included; no row per match is made."""
    ids = list(range(len(patterns)))
    names = patterns.to_df(df.sparkSession).select("pattern_id", "pattern")
    routed = route(patterns, ids, strategy)
    tables = tables_for(df.sparkSession, patterns, ids) if routed[ARROW] else None
    if not isinstance(tables, list):
        n = match_all(df.select(F.lit(0).alias("k"), F.col(text_col)), patterns, text_col, ["k"], strategy).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    else:
        rows = _texts(df, patterns, ids, text_col, [], prefilter)
        fn = partial(counted_batches, tables=tables, n_patterns=len(patterns), gate=gate_of(patterns, ids, bloom))
        n = rows.mapInArrow(fn, "pattern_id int, n long").groupBy("pattern_id").agg(F.sum("n").alias("n"))
    return names.join(n, "pattern_id", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_rollup(matches: DataFrame, column: str = "pattern") -> DataFrame:
    """(pattern, n): per pattern and, with a null pattern, in all."""
    return matches.rollup(column).agg(F.count(F.lit(1)).alias("n"))


def match_any(df: DataFrame, patterns: PatternSet, text_col: str = "text", keys: list[str] | None = None, prefilter: bool = True, bloom: str = "auto") -> DataFrame:
    """The rows of ``df`` in which some pattern matches, each as often as it is
    there: all their columns, or just ``keys``."""
    ids = list(range(len(patterns)))
    keys = keys or df.columns
    rows = _texts(df, patterns, ids, text_col, keys, prefilter)
    fn = partial(rows_with_match, tables=tables_for(df.sparkSession, patterns, ids, most_bytes=EVERY_BYTE), gate=gate_of(patterns, ids, bloom))
    return rows.mapInArrow(fn, T.StructType(rows.schema.fields[:-1])).toDF(*keys)


def is_single(start: str = "start_pos", end: str = "end_pos"):
    """A match of one character: both ends are the same."""
    return F.col(end) == F.col(start)
