"""The standard regular-expression matcher, to compare with.

Leftmost, not overlapping, greedy, and it remembers earlier accepts - unlike
``match_all``.  Patterns are in the syntax of the JVM; ``.`` takes line breaks.

Places come from two walks of the JVM over a text: the matches, and each match
with what lies between it and the one before.  The running sum of the latter's
lengths is where matches end.  A pattern that fits the empty text has its walk
broken by empty matches, which the JVM and Python also order differently; such
patterns run in Python, row by row.  So do sets of more than ``MOST_WALKS``
patterns: each pattern walks all texts twice, and Python's one pass is then faster.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.shipping import ship

from .native import running_sums

#: Patterns that are walked by the JVM.
MOST_WALKS = 8


def _found(batches: Iterator[pa.RecordBatch], patterns: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    compiled = [(i, re.compile(p, re.S)) for i, p in patterns]
    for b in batches:
        rows, ids, starts, ends = [], [], [], []
        for r, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
            for i, p in compiled:
                for m in p.finditer(text or ""):
                    if m.end() > m.start():
                        rows.append(r)
                        ids.append(i)
                        starts.append(m.start())
                        ends.append(m.end() - 1)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), *(pa.array(x, pa.int32()) for x in (ids, starts, ends))], [*b.schema.names[:-1], "pattern_id", "start_pos", "end_pos"])


def _walk(text: Column, pattern: str) -> Column:
    """Lengths of all matches."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)


def _may_be_empty(pattern: str) -> bool:
    try:
        return re.search(pattern, "", re.S) is not None
    except re.error:  # not in Python's syntax
        return False


def find_standard(df: DataFrame, patterns: list[str], text_col: str = "text", keys: list[str] | None = None, most_walks: int = MOST_WALKS) -> DataFrame:
    """(keys..., pattern_id, pattern, start_pos, end_pos) of non-empty matches."""
    keys = keys or [c for c in df.columns if c != text_col]
    rows = df.select(*keys, F.col(text_col).alias("__text"))
    walked = [i for i, p in enumerate(patterns) if not _may_be_empty(p)]
    walked = set(walked) if len(walked) <= most_walks else set()
    plain = [(i, p) for i, p in enumerate(patterns) if i in walked]
    in_python = [(i, p) for i, p in enumerate(patterns) if i not in walked]
    parts = []
    if plain:
        text = F.col("__text")
        # columns before they are added up: what is used more than once is computed once
        w = rows.where("__text is not null").select(*keys, *[c for i, p in plain for c in (_walk(text, f"\\G(?s:.)*?(?s:{p})").alias(f"__g{i}"), _walk(text, f"(?s:{p})").alias(f"__n{i}"))])
        place = lambda i: lambda e, n: F.struct(F.lit(i).alias("pattern_id"), (e - n).alias("start_pos"), (e - 1).alias("end_pos"))
        places = [F.zip_with(running_sums(F.col(f"__g{i}")), F.col(f"__n{i}"), place(i)) for i, _ in plain]
        m = w.select(*keys, F.explode(F.flatten(F.array(*places))).alias("__m"))
        parts.append(m.select(*keys, "__m.*").where("end_pos >= start_pos"))
    if in_python:
        ship(df.sparkSession)
        fields = [rows.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("pattern_id", "start_pos", "end_pos")]
        parts.append(rows.mapInArrow(partial(_found, patterns=in_python), T.StructType(fields)))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = F.array(*[F.lit(p) for p in patterns])
    return out.select(*keys, "pattern_id", F.element_at(names, F.col("pattern_id") + 1).alias("pattern"), "start_pos", "end_pos")


def count_standard(df: DataFrame, patterns: list[str], text_col: str = "text") -> DataFrame:
    """(pattern, n) without places, in generated code."""
    sums = df.select(*[F.sum(F.regexp_count(F.col(text_col), F.lit("(?s)" + p))).alias(f"c{i}") for i, p in enumerate(patterns)])
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("n")) for i, p in enumerate(patterns)])
    return sums.select(F.explode(pairs).alias("p")).select("p.pattern", "p.n")
