"""Matching streams.

``match_stream``: every row is a whole text; no state, the same plan as in
batch.  ``match_chunks``: a text arrives in chunks of a key, in order of
``seq``; scans that are open at the end of a chunk are kept as state and go on
in the next one; the last chunk says so, as the end of a text can end a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievewright.operators.dfa_kernel import resume
from sievewright.operators.match import match_all
from sievewright.patterns import PatternSet
from sievewright.patterns.automaton import Table
from sievewright.shipping import ship
from sievewright.sources.scratch import scratch_path

STATE = "next_pos long, next_seq long, tab array<int>, start array<long>, state array<int>, held_seq array<long>, held_text array<string>, held_last array<boolean>"


def match_stream(stream: DataFrame, patterns: PatternSet, text_col: str = "text", keys: list[str] | None = None, **kw) -> DataFrame:
    """``match_all`` on a streaming DataFrame of whole texts."""
    return match_all(stream, patterns, text_col, keys, **kw)


def _feed(tables: list[Table], open_: list[tuple[int, int, int]], text: str, at: int, last: bool):
    """Open scans (table, start, state) over a chunk that begins at ``at``:
    (scans still open, matches (pattern, start, end))."""
    found, left = [], []
    for k, t in enumerate(tables):
        mine = [x[1:] for x in open_ if x[0] == k]
        start, state = (np.array([x[i] for x in mine], np.int64) for i in (0, 1))
        got, rest = resume(t, [text], carry=(np.zeros(len(mine), np.int64), start - at, state), ends=np.array([last]))
        found += list(zip(got[1].tolist(), (got[2] + at).tolist(), (got[3] + at).tolist(), strict=True))
        left += [(k, s + at, x) for s, x in zip(rest[1].tolist(), rest[2].tolist(), strict=True)]
    return left, found


def match_chunks(chunks: DataFrame, patterns: PatternSet, key: str = "doc_id", seq: str = "seq", text: str = "text", last: str = "is_last") -> DataFrame:
    """(key, pattern_id, start_pos, end_pos) of texts in chunks (seq from 0).

    Chunks that come before their turn wait in the state.
    """
    ship(chunks.sparkSession)
    tables = patterns.tables()
    kind = dict(chunks.dtypes)[key]

    def step(k, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        at, want, open_, held = 0, 0, [], {}
        if group.exists:
            s = group.get
            at, want = s[0], s[1]
            open_ = list(zip(*s[2:5], strict=True))
            held = {a: (b, c) for a, b, c in zip(*s[5:8], strict=True)}
        for f in frames:
            for a, b, c in zip(f["seq"], f["text"], f["is_last"], strict=True):
                held[int(a)] = (b or "", bool(c))
        # what follows on one another is scanned at once
        rows, over, bodies = [], False, []
        while not over and want in held:
            body, over = held.pop(want)
            bodies.append(body)
            want += 1
        if bodies:
            body = "".join(bodies)
            open_, rows = _feed(tables, open_, body, at, over)
            at += len(body)
        if over:
            group.remove()
        else:
            cols = [list(x) for x in zip(*open_, strict=True)] if open_ else [[], [], []]
            order = sorted(held)
            group.update((at, want, *cols, order, [held[i][0] for i in order], [held[i][1] for i in order]))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "pattern_id": [r[0] for r in rows], "start_pos": [r[1] for r in rows], "end_pos": [r[2] for r in rows]})

    rows = chunks.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"), F.col(last).alias("is_last"))
    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, pattern_id int, start_pos int, end_pos int", STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)


def chunk_texts(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts to chunks (key, seq, text, is_last)."""
    t = F.col(text)
    n = F.greatest(F.ceil(F.length(t) / F.lit(size)), F.lit(1))
    d = df.select(F.col(key), t.alias("__t"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq"), n.alias("__n"))
    return d.select(key, "seq", F.substring(F.col("__t"), (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("text"), (F.col("seq") == F.col("__n") - 1).alias("is_last"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs all that a stream has now into Parquet files and gives them; ``path``: where, if not in the
    scratch folder.  A stream that goes on from a checkpoint needs the path that it began with."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    w = stream.writeStream.outputMode("append").format("parquet").queryName(name).trigger(availableNow=True)
    w.option("path", path).option("checkpointLocation", checkpoint or scratch_path(spark, name + "-state")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
