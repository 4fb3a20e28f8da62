"""Fixed texts found from their rarest gram.

A sketch counts the corpus' grams of three characters: ``DEPTH`` hashes of a gram
name a cell each, and the least of its cells is no less than its count.  Sketches
of parts of a corpus add up cell by cell, so one can be kept and merged as the
corpus grows; its size is fixed.

Each literal's anchor is its gram with the least estimate (the first of equals).
Windows of the corpus are split at the anchors, whose places meet the literals by
the anchor alone, and the rest of the literal is compared around the place.  A
literal that begins with a common gram then costs what its rarest gram does.

Grams are counted in the tasks, batch by batch, so a task sends each of its
distinct grams on and no row a place is made.

Defined cases: null and short texts have no gram; a literal of fewer than three
characters has no anchor and takes the join by beginnings; repeated rows give
their matches each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.shipping import ship

from .dfa_kernel import code_points, split_batches
from .literal_join import head_places, literal_matches, per_pattern, windows

GRAM = 3
#: Cells of a hash, and hashes.
WIDTH, DEPTH = 1 << 20, 3
#: Places of a piece of text.
CHUNK = 512
#: Distinct grams that a task holds, about.
MOST_HELD = 1 << 20
_WALK = "(?s)(?=(.{3}))."


def _cells(gram: str, width: int):
    """Array of (hash, cell) of a gram."""
    return F.array(*[F.struct(F.lit(d).alias("d"), F.pmod(F.xxhash64(F.lit(d), F.col(gram)), F.lit(width)).cast("int").alias("cell")) for d in range(DEPTH)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, how many there are of each): a gram is its three code points, 21 bits each."""
    codes, begin = code_points(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(begin))
    at = np.flatnonzero(of[:-2] == of[2:]) if len(codes) >= GRAM else np.zeros(0, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    chars = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[chars] = np.arange(len(chars))
    k, x = len(chars), number[codes]
    key = (x[at] * k + x[at + 1]) * k + x[at + 2]
    if k**3 <= 8 * len(key):
        n = np.bincount(key)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    c = chars.astype(np.int64)
    return (c[key // (k * k)] << 42) | (c[key // k % k] << 21) | c[key % k], n


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(gram), np.int64)
    np.add.at(n, which, np.concatenate([x for _, x in parts]))
    return gram, n


def counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (g, n): the distinct grams of a task, again if it has very many."""
    parts, held = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        gram, n = parts[0]
        for i in range(0, len(gram), 100_000):
            g = gram[i : i + 100_000]
            body = np.stack([g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array([body[j : j + GRAM] for j in range(0, len(body), GRAM)], pa.string()), pa.array(n[i : i + 100_000])], ["g", "n"])

    for b in batches:
        for _, part in split_batches(b.column(0).to_pylist()):
            parts.append(_grams(part))
            held += len(parts[-1][0])
            if held > MOST_HELD:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > MOST_HELD // 2:
                    yield from rows()
                    parts, held = [], 0
    if parts:
        parts = [_summed(parts)]
        yield from rows()


def gram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(g, n): places of each gram of a text column."""
    ship(df.sparkSession)
    return df.select(F.col(text_col)).mapInArrow(counted_grams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def gram_sketch(df: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(d, cell, n): the sketch of a text column."""
    g = gram_counts(df, text_col)
    return g.select(F.explode(_cells("g", width)).alias("c"), "n").groupBy("c.d", "c.cell").agg(F.sum("n").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all their texts."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("d", "cell").agg(F.sum("n").alias("n"))


def anchors(literals: DataFrame, sketch: DataFrame, width: int = WIDTH) -> DataFrame:
    """(pattern_id, literal, offset, gram, estimate) of literals (pattern_id, literal) of three characters and more."""
    g = literals.where(F.length("literal") >= GRAM).select("pattern_id", "literal", F.posexplode(F.regexp_extract_all("literal", F.lit(_WALK), F.lit(1))).alias("offset", "gram"))
    asked = g.select("gram").distinct().select("gram", F.explode(_cells("gram", width)).alias("c")).select("gram", "c.d", "c.cell")
    known = asked.join(sketch, ["d", "cell"], "left").groupBy("gram").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
    best = g.join(known, "gram").groupBy("pattern_id", "literal").agg(F.min(F.struct("estimate", "offset", "gram")).alias("a"))
    return best.select("pattern_id", "literal", "a.offset", "a.gram", "a.estimate")


def anchored_matches(df: DataFrame, literals: list[tuple[int, str]], sketch: DataFrame | None = None, text_col: str = "text", keys: list[str] | None = None, chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """(keys..., pattern_id, start_pos, end_pos): every occurrence of (pattern id, literal).

    ``sketch``: of the corpus or a part of it (``gram_sketch``); it is made from ``df`` if not given.
    """
    spark = df.sparkSession
    keys = keys or [c for c in df.columns if c != text_col]
    literals = list(dict.fromkeys(literals))
    short = literal_matches(df, [x for x in literals if len(x[1]) < GRAM], text_col, keys)
    long_ = [x for x in literals if len(x[1]) >= GRAM]
    if not long_:
        return short
    rows = spark.createDataFrame(long_, "pattern_id int, literal string")
    # a row a literal, of which the driver has the list
    known = anchors(rows, gram_sketch(df, text_col, width) if sketch is None else sketch, width).select("pattern_id", "literal", "offset", "gram").collect()
    a = per_pattern(spark.createDataFrame(known, "pattern_id int, literal string, offset int, gram string"), len(long_))
    w = windows(df.where(F.length(text_col) >= GRAM), text_col, keys, max(len(x) for _, x in long_), chunk)
    hit = head_places(w, keys, sorted({r["gram"] for r in known})).withColumn("gram", F.substring(F.col("window"), F.col("o") + 1, F.lit(GRAM))).join(a, "gram").withColumn("__s", F.col("o") - F.col("offset"))
    # a literal that begins from ``chunk`` on is found in the next window
    hit = hit.where(F.col("__s").between(0, chunk - 1) & (F.substring(F.col("window"), F.col("__s") + 1, F.length("literal")) == F.col("literal"))).withColumn("start_pos", F.col("at") + F.col("__s"))
    return hit.select(*keys, "pattern_id", "start_pos", (F.col("start_pos") + F.length("literal") - 1).alias("end_pos")).unionByName(short)


def anchor_hits(df: DataFrame, literals: list[tuple[int, str]], sketch: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(pattern_id, literal, first_hits, anchor_hits): places that a literal's first gram and its anchor meet."""
    spark = df.sparkSession
    a = anchors(spark.createDataFrame(literals, "pattern_id int, literal string"), sketch, width)
    a = a.withColumn("first", F.substring("literal", 1, GRAM))
    # the texts are counted once for both
    asked = a.select("pattern_id", "literal", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("first").alias("g")), F.struct(F.lit(1).alias("k"), F.col("gram").alias("g")))).alias("x")).select("pattern_id", "literal", "x.k", "x.g")
    n = asked.join(gram_counts(df, text_col), "g", "left").groupBy("pattern_id", "literal")
    hits = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).cast("long")
    return n.agg(hits(0).alias("first_hits"), hits(1).alias("anchor_hits"))
