"""Comparing two sets of matches, and picking dominating ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievewright.shipping import ship
from sievewright.sources.scratch import written

ORDER = ["start_pos", "pattern", "end_pos"]


def ordered(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By start, then pattern, then end."""
    return matches.orderBy(*(keys or []), *ORDER)


def distinct_matches(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One of each (start, pattern, end), whichever engine found it."""
    return matches.dropDuplicates([*(keys or []), *ORDER])


def intersection(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matches of both sides, once each."""
    cols = [*(keys or []), *ORDER]
    return a.select(*cols).intersect(b.select(*cols))


def _sides(a: DataFrame, b: DataFrame, keys: list[str] | None) -> DataFrame:
    """Each distinct match of both sides once, with lo and hi: 1 for a, 2 for b.  Null keys are equal here."""
    cols = [*(keys or []), *ORDER]
    both = a.select(*cols, F.lit(1).alias("x")).unionByName(b.select(*cols, F.lit(2).alias("x")))
    return both.groupBy(*cols).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def only_in(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matches of ``a`` that ``b`` hasn't, once each."""
    return _sides(a, b, keys).where("hi = 1").select(*(keys or []), *ORDER)


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matches of one side alone, with a column ``side`` (a or b)."""
    return _sides(a, b, keys).where("lo = hi").select(*(keys or []), *ORDER, F.when(F.col("lo") == 1, "a").otherwise("b").alias("side"))


def pair_counts(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row (n_matches, n_mismatches): in both, and on one side alone."""
    g = _sides(a, b, keys)
    return g.agg(F.coalesce(F.sum(F.when(F.col("lo") < F.col("hi"), 1).otherwise(0)), F.lit(0)).cast("long").alias("n_matches"), F.coalesce(F.sum(F.when(F.col("lo") == F.col("hi"), 1).otherwise(0)), F.lit(0)).cast("long").alias("n_mismatches"))


#: Places of a cell of each level, as powers of two; a match lies in the cells of one level alone.
LEVELS = (8, 12, 16, 20, 24, 28)
#: Cells that a match touches at most.
MOST_CELLS = 16


def _level(start: str, end: str) -> Column:
    """The finest level at which the match touches few cells."""
    out = F.lit(LEVELS[-1])
    for n in reversed(LEVELS[:-1]):
        out = F.when(F.shiftright(end, n) - F.shiftright(start, n) <= MOST_CELLS, F.lit(n)).otherwise(out)
    return out


def _starts_inside(points: DataFrame, spans: DataFrame, keys: list[str], p: str, lo: str, hi: str, strict: bool) -> DataFrame:
    """Rows of ``points`` with the rows of ``spans`` of the same keys in which their ``p`` lies (``strict``: not at ``lo``).

    A span stands in the cells of the one level that suits its length, a point in
    one cell of each level in use: neither is unfolded by its length.  They meet in a
    sort merge: Spark judges a side by its packed file, and in memory, unfolded, it is
    too large to be broadcast through the driver.
    """
    spans = spans.withColumn("__level", _level(lo, hi))
    used = sorted(r[0] for r in spans.select("__level").distinct().collect())  # at most as many as there are levels
    cell = F.expr(f"sequence(shiftright({lo}, __level), shiftright({hi}, __level))")
    s = spans.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in spans.columns if c not in keys], F.explode(cell).alias("__cell"))
    at = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(p, n).alias("cell")) for n in used]) if used else F.array().cast("array<struct<level:int,cell:int>>")
    q = points.select("*", F.explode(at).alias("__at"))
    on = [(F.col("__at.level") == F.col("__level")) & (F.col("__at.cell") == F.col("__cell"))]
    on += [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    j = q.join(s.hint("merge"), on).where((F.col(p) > F.col(lo) if strict else F.col(p) >= F.col(lo)) & (F.col(p) <= F.col(hi)))
    return j.drop("__at", "__cell", "__level", *[f"__k{i}" for i in range(len(keys))])


def overlap_classes(a: DataFrame, b: DataFrame, keys: list[str], first: int | None = None) -> DataFrame:
    """Matches of ``a`` alone with the matches of ``b`` they overlap, and how.

    Six predicates: a_contains_b, a_start_in_b, a_end_in_b, b_contains_a,
    b_start_in_a, b_end_in_a.  ``first`` keeps the first mismatches by start,
    pattern and end (a report).  Of two that overlap one starts in the other, so
    starts are looked up among spans, whichever side has the long ones.  Both sides
    are written before they meet, so no text is matched twice.
    """
    b = written(b.select(*keys, *ORDER), "overlap-b")
    miss = only_in(a, b, keys)
    if first is not None:
        miss = miss.orderBy(*keys, *ORDER).limit(first)
    miss = written(miss, "overlap-a")
    x = miss.select(*keys, F.col("pattern").alias("a_pattern"), F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end"))
    y = b.select(*keys, F.col("pattern").alias("b_pattern"), F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    cols = [*keys, "a_pattern", "a_start", "a_end", "b_pattern", "b_start", "b_end"]
    j = _starts_inside(y, x, keys, "b_start", "a_start", "a_end", False).select(*cols).unionByName(_starts_inside(x, y, keys, "a_start", "b_start", "b_end", True).select(*cols))
    inside = lambda p, lo, hi: (F.col(p) >= F.col(lo)) & (F.col(p) <= F.col(hi))
    a_start, a_end, b_start, b_end = inside("a_start", "b_start", "b_end"), inside("a_end", "b_start", "b_end"), inside("b_start", "a_start", "a_end"), inside("b_end", "a_start", "a_end")
    return j.select(*cols, (b_start & b_end).alias("a_contains_b"), a_start.alias("a_start_in_b"), a_end.alias("a_end_in_b"), (a_start & a_end).alias("b_contains_a"), b_start.alias("b_start_in_a"), b_end.alias("b_end_in_a"))


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str], span: int = 1 << 16) -> DataFrame:
    """Each match of ``a`` (keys..., pattern, start_pos, end_pos) with how many of ``b`` it
    overlaps, start or end in it, and hold its start or end: n_overlaps,
    n_b_start_in_a, n_b_end_in_a, n_a_start_in_b, n_a_end_in_b.

    A sweep over the places of a key, with no pairs: how many of ``b`` have started
    and ended before a place are running sums, carried over ranges of ``span``
    places, so a key with many matches is swept in many tasks.
    """
    side = lambda df, p, after, started, ended: df.select(*keys, F.col(p).cast("long").alias("at"), F.lit(after).alias("after"), F.lit(started).alias("started"), F.lit(ended).alias("ended"))
    # at one place: what has started and ended before it is asked first, then what starts there, is asked, ends there
    events = side(b, "start_pos", 1, 1, 0).unionByName(side(b, "end_pos", 3, 0, 1)).groupBy(*keys, "at", "after").agg(F.sum("started").alias("started"), F.sum("ended").alias("ended"))
    asked = a.select(*keys, F.explode(F.array(F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))).alias("at")).distinct()
    zero = [F.lit(0).cast("long").alias(c) for c in ("started", "ended")]
    both = events.unionByName(asked.select(*keys, "at", F.lit(0).alias("after"), *zero)).unionByName(asked.select(*keys, "at", F.lit(2).alias("after"), *zero)).unionByName(asked.select(*keys, "at", F.lit(4).alias("after"), *zero))
    both = both.withColumn("range", F.floor(F.col("at") / span))
    whole = both.groupBy(*keys, "range").agg(F.sum("started").alias("s"), F.sum("ended").alias("e"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("range").alias("__range"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("s", "e")])
    along = Window.partitionBy(*keys, "range").orderBy("at", "after").rowsBetween(Window.unboundedPreceding, 0)
    ran = both.select(*keys, "range", "at", "after", F.sum("started").over(along).alias("started"), F.sum("ended").over(along).alias("ended")).where("after in (0, 2, 4)")
    on = [F.col("range") == F.col("__range"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    ran = ran.join(whole, on).select(*keys, "at", "after", (F.col("started") + F.col("s")).alias("started"), (F.col("ended") + F.col("e")).alias("ended"))
    pick = lambda c, n: F.max(F.when(F.col("after") == n, F.col(c)))
    told = ran.groupBy(*keys, "at").agg(pick("started", 0).alias("s_lt"), pick("started", 2).alias("s_le"), pick("ended", 0).alias("e_lt"), pick("ended", 4).alias("e_le"))
    out = a
    for p, name in (("start_pos", "x"), ("end_pos", "y")):
        t = told.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("at").alias("__at"), *[F.col(c).alias(f"{name}_{c}") for c in ("s_lt", "s_le", "e_lt", "e_le")])
        out = out.join(t, [F.col(p) == F.col("__at"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]).drop("__at", *[f"__k{i}" for i in range(len(keys))])
    c = F.col
    return out.select(
        *keys, "pattern", "start_pos", "end_pos",
        (c("y_s_le") - c("x_e_lt")).alias("n_overlaps"), (c("y_s_le") - c("x_s_lt")).alias("n_b_start_in_a"), (c("y_e_le") - c("x_e_lt")).alias("n_b_end_in_a"),
        (c("x_s_le") - c("x_e_lt")).alias("n_a_start_in_b"), (c("y_s_le") - c("y_e_lt")).alias("n_a_end_in_b"),
    )


def dominates(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """-1 if a holds b, 1 if b holds a, 0 if neither or both the same."""
    a, b = (a_start <= b_start) & (a_end >= b_end), (b_start <= a_start) & (b_end >= a_end)
    return F.when(a & ~b, -1).when(b & ~a, 1).otherwise(0)


def dominating(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and pattern the widest match (ties: the earliest)."""
    kinds, others = dict(matches.dtypes), [c for c in matches.columns if c not in ("start_pos", "end_pos")]
    start, end = F.col("start_pos"), F.col("end_pos")
    if kinds["start_pos"] == kinds["end_pos"] == "int":
        # width and start as one number, so tasks keep one for each key
        best = F.shiftleft((end - start).cast("long"), 32) + F.lit((1 << 31) - 1) - start
        s = F.lit((1 << 31) - 1) - F.col("__b").bitwiseAND(F.lit((1 << 32) - 1))
        got = {"start_pos": s.cast("int"), "end_pos": (s + F.shiftright("__b", 32)).cast("int")}
    else:
        best = F.struct((end - start).alias("w"), (-start).alias("s"))
        got = {"start_pos": -F.col("__b.s"), "end_pos": F.col("__b.w") - F.col("__b.s")}
    w = Window.partitionBy(*keys, "pattern").orderBy(F.col("__b").desc())
    m = matches.groupBy(*others).agg(F.max(best).alias("__b")).withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return m.select(*[got[c].alias(c) if c in got else F.col(c) for c in matches.columns])


def packed_undominated(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Matches to (by..., starts, ends): those that no wider match of the batch holds, a row for all of one ``by``."""
    for b in batches:
        if not b.num_rows:
            continue
        group = np.zeros(b.num_rows, np.int64)
        for c in by:
            d = b.column(c).dictionary_encode("encode")
            group = np.unique(group * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
        start, end = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start_pos", "end_pos"))
        order = np.lexsort((-end, start, group))
        start, end, group = start[order], end[order], group[order]
        at = end + group * (int(end.max()) + 1)  # never less than those of the groups before
        keep = np.append(True, at[1:] > np.maximum.accumulate(at)[:-1])
        keep[1:] |= group[1:] != group[:-1]
        start, end, group, order = start[keep], end[keep], group[keep], order[keep]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        offsets = pa.array(np.append(first, len(group)).astype(np.int32))
        take = pa.array(order[first])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (start, end)]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in by), *lists], [*by, "starts", "ends"])


def undominated(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that no wider match of the same pattern holds.

    In order of start (wider first), a match is held if one before it ends as
    late, so one running maximum decides; no pairs are made.  Tasks leave out what
    their own batches hold and send the rest on packed; what stands in one packed
    row is settled, only what several rows have of a key is put in order again.
    """
    ship(matches.sparkSession)
    fields = {f.name: f for f in matches.schema.fields}
    by = [c for c in matches.columns if c not in ("start_pos", "end_pos")]
    w = Window.partitionBy(*keys, "pattern").orderBy("start_pos", F.col("end_pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    settled = lambda df: df.withColumn("__m", F.max("end_pos").over(w)).where("__m is null or __m < end_pos").drop("__m")
    if any(isinstance(fields[c].dataType, (T.ArrayType, T.MapType, T.StructType)) for c in by):
        return settled(matches)
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]
    packed = matches.mapInArrow(partial(packed_undominated, by=by), T.StructType([*(fields[c] for c in by), *lists])).repartition(*keys, "pattern")
    packed = packed.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "pattern")))
    rows = lambda df: df.select(*by, F.explode(F.arrays_zip("starts", "ends")).alias("__x")).select(*[F.col({"start_pos": "__x.starts", "end_pos": "__x.ends"}[c]).cast(fields[c].dataType).alias(c) if c not in by else F.col(c) for c in matches.columns])
    return rows(packed.where("__n = 1")).unionByName(settled(rows(packed.where("__n > 1"))))


def pair_summary(a: DataFrame, b: DataFrame, keys: list[str], n_patterns: int, corpus_length: int, run_a: dict, run_b: dict, series: str, metadata: str, timestamp: int) -> DataFrame:
    """One row about two runs; run: engine, mem_mb, duration_ms."""
    c = pair_counts(a, b, keys)
    lit = lambda v, t: F.lit(v).cast(t)
    ratio = (lit(run_a["duration_ms"], "double") / F.nullif(lit(run_b["duration_ms"], "double"), F.lit(0.0))).cast("float")
    return c.select(
        lit(timestamp, "long").alias("timestamp"),
        lit(series, "string").alias("testSeriesId"),
        lit(metadata, "string").alias("metadata"),
        lit(run_a["engine"], "string").alias("matcherTypeName1"),
        lit(run_a["mem_mb"], "long").alias("usedMemoryInMb1"),
        lit(run_a["duration_ms"], "long").alias("durationInMillis1"),
        lit(run_b["engine"], "string").alias("matcherTypeName2"),
        lit(run_b["mem_mb"], "long").alias("usedMemoryInMb2"),
        lit(run_b["duration_ms"], "long").alias("durationInMillis2"),
        F.col("n_matches").cast("int").alias("noOfMatches"),
        F.col("n_mismatches").cast("int").alias("noOfMismatches"),
        lit(n_patterns, "int").alias("noOfRegexps"),
        lit(corpus_length, "int").alias("corpusLength"),
        ratio.alias("2to1Ratio"),
    )
