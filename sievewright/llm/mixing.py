"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key of its id.  The key space is cut into
equal ranges (the keys are uniform, so no splitters need sampling), which
range-sorts each source over many tasks.  Sums per (source, range) and prefix
sums of those tell in which range a source meets its budget; only the rows of
that range are sorted, and their prefix sums give the row at the cut.  A
budget above the source's size repeats whole epochs first.

So the mix of a source is one number of epochs and one cut: rows in order
before it are taken once more than those after it, and the row at the cut
gives the words that are left.  Every row decides that where it is, against
the table of cuts (one row a source); no document moves.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and
share ``share`` of all words; a target stops at ``max_epochs`` times its
source's size and the excess is shared again by weight until none is above.

Defined cases: null text has size 0; null source is a source, last in order;
repeated rows (equal in id, source and text) each count, and where the cut
falls among them the words left go to one after the other; empty table, empty
result; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, partitions, quoted, stash, text_or_empty

#: Ranges of a source's key space.  A source of 10 billion rows has 2.4
#: million rows a range, and only one of its ranges is sorted.
RANGES = 4096
#: Sources up to this number have their cuts broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000
#: Columns that the mix adds to documents.
MIXED = ("mix_size", "mix_target", "mix_taken")


def _weighed(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds w, the weight by a source's rank among all: sources are sorted in
    ranges, and a range knows from the counts of those before it where it begins."""
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    s = stash(sizes.repartitionByRange(partitions(spark), order).withColumn("p", F.spark_partition_id()), "mix-sources")
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    begin = s.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))  # a row a range
    rank = F.col("begin") + F.row_number().over(Window.partitionBy("p").orderBy(order)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    return s.join(F.broadcast(begin), "p").withColumn("w", w).drop("p", "begin")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The level is that of water filling: sources whose cap is below it are full,
    the others share what is left by weight, which may raise the level; every
    round is one sum over the sources, and a few rounds are enough.
    """
    s = _weighed(sizes, weights).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = stash(s.withColumn("ratio", F.col("cap") / F.col("w")), "mix-weights")
    total, free = s.agg(F.sum("source_size"), F.sum("w")).first()
    level, full = (total * share / free if free else None), 0
    while level is not None:
        over = F.col("ratio") < F.lit(level)
        n, capped, free = s.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == full:
            break
        level, full = ((total * share - capped) / free if free else None), n
    return s.select("source", "source_size", (F.least("cap", F.lit(level) * F.col("w")) if level is not None else F.col("cap")).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, ranges: int, *more: Column) -> DataFrame:
    """(source, id, key, range, text) and columns ``more`` of a row."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), quoted(id_col).cast("string"))), 1, 15), 16, 10).cast("long")  # 60 bits
    place = F.shiftright(F.shiftright(key, 40) * F.lit(ranges), 20).cast("int")
    return docs.select(*more, quoted(source_col).alias("source"), quoted(id_col).alias("id"), key.alias("key"), place.alias("range"), text_or_empty(text_col).alias("text"))


def _sized(rows: DataFrame) -> DataFrame:
    """Adds size and place (what orders the rows of a source), if the text is there to be counted.

    Made by a generator, as the optimizer would count words anew for each use of a plain column.
    """
    if "text" in rows.columns:
        counted = F.array(F.struct(n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th")))
        rows = rows.select(*[c for c in rows.columns if c != "text"], F.inline_outer(counted))
    return rows.withColumn("place", F.struct("key", "id", "size", "th"))


def source_cuts(rows: DataFrame, weights: Sequence[float], max_epochs: float, share: float) -> DataFrame:
    """Keyed rows to one row a source: c_source, source_size, target, epochs,
    cut (the place of the last rows that are taken from in the broken epoch,
    null if there is none), left (the words that those rows give, together)."""
    parts = stash(_sized(rows).groupBy("source", "range").agg(F.sum("size").alias("part")), "mix-ranges")
    t = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, max_epochs, share)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", epochs).withColumn("over", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    t = stash(t.withColumnRenamed("source", "c_source"), "mix-targets")
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    p = parts.withColumn("ahead", F.coalesce(F.sum("part").over(along), F.lit(0)))
    at = p.join(t.where("over > 0"), F.col("source").eqNullSafe(F.col("c_source"))).where("ahead < over and over <= ahead + part")
    at = stash(at.select(F.col("c_source").alias("a_source"), F.col("range").alias("a_range"), (F.col("over") - F.col("ahead")).alias("rest")), "mix-at")
    # the words of a row are counted once more only for the ranges that hold a cut
    near = _sized(rows.join(_small(at), F.col("source").eqNullSafe(F.col("a_source")) & (F.col("range") == F.col("a_range"))))
    near = near.groupBy("a_source", "rest", "place").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("a_source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.sum("words").over(inside)).where("upto - words < rest and rest <= upto")
    cut = near.select("a_source", F.col("place").alias("cut"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    return stash(t.join(cut, F.col("c_source").eqNullSafe(F.col("a_source")), "left").drop("a_source", "over"), "mix-cuts")


def _small(per_source: DataFrame) -> DataFrame:
    """A written table with one row a source at most, broadcast if they are few."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds size, place, source_size, target and taken to keyed rows."""
    once, again = F.col("size") * F.col("epochs"), F.col("size") * (F.col("epochs") + 1)
    both = _sized(rows.join(_small(cuts), F.col("source").eqNullSafe(F.col("c_source"))))
    apart = both.where("cut is null or place <> cut").withColumn("taken", F.when(F.col("place") < F.col("cut"), again).otherwise(once))
    # the rows at the cut, equal in place, share what is left in any order
    at = _sized(rows.join(_small(cuts), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("key") == F.col("cut.key")))).where("place = cut")
    nth = F.row_number().over(Window.partitionBy("source", "place").orderBy(F.lit(0))) - 1
    at = at.withColumn("taken", once + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - nth * F.col("size"))))
    return apart.unionByName(at).withColumn("taken", F.col("taken").cast("long"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: int = 3,
    share: float = 1.0,
    seed: int = 20240229,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken."""
    narrow = stash(_sized(_keyed(docs, id_col, text_col, source_col, seed, ranges)).drop("place"), "mix")
    got = _taken(narrow, source_cuts(narrow, weights, max_epochs, share))
    return got.select(F.col("place.id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: int = 3,
    share: float = 1.0,
    seed: int = 20240229,
    ranges: int = RANGES,
) -> DataFrame:
    """``docs`` without the rows of which the mix takes nothing, with columns
    ``mix_size``, ``mix_target`` and ``mix_taken`` added (words).

    Columns of those names in ``docs``, as of a mix before, are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in MIXED]
    keyed = _keyed(docs, id_col, text_col, source_col, seed, ranges, F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"))
    got = _taken(keyed, source_cuts(keyed.drop("row"), weights, max_epochs, share)).where("taken > 0")
    return got.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], F.col("size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("taken").alias("mix_taken"))
