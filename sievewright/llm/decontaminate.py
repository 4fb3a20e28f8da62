"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only.

A mask such as 11010011 laid on a text at some token hashes the tokens under
its ones and ignores those under its zeros.  Test and training texts are
hashed under the same fixed masks at every position and joined on the hashes.
Every hit gives an alignment of a test item with a document; it counts as an
overlap if some ``window`` aligned tokens agree in at least ``min_equal``.

The three masks are chosen so that whichever three tokens of a window of 13
are substituted, one mask still fits on tokens that are not: the hits miss no
overlap of the rule above (tests/llm checks all 286 choices).

An item shorter than the window is its own window and overlaps where all its
tokens stand in a row; its seed is one mask of ones over the whole item.

Most places of a corpus fit no seed at all.  So every place first asks for its
masks' keys in the set of distinct seeds, in one row a place; what has one is
written, a few numbers a place, and all that follows reads that.

A text that repeats itself would meet an item of its words at every place of
both.  Two things bound that.  A whole window that both have is told by one more
mask, all ones: such a pair of document and item has its answer, ``window`` equal
tokens, and its other hits are dropped before any is unfolded.  What is left is
one row an alignment, of which a document and an item have as many as tokens
together, before a token is compared; only documents with such rows are read
again.

The seeds of a benchmark of up to ``BROADCAST_SEEDS`` hashes (counted) are
broadcast, and a document is hashed and probed where it is.  Above, hashes are
shuffled to meet the seeds.

Tokens are runs without space and U+0009..U+000D, in lower case.

Defined cases: null or wordless texts and items overlap with nothing; null
item ids count as an item; repeated rows are flagged alike; an empty benchmark
flags nothing; columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, SPACE, SPACE_CHARS, quoted, stash, text_or_empty, without

#: Fixed masks.  Every choice of at most 3 places of 13 leaves one of them whole.
MASKS = ("11010011", "110001011", "1001111")
#: Number of the mask of a whole window; short items have 100 and their size.
EXACT = 99
WINDOW = 13
MIN_EQUAL = 10
#: About 60 bytes each in a hash table; 60 MB at most.
BROADCAST_SEEDS = 1_000_000


def token_hashes(text: Column) -> Column:
    """Array with a 64-bit hash of each token."""
    t = F.btrim(F.lower(text), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(t, SPACE + "+", -1), lambda x: F.xxhash64(x)))


def numbered(masks: tuple[str, ...], short: list[int]) -> dict[int, str]:
    """The masks by number: those for windows, then (from 100 on) one for items of each short size."""
    return dict(enumerate(masks)) | {100 + n: "1" * n for n in short}


def _keys(h: str, pos: Column, masks: dict[int, str]) -> list[Column]:
    """The key of each mask at a position of the tokens ``h``, null where it doesn't fit."""
    out = []
    for n, m in masks.items():
        at = [F.get(F.col(h), pos + i) for i, c in enumerate(m) if c == "1"]
        out.append(F.when(pos + len(m) <= F.size(h), F.xxhash64(F.lit(n), *at)).alias(f"k{n}"))
    return out


def placed(df: DataFrame, h: str, keep: list[str], masks: dict[int, str]) -> DataFrame:
    """Rows (keep..., pos, k<mask>...): the key of each mask at each position, null where it doesn't fit.

    ``h`` must be in ``keep``: tokens are taken from it by place, in generated
    code, and no row is made for more than a position.
    """
    rows = df.select(*keep, F.posexplode_outer(h).alias("pos", "c0"))
    return rows.select(*keep, "pos", *_keys(h, F.col("pos"), masks))


def unfolded(rows: DataFrame, keep: list[str], masks: dict[int, str]) -> DataFrame:
    """Rows of ``placed`` to (keep..., key), a row for each mask that fits."""
    return rows.select(*keep, F.explode_outer(F.array(*[F.col(f"k{n}") for n in masks])).alias("key")).where("key is not null")


def _gated(rows: DataFrame, distinct: DataFrame, masks: dict[int, str]) -> DataFrame:
    """Places some of whose keys are seeds."""
    cols, hit = rows.columns, F.lit(False)
    for n in masks:
        rows = rows.join(F.broadcast(distinct.select(F.col("key").alias(f"s{n}"))), F.col(f"k{n}") == F.col(f"s{n}"), "left")
        hit = hit | F.col(f"s{n}").isNotNull()
    return rows.where(hit).select(*cols)


def _verified(alignments: DataFrame, window: int, min_equal: int) -> DataFrame:
    """Alignments (tokens of both, doc_from, item_from, n_aligned) to pairs (__id, __th,
    item_id, best, place): the most equal tokens in a window, and where it begins."""
    part = lambda h, at: F.slice(h, F.col(at) + 1, F.col("n_aligned"))
    a = alignments.withColumn("same", F.zip_with(part("h", "doc_from"), part("ih", "item_from"), lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(0))))
    add = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    a = a.withColumn("sums", F.transform(F.sequence(F.lit(0), F.col("n_aligned") - window), lambda i: add(F.slice("same", i + 1, F.lit(window)))))
    a = a.withColumn("best", F.array_max("sums")).where(F.col("best") >= min_equal)
    a = a.withColumn("place", F.col("doc_from") + F.array_position("sums", F.col("best")).cast("int") - 1)
    return a.select("__id", "__th", "item_id", "best", "place")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_equal: int = MIN_EQUAL, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Overlaps, one row per document and benchmark item: __id, __th (id and text
    hash of the document), item_id, best (most equal tokens in a window), place
    (the document's token, from 0, at which such a window begins)."""
    items = benchmark.select(quoted(item_col).alias("item_id"), token_hashes(text_or_empty(item_text_col)).alias("ih")).where(F.size("ih") > 0)
    items = stash(items.distinct().select("item_id", F.xxhash64("ih").alias("__ith"), "ih"), "benchmark")
    short = sorted(r["n"] for r in items.select(F.size("ih").alias("n")).where(F.col("n") < window).distinct().collect())  # at most the window's size of rows
    kinds, exact = numbered(masks, short), {EXACT: "1" * window}
    seed = ["item_id", "__ith", F.size("ih").alias("isize"), F.col("pos").alias("ipos")]
    long_ = items.where(F.size("ih") >= window)
    begin = unfolded(placed(long_, "ih", items.columns, numbered(masks, [])), seed, numbered(masks, []))
    for n in short:
        begin = begin.unionByName(unfolded(placed(items.where(F.size("ih") == n), "ih", items.columns, {100 + n: "1" * n}), seed, {100 + n: "1" * n}))
    seeds = stash(begin, "seeds")
    windows = stash(unfolded(placed(long_, "ih", items.columns, exact), ["item_id", "__ith"], exact).distinct(), "windows")
    small = seeds.count() <= broadcast_seeds
    near_by = F.broadcast if small else (lambda x: x)
    text = text_or_empty(text_col)
    rows = docs.select(quoted(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
    tokens = rows.select("__id", "__th", token_hashes(F.col("__text")).alias("h"))
    keys = stash(seeds.select("key").distinct(), "seed-keys")
    doc = ["__id", "__th"]
    place = [*doc, F.size("h").alias("size"), "pos"]
    p = placed(tokens, "h", [*doc, "h"], kinds)
    if small:
        p = _gated(p, keys, kinds).select(*place, *[f"k{n}" for n in kinds], *_keys("h", F.col("pos"), exact))
        near = unfolded(stash(p, "near"), [*doc, "size", "pos", f"k{EXACT}"], kinds)
    else:
        p = p.select(*place, *[f"k{n}" for n in kinds], *_keys("h", F.col("pos"), exact))
        near = stash(unfolded(p, [*doc, "size", "pos", f"k{EXACT}"], kinds).join(keys, "key", "left_semi"), "near")
    # whole windows, and whole items shorter than one
    found = near.select(*doc, "pos", F.col(f"k{EXACT}").alias("key")).groupBy(*doc, "key").agg(F.min("pos").alias("place")).join(near_by(windows), "key").withColumn("best", F.lit(window))
    if short:
        whole = seeds.where(F.col("isize") < window).select("key", "item_id", "__ith", F.col("isize").alias("best"))
        found = found.unionByName(near.groupBy(*doc, "key").agg(F.min("pos").alias("place")).join(near_by(whole), "key"))
    found = stash(found.groupBy(*doc, "item_id", "__ith").agg(F.min("place").alias("place"), F.max("best").alias("best")), "whole-windows")
    # what has no answer yet: one row an alignment
    open_ = near.join(near_by(seeds.where(F.col("isize") >= window).select("key", "item_id", "__ith").distinct()), "key")
    same = lambda names: [F.col(c).eqNullSafe(F.col(f"f{c}")) for c in names]
    done = found.select(*[F.col(c).alias(f"f{c}") for c in (*doc, "item_id", "__ith")])
    open_ = open_.join(done, same([*doc, "item_id", "__ith"]), "left_anti")
    hits = open_.join(near_by(seeds.select(F.col("key").alias("skey"), F.col("item_id").alias("sitem"), F.col("__ith").alias("sith"), "isize", "ipos")), [F.col("key") == F.col("skey"), F.col("item_id").eqNullSafe(F.col("sitem")), F.col("__ith") == F.col("sith")])
    a = hits.groupBy(*doc, "size", "item_id", "__ith", "isize", (F.col("pos") - F.col("ipos")).alias("diagonal")).count()
    a = a.select(*doc, "item_id", "__ith", F.greatest(F.col("diagonal"), F.lit(0)).alias("doc_from"), F.greatest(-F.col("diagonal"), F.lit(0)).alias("item_from"), "size", "isize")
    a = stash(a.withColumn("n_aligned", F.least(F.col("size") - F.col("doc_from"), F.col("isize") - F.col("item_from"))).where(F.col("n_aligned") >= window).drop("size", "isize"), "alignments")
    asked = a.select(*[F.col(c).alias(f"f{c}") for c in doc]).distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    again = rows.join(asked, same(doc), "left_semi").select("__id", "__th", token_hashes(F.col("__text")).alias("h"))
    i = items.select(F.col("item_id").alias("f_item"), F.col("__ith").alias("f_ith"), "ih")
    i = F.broadcast(i) if small else i
    # a merge join from the alignments' side gives out one row at a time: a long text stands beside thousands of them
    a = a.join(again.select(*[F.col(c).alias(f"f{c}") for c in doc], "h").hint("merge"), same(doc)).join(i, [F.col("item_id").eqNullSafe(F.col("f_item")), F.col("__ith") == F.col("f_ith")])
    pairs = _verified(a, window, min_equal).unionByName(found.select(*doc, "item_id", "best", "place"))
    return pairs.groupBy(*doc, "item_id").agg(F.max("best").alias("best"), F.min_by("place", F.struct(-F.col("best"), "place")).alias("place"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, items (ids
    in order), best (most equal tokens in a window; 0 if clean), th."""
    found = benchmark_overlaps(docs, benchmark, id_col, text_col, **kw)
    by_doc = found.groupBy(F.col("__id").alias("f_id"), F.col("__th").alias("f_th")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("best").alias("best"))
    rows = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"))
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    return out.select("doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), "items", F.coalesce("best", F.lit(0)).cast("long").alias("best"), "th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without an overlap, with all their columns."""
    bad = benchmark_overlaps(docs, benchmark, id_col, text_col, **kw).select("__id", "__th")
    return without(docs, bad, id_col, text_col)
