"""Phrase collocations by pivot partitioning.

A phrase is a run of words inside a piece of text; pieces end at punctuation and
line breaks.  Every phrase is counted where its rarest word is:

1. Blocks of texts of one language keep their distinct words once and the texts
   as numbers of those, written once.  Adding up the blocks gives the frequent
   words of each language, ranked by falling count; blocks ask for the ranks of
   their distinct words, dealt out by a hash with the frequent words.
2. A text is rewritten once for each place of a frequent word, its pivot: the run
   of words around it that are commoner than the pivot (to its right also the
   pivot itself), no longer than a phrase can reach.  Rarer words end the run.  So
   a phrase is in the fragment of one place only, the first of its rarest word.
   Equal fragments of a block become one with a count.
3. Fragments go to their pivot's partition, packed by ranges of a hash, where phrases grow from the pivot to
   the left and then to the right, and what is too rare is not grown on.  A pivot
   with more than half of a partition's share of all words is split by a hash of
   the fragments; its counts are added up afterwards.
4. All parts of a frequent phrase are frequent, so scores and the test for longer
   phrases are joins of the frequent phrases with themselves.

Counts are whole numbers and scores exact decimals of 38 digits.

Defined cases: a null text is empty, a null language is ``und`` (with texts whose
language is that); empty texts and pieces give nothing; repeated rows count as
often as they are there; ties of score and count go by the phrase's bytes; an
empty table and one without frequent phrases give no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.shipping import ship

from .common import ARROW_BYTES, arrow_bytes, partitions, quoted, stash, text_or_empty
from .packing import coded, squeeze, squeeze_words, unsqueeze, unsqueeze_words
from .tokens import _LOW, blocks, mix

#: Bytes of text whose distinct words are kept together, and that are split at once.
BLOCK, PIECE = 4 << 20, 1 << 20
#: Words of blocks, and words of the texts, for one range of a hash: what a task holds at once.
RANGE_ROWS = 500_000
#: Groups of a language that each pick their best before the best of all are picked.
TOP_GROUPS = 64
#: What a byte is: of a word, between words, between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2


def split_pieces(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts (bytes, and where each begins), A-Z in lower case; and whether a word is the first of a piece."""
    kind = _KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = off[:-1][off[:-1] < off[1:]]  # of texts that are not empty
    first[opens] = inside[opens]
    starts = np.flatnonzero(first)
    data = _LOW[raw[inside]]
    ends = np.append(np.cumsum(inside)[starts] - 1, len(data)) if len(starts) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    piece = np.cumsum(kind == 2)[starts] + np.searchsorted(off, starts, side="right")
    return words, np.append(True, piece[1:] != piece[:-1])[: len(starts)]


def _phrase_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to blocks (block, lang, n, codes, words, counts); in codes 0 begins a piece, and words count from 1."""
    base, k = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
    held: dict[str, list] = {}  # lang: bytes, words, firsts

    def row(lang: str) -> pa.RecordBatch:
        _, words, firsts = held.pop(lang)
        number, distinct, counts = coded(pa.chunked_array(words, pa.string()).combine_chunks())
        opens = np.concatenate(firsts)
        codes = np.zeros(len(number) + int(opens.sum()), np.int64)
        codes[np.arange(len(number)) + np.cumsum(opens)] = number + 1
        one = pa.array([0, len(distinct)], pa.int32())
        cols = [pa.array([base + k], pa.int64()), pa.array([lang]), pa.array([len(number)], pa.int64()), pa.array([squeeze(codes)], pa.binary()), pa.ListArray.from_arrays(one, distinct), pa.ListArray.from_arrays(one, pa.array(counts.astype(np.int64)))]
        return pa.RecordBatch.from_arrays(cols, ["block", "lang", "n", "codes", "words", "counts"])

    for b in batches:
        langs = b.column(0).dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = b.column(1).filter(pa.compute.equal(langs.indices, i))
            for _, _, raw, off in blocks(own, PIECE):
                words, firsts = split_pieces(raw, off)
                if not len(words):
                    continue
                h = held.setdefault(lang, [0, [], []])
                h[0] += len(raw)
                h[1].append(words)
                h[2].append(firsts)
                if h[0] >= block:
                    yield row(lang)
                    k += 1
    for lang in list(held):
        yield row(lang)
        k += 1


def _dealt(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """A block's (block, lang, words) to a row for each range of a hash: (range, block, lang, nos, words)."""
    for b in batches:
        for block, lang, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = words.values.cast(pa.binary()).to_pylist()
            part = np.fromiter((crc32(w) % ranges for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            for nos in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                yield pa.RecordBatch.from_arrays([pa.array([part[nos[0]]], pa.int32()), pa.array([block], pa.int64()), pa.array([lang]), pa.array([squeeze(np.diff(nos, prepend=0))], pa.binary()), pa.array([squeeze_words([words[i] for i in nos.tolist()])], pa.binary())], ["range", "block", "lang", "nos", "words"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, block, lang, nos, words, rank), a range's frequent words (with a rank) before
    its blocks' words, to (block, nos, ranks) of those that are frequent."""
    known, at = {}, None
    for b in batches:
        for r, block, lang, nos, words, rank in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r != at:
                known, at = {}, r
            if rank is not None:
                known[lang, words] = rank
                continue
            ranks = np.fromiter((known.get((lang, w), 0) for w in unsqueeze_words(words)), np.int64)
            on = np.flatnonzero(ranks)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([squeeze(np.diff(np.cumsum(unsqueeze(nos))[on], prepend=0))], pa.binary()), pa.array([squeeze(ranks[on])], pa.binary())], ["block", "nos", "ranks"])


def _fragments(batches: Iterator[pa.RecordBatch], reach: int, hot: dict[int, int], ranges: int) -> Iterator[pa.RecordBatch]:
    """(codes, known: numbers and ranks) to a row for each range of the keys' hash:
    (range, keys, counts, sizes, words).  A key is a pivot's rank and its part; sizes are 16 times
    the words to the left and those to the right, words their ranks, the nearest first."""
    parts = np.ones(max(hot, default=0) + 1, np.uint64)
    for rank, n in hot.items():
        parts[rank] = n
    for b in batches:
        for i in range(b.num_rows):
            codes = unsqueeze(b.column(0)[i].as_buffer())
            rank_of = np.zeros(int(codes.max()) + 1, np.int64)
            for p in b.column(1)[i].as_py():
                rank_of[np.cumsum(unsqueeze(p["nos"])) + 1] = unsqueeze(p["ranks"])
            yield from _block_fragments(rank_of[codes], reach, parts, ranges)


def _block_fragments(r: np.ndarray, reach: int, parts: np.ndarray, ranges: int = 1) -> Iterator[pa.RecordBatch]:
    n, r = len(r), r.astype(np.int32)
    pad = np.concatenate([np.zeros(reach, np.int32), r, np.zeros(reach, np.int32)])
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    on_left, on_right = r > 0, r > 0
    for j in range(1, reach + 1):
        x, y = pad[reach - j : reach - j + n], pad[reach + j : reach + j + n]
        on_left, on_right = on_left & (x > 0) & (x < r), on_right & (y > 0) & (y <= r)
        left += on_left
        right += on_right
    at = np.flatnonzero((left + right) > 0)
    if not len(at):
        return
    rows = np.zeros((len(at), 1 + 2 * reach), np.int32)
    rows[:, 0] = r[at]
    for j in range(1, reach + 1):
        rows[:, j] = np.where(left[at] >= j, pad[at + reach - j], 0)
        rows[:, reach + j] = np.where(right[at] >= j, pad[at + reach + j], 0)
    h = np.zeros(len(at), np.uint64)
    for j in range(rows.shape[1]):
        h = mix(h + rows[:, j].astype(np.uint64), j + 1)
    order = np.argsort(h)  # equal ones meet; should others share a hash, they only stay apart
    rows, h = rows[order], h[order]
    begin = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1)))
    count = np.diff(np.append(begin, len(rows)))
    rows, h = rows[begin], h[begin]
    pivot = rows[:, 0].astype(np.int64)
    n_parts = np.where(pivot < len(parts), parts[np.minimum(pivot, len(parts) - 1)], np.uint64(1))
    key = pivot << 20 | (h % n_parts).astype(np.int64)
    where = (mix(key.astype(np.uint64), 5) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((key, where))
    key, where, count, words = key[order], where[order], count[order], rows[order, 1:]
    used = words > 0
    size = used[:, :reach].sum(1) * 16 + used[:, reach:].sum(1)
    begin = np.append(0, np.cumsum(used.sum(1)))
    flat = words[used]
    for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(where)).tolist()), strict=True):
        cols = [np.diff(key[lo:hi], prepend=0), count[lo:hi], size[lo:hi], flat[begin[lo] : begin[hi]]]
        yield pa.RecordBatch.from_arrays([pa.array([where[lo]], pa.int32()), *(pa.array([squeeze(c)], pa.binary()) for c in cols)], ["range", "keys", "counts", "sizes", "words"])


def _unpacked(rows: list[tuple[bytes, bytes, bytes, bytes]], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts, and the ranks to the left and right (0: none), the nearest first."""
    key = np.concatenate([np.cumsum(unsqueeze(r[0])) for r in rows])
    count, size, flat = (np.concatenate([unsqueeze(r[i]) for r in rows]) for i in (1, 2, 3))
    n_left, n_right = size >> 4, size & 15
    begin = np.cumsum(n_left + n_right) - n_left - n_right
    left, right = np.zeros((len(key), reach), np.int64), np.zeros((len(key), reach), np.int64)
    for j in range(reach):
        on = n_left > j
        left[on, j] = flat[begin[on] + j]
        on = n_right > j
        right[on, j] = flat[begin[on] + n_left[on] + j]
    return key, count, left, right


def grown(key: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray, longest: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases with their pivot in ``key``: (rows of words, one of their fragments each, count).

    ``least`` is, for each fragment, what a phrase of its pivot must reach to be
    given and grown on.
    """

    def extend(of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        on = np.flatnonzero((of >= 0) & (word > 0))
        _, first, inverse = np.unique(of[on] << 32 | word[on], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, inverse, count[on])
        one = on[first]
        keep = total >= least[one]
        number = np.where(keep, np.cumsum(keep) - 1, -1)
        out = np.full(len(of), -1, np.int64)
        out[on] = number[inverse]
        return out, one[keep], total[keep]

    pivot = key >> 20
    start = np.unique(key, return_inverse=True)[1].astype(np.int64)
    for a in range(longest):
        if a:
            start, one, total = extend(start, left[:, a - 1])
            yield np.column_stack([*(left[one, j] for j in range(a - 1, -1, -1)), pivot[one]]), one, total
        at = start
        for b in range(1, longest - a):
            at, one, total = extend(at, right[:, b - 1])
            yield np.column_stack([*(left[one, j] for j in range(a - 1, -1, -1)), pivot[one], *(right[one, j] for j in range(b))]), one, total


def _mined(batches: Iterator[pa.RecordBatch], longest: int, min_count: int, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows of fragments, a range's together, to (gram, f, whole): frequent phrases of whole pivots, all phrases of parts of one."""
    split = np.array(sorted(hot), np.int64)
    held: list[tuple[bytes, bytes, bytes, bytes]] = []
    at = None

    def mine() -> Iterator[pa.RecordBatch]:
        key, count, left, right = _unpacked(held, longest - 1)
        parted = np.isin(key >> 20, split)
        for words, one, total in grown(key, count, left, right, longest, np.where(parted, 1, min_count)):
            n, m = words.shape
            if n:
                grams = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(words.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([grams, pa.array(total), pa.array(~parted[one])], ["gram", "f", "whole"])

    for b in batches:
        for r, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and r != at:
                yield from mine()
                held.clear()
            at = r
            held.append(tuple(row))
    if held:
        yield from mine()


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): frequent words (lang, word, f, rank), frequent phrases of
    2 to ``longest`` words as ranks (gram, f), and the words of each lang in all (lang, n)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    with arrow_bytes(spark, ARROW_BYTES):
        b = stash(rows.mapInArrow(partial(_phrase_blocks, block=block), "block long, lang string, n long, codes binary, words array<string>, counts array<long>"), "phrase-blocks")
    totals = b.groupBy("lang").agg(F.sum("n").alias("n"))
    counted = b.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    counted = counted.where(F.col("f") >= min_count).orderBy(F.desc("f"), "lang", "word").withColumn("g", F.monotonically_increasing_id())
    counted = stash(counted, "frequent-words")
    size = {r["p"]: (r["n"], r["f"]) for r in counted.groupBy(F.shiftright("g", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).collect()}  # a row a partition
    before, done = [], 0
    for p in sorted(size):
        before.append((p, done))
        done += size[p][0]
    before = spark.createDataFrame(before, "p long, before long")
    words = counted.join(F.broadcast(before), F.shiftright("g", 33) == F.col("p")).select("lang", "word", "f", (F.col("before") + F.col("g").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("rank"))
    n, total = partitions(spark), sum(f for _, f in size.values())
    hot = {r["rank"]: -(-r["f"] * 2 * n // total) for r in words.where(F.col("f") * (2 * n) > F.lit(total)).select("rank", "f").collect()}  # fewer than 2n rows
    sums = b.agg(F.sum("n").alias("n"), F.sum(F.size("words")).alias("words")).first()
    by_word, by_key = (max(4 * n, (x or 0) // RANGE_ROWS) for x in (sums["words"], sums["n"]))
    kind = "range int, block long, lang string, nos binary, words binary"
    asks = b.select("block", "lang", "words").mapInArrow(partial(_dealt, ranges=by_word), kind).withColumn("rank", F.lit(None).cast("int"))
    told = words.select(F.pmod(F.crc32("word"), F.lit(by_word)).cast("int").alias("range"), F.lit(None).cast("long").alias("block"), "lang", F.lit(None).cast("binary").alias("nos"), F.col("word").cast("binary").alias("words"), "rank")
    asks = told.unionByName(asks).repartition(n, "range").sortWithinPartitions("range", F.col("rank").isNull())
    known = asks.mapInArrow(_answered, "block long, nos binary, ranks binary").groupBy("block").agg(F.collect_list(F.struct("nos", "ranks")).alias("known"))  # of one block's words
    fragments = b.select("block", "codes").repartition(n, "block").join(known, "block").select("codes", "known")
    fragments = fragments.mapInArrow(partial(_fragments, reach=longest - 1, hot=hot, ranges=by_key), "range int, keys binary, counts binary, sizes binary, words binary")
    dealt = fragments.repartition(n, "range").sortWithinPartitions("range")
    with arrow_bytes(spark, ARROW_BYTES):
        mined = stash(dealt.mapInArrow(partial(_mined, longest=longest, min_count=min_count, hot=hot), "gram array<int>, f long, whole boolean"), "phrases")
    added = mined.where("not whole").groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return words, mined.where("whole").select("gram", "f").unionByName(added), totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, cover_percent: int = 100, top: int = 2000, block: int = BLOCK) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    a is how often the phrase occurs, l and r how often its parts at the cut with
    the lowest score floor(1000 a n / (l r)) do, n the words of the language.  A
    phrase inside a longer one with at least ``cover_percent`` of its count is
    left out.
    """
    words, phrases, totals = frequent_phrases(docs, text_col, lang_col, longest, min_count, block)
    phrases = stash(phrases, "frequent-phrases")
    parts = phrases.unionByName(words.select(F.array("rank").alias("gram"), "f"))
    cuts = phrases.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cuts = cuts.withColumn("before", F.slice("gram", F.lit(1), F.col("k"))).withColumn("after", F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")))
    cuts = cuts.join(parts.select(F.col("gram").alias("before"), F.col("f").alias("l")), "before").join(parts.select(F.col("gram").alias("after"), F.col("f").alias("r")), "after")
    by_word = words.join(totals, "lang").select("lang", "word", "rank", "n")
    cuts = cuts.join(by_word.select("lang", "n", "rank"), F.col("gram")[0] == F.col("rank"))
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)"))
    best = cuts.groupBy("gram", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("gram", "a", "lang", "n", "b.score", "b.l", "b.r")
    inner = phrases.where(F.size("gram") > 2).select("f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("gram") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("gram") - m + 1), lambda i: F.slice("gram", i, m))))).alias("gram"))
    inner = inner.groupBy("gram").agg(F.max("f").alias("outer_f"))
    best = best.join(inner, "gram", "left").where(F.coalesce(F.col("outer_f") * 100 < F.col("a") * cover_percent, F.lit(True)))
    spelt = best.select("gram", F.posexplode("gram").alias("i", "rank")).join(by_word.select("rank", "word"), "rank").groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = best.join(spelt, "gram")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("group", F.pmod(F.xxhash64("gram"), F.lit(TOP_GROUPS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
