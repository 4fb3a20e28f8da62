"""Byte-level BPE: texts to token ids and back, each distinct word encoded once.

A *word* here is a match of the pattern (a pre-token), space before it included.

1. Blocks of texts are split into words.  A block keeps its distinct words once,
   numbered by falling frequency, and for each document the numbers of its words
   in order: the words' positions.
2. The distinct words of all blocks are dealt out by a hash, so that all copies
   of a word meet in one task, which merges its bytes once.  A common word is one
   row's part in each block, however often it stands there, and there are as many
   ranges of the hash as keep a range's distinct words bounded.
3. Ids go back to the blocks that asked, and each document is put together from
   the ids of its words by position.
4. Decoding looks ids up in the table of token bytes, which has one row for each
   token of the vocabulary and goes to every task.

Blocks are written before anything is asked, so what is joined is what was read.

A word whose bytes are a token is that token; else the adjacent pair of parts
with the least rank merges, the leftmost of equals, until none has a rank.
Special tokens don't exist: their strings are ordinary text.

The pattern runs in the ``regex`` module.  It may know letters and digits of a
newer Unicode version than tiktoken; a character that Python's own table doesn't
know is therefore put to tiktoken, and stands for its class while words are split.

Defined cases: a null text is the empty text, with no ids; repeated rows, null
and repeated ids give a row each; decoding gives null for null ids and for ids
out of the vocabulary; other columns are not read by ``encode`` and are kept by
``decode``.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.shipping import ship

from .common import ARROW_BYTES, arrow_bytes, new_path, partitions, quoted, stash
from .packing import coded, gathered, squeeze, squeeze_words, unsqueeze, unsqueeze_words
from .tokens import blocks

#: Bytes of text whose distinct words are kept together, and that are split at once.
BLOCK, PIECE = 8 << 20, 1 << 20
#: Words of all blocks that one range of the hash may hold.
RANGE_WORDS = 500_000
#: Ids in an Arrow batch of results (4 bytes each).
BATCH_IDS = 500_000


class Vocabulary:
    """Ranks of byte sequences, from a file of lines "base64 rank"."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            got = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        self.ids = np.array([r for r, _ in got], np.int64)
        self.tokens = squeeze_words([t for _, t in got])

    @lru_cache(1)  # noqa: B019  one for each task's copy
    def ranks(self) -> dict[bytes, int]:
        return dict(zip(unsqueeze_words(self.tokens), self.ids.tolist(), strict=True))

    @lru_cache(1)  # noqa: B019
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each id: the first of its bytes and their number (0: no such id); and all bytes."""
        words = unsqueeze_words(self.tokens)
        size = np.zeros(int(self.ids.max(initial=-1)) + 1, np.int64)
        size[self.ids] = [len(w) for w in words]
        begin = np.append(0, np.cumsum(size))[:-1]  # ids are in order, so are the bytes
        return begin, size, np.frombuffer(b"".join(words), np.uint8)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 100:
        return _merged_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        at, least = -1, None
        for i, r in enumerate(pair):
            if r is not None and (least is None or r < least):
                at, least = i, r
        if least is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long word: parts as a linked list, pairs in a heap, so time grows by n log n."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place; 0: no part begins there
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of its parts is another by now
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


@lru_cache(1)
def _probe(pattern: str):
    """An encoding of tiktoken with tokens for "a", "1" and "!" with one byte: what joins them is of their class."""
    import tiktoken

    pairs = [bytes([c, b]) for c in b"a1!" for b in range(256)]
    ranks = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate(pairs)}
    return tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(100_000)
def stand_in(c: str, pattern: str) -> str:
    """A character of the class that tiktoken has ``c`` in, for one that Python's table doesn't know."""
    if unicodedata.category(c) != "Cn":
        return c
    for first, other in (("a", "é"), ("1", "²"), ("!", "§")):
        if _probe(pattern).encode_ordinary(first + c)[0] >= 256:
            return other
    return c


def split_words(texts: list[str], pattern: str) -> tuple[list[str], list[int]]:
    """Words of all texts, and how many each has."""
    import regex

    find = regex.compile(pattern).findall
    out, sizes = [], []
    for t in texts:
        words = find(t)
        if not t.isascii():
            odd = {c: s for c in set(t) if ord(c) > 0x2FF and (s := stand_in(c, pattern)) != c}
            if odd:
                ends = np.cumsum([len(w) for w in find(t.translate(str.maketrans(odd)))]).tolist()
                words = [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        out.append(words)
        sizes.append(len(words))
    return list(chain.from_iterable(out)), sizes


def _word_blocks(batches: Iterator[pa.RecordBatch], pattern: str, block: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to blocks (block, ids, sizes, codes, n_words, words)."""
    first, k = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
    ids, sizes, words, held = [], [], [], 0

    def row() -> pa.RecordBatch:
        code, distinct, _ = coded(pa.chunked_array(words, pa.string()).combine_chunks())
        who = pa.concat_arrays(ids)
        cols = [
            pa.array([first + k], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(who)], pa.int32()), who),
            pa.array([squeeze(np.concatenate(sizes))], pa.binary()),
            pa.array([squeeze(code)], pa.binary()),
            pa.array([len(distinct)], pa.int64()),
            pa.array([squeeze_words(distinct.cast(pa.binary()).to_pylist())], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["block", "ids", "sizes", "codes", "n_words", "words"])

    for b in batches:
        for i, j, raw, _ in blocks(b.column(1), PIECE):
            got, n = split_words(b.column(1).slice(i, j - i).to_pylist(), pattern)
            ids.append(b.column(0).slice(i, j - i))
            sizes.append(np.array(n, np.int64))
            words.append(pa.array(got, pa.string()))
            held += len(raw)
            if held >= block:
                yield row()
                ids, sizes, words, held, k = [], [], [], 0, k + 1
    if ids:
        yield row()


def _dealt(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """A block's words to a row for each range of the hash: (range, block, nos, words)."""
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = unsqueeze_words(data.as_buffer())
            part = np.fromiter((zlib.crc32(w) % ranges for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for nos in np.split(order, cuts) if len(order) else ():
                yield pa.RecordBatch.from_arrays([pa.array([part[nos[0]]], pa.int32()), pa.array([block], pa.int64()), pa.array([squeeze(np.diff(nos, prepend=0))], pa.binary()), pa.array([squeeze_words([words[i] for i in nos.tolist()])], pa.binary())], ["range", "block", "nos", "words"])


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """(range, block, nos, words), a range's rows together, to (block, nos, counts, ids): each distinct word is merged once."""
    ranks, known, at = vocabulary.ranks(), {}, None
    for b in batches:
        for r, block, nos, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if r != at:
                known, at = {}, r
            got = []
            for w in unsqueeze_words(data.as_buffer()):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = merged(w, ranks)
                got.append(ids)
            counts = np.array([len(x) for x in got], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([nos], pa.binary()), pa.array([squeeze(counts)], pa.binary()), pa.array([squeeze(np.fromiter(chain.from_iterable(got), np.int64, int(counts.sum())))], pa.binary())], ["block", "nos", "counts", "ids"])


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the ids of their words (parts) to (id, ids) in order of position."""
    for b in batches:
        for i in range(b.num_rows):
            who, n_words, parts = b.column(0)[i].values, b.column(3)[i].as_py(), b.column(4)[i].as_py() or []
            sizes, codes = unsqueeze(b.column(1)[i].as_buffer()), unsqueeze(b.column(2)[i].as_buffer())
            begin, count, flat, done = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), [], 0
            for p in parts:
                nos, n, ids = np.cumsum(unsqueeze(p["nos"])), unsqueeze(p["counts"]), unsqueeze(p["ids"])
                begin[nos], count[nos] = done + np.cumsum(n) - n, n
                flat.append(ids.astype(np.int32))
                done += len(ids)
            flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            ends = np.append(0, np.cumsum(sizes))  # in words
            total = np.append(0, np.cumsum(count[codes]))[ends]  # in ids
            d = 0
            while d < len(sizes):
                e = max(d + 1, int(np.searchsorted(total, total[d] + BATCH_IDS, side="right")) - 1)
                own = codes[ends[d] : ends[e]]
                ids = flat[gathered(begin[own], count[own])]
                yield pa.RecordBatch.from_arrays([who.slice(d, e - d), pa.ListArray.from_arrays(pa.array((total[d : e + 1] - total[d]).astype(np.int32)), pa.array(ids))], ["id", "ids"])
                d = e


def _by_block(b: DataFrame, buckets: int) -> DataFrame:
    """Writes blocks as a table that Spark knows as dealt by block: what they asked for comes to them, they don't move."""
    spark, path = b.sparkSession, new_path(b.sparkSession, "words")
    name = path.rpartition("/")[2].replace("-", "_")
    b.write.format("parquet").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # an external table: its files stay
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, range_words: int = RANGE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("words", T.BinaryType())])
    n = partitions(spark)
    with arrow_bytes(spark, ARROW_BYTES):
        b = _by_block(rows.mapInArrow(partial(_word_blocks, pattern=pattern, block=block), shape), n)
    total = b.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(4 * n, total // range_words)
    asked = b.select("block", "words").mapInArrow(partial(_dealt, ranges=ranges), "range int, block long, nos binary, words binary").repartition(n, "range").sortWithinPartitions("range")
    parts = asked.mapInArrow(partial(_encoded, vocabulary=vocabulary), "block long, nos binary, counts binary, ids binary")
    parts = parts.groupBy("block").agg(F.collect_list(F.struct("nos", "counts", "ids")).alias("parts"))  # of one block's words
    out = b.drop("words").join(parts.hint("merge"), "block", "left").select(F.col("ids"), "sizes", "codes", "n_words", "parts")
    out = out.mapInArrow(_reassembled, T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.withColumnRenamed("id", "doc_id")


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Batches whose last column has ids: with the bytes of those in its place."""
    begin, size, raw = vocabulary.table()
    for b in batches:
        col = b.columns[-1]
        n = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
        ids = col.flatten()
        known = np.asarray(ids.is_valid())
        ids = np.asarray(ids.fill_null(-1)).astype(np.int64)
        known &= (ids >= 0) & (ids < len(size))
        ids = np.where(known, ids, 0)
        known &= (size[ids] if len(size) else 0) > 0
        at = np.append(0, np.cumsum(n))
        wrong = np.append(0, np.cumsum(~known))
        fine = np.asarray(col.is_valid()) & (wrong[at[1:]] == wrong[at[:-1]])
        d = 0
        while d < len(n):
            e = max(d + 1, int(np.searchsorted(at, at[d] + BATCH_IDS, side="right")) - 1)
            own = ids[at[d] : at[e]]
            width = np.append(0, np.cumsum(size[own] if len(size) else 0 * own))[at[d : e + 1] - at[d]]
            data = raw[gathered(begin[own], size[own])] if len(size) else raw
            out = pa.Array.from_buffers(pa.large_binary(), e - d, [None, pa.py_buffer(width.astype(np.int64)), pa.py_buffer(data)])
            shown = pa.array(fine[d:e])
            yield pa.RecordBatch.from_arrays([*(c.slice(d, e - d) for c in b.columns[:-1]), pa.compute.if_else(shown, out, pa.scalar(None, out.type)).cast(pa.binary())], b.schema.names)
            d = e


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of ``df`` with the bytes of their ids in ``out_col``."""
    ship(df.sparkSession)
    rows = df.select("*", quoted(ids_col).cast("array<int>").alias("__ids"))
    shape = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(partial(_decoded, vocabulary=vocabulary), T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(shape)])).toDF(*shape.names)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256."""
    both = decode(encode(docs, vocabulary, pattern, id_col, text_col, **kw), vocabulary)
    digests = both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    with arrow_bytes(docs.sparkSession, ARROW_BYTES):
        return stash(digests, "bpe-digests")
