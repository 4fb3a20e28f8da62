"""A persistent index of the 1-, 2- and 3-grams of a text table.

``build_index`` writes three tables under a path:

* ``texts``: the rows with the number of their block, some rows that stand
  together, in small row groups;
* ``postings``: gram, segment, and the blocks of that segment that have the gram,
  as sorted offsets, at most ``SEGMENT`` a row; in folders by a hash of the gram;
* ``files``: in which file of ``texts`` each block is.

A pattern needs grams: its fixed runs, and sets of few characters beside them,
give a formula of ands and ors over the grams that every text with a match has.
The postings of those grams alone are read and put together by block; blocks
that meet the formula are candidates, and only their files and row groups are
read again and scanned.

Defined cases: a null text is in no posting and matches nothing; empty and
repeated rows are kept; a pattern that needs no gram makes every block a
candidate, and so do more than ``MOST_GRAMS`` grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.patterns import PatternSet
from sievewright.patterns.ast import CharSet, Lit, Pattern

from sievewright.shipping import ship

from .dfa_kernel import code_points, split_batches
from .match import match_all

#: Rows of a block and blocks of a row of postings; powers of two.
BLOCK_ROWS, SEGMENT = 64, 1 << 14
#: Folders of postings.
BUCKETS = 64
#: Grams a formula may have.
MOST_GRAMS = 500
#: Characters of a set that is spelt out, and ways to spell a gram.
MOST_WAYS = 16
#: Candidate blocks and files that are named in the plan; beyond, they are joined.
MOST_NAMED = 10_000
#: Pairs of gram and block that a task holds before it sends them on, about.
MOST_HELD = 1 << 23
#: Ranges of blocks in a pushed filter.
MOST_RANGES = 100

#: A formula: a gram, or ("and" | "or", parts); None needs nothing.
Formula = str | tuple | None


# ---- what a pattern needs ----------------------------------------------------------


def both(parts: list[Formula]) -> Formula:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return ("and", tuple(parts)) if len(parts) > 1 else parts[0] if parts else None


def either(parts: list[Formula]) -> Formula:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return ("or", tuple(parts)) if len(parts) > 1 else parts[0]


def _spelt(sets: list[list[str]]) -> Formula:
    """Some spelling of a run of up to three characters."""
    ways = 1
    for s in sets:
        ways *= len(s)
    return either(["".join(x) for x in product(*sets)]) if 0 < ways <= MOST_WAYS else None


def _run_needs(run: list[list[str]]) -> Formula:
    """All grams of a run of characters, each one of a few."""
    size = min(3, len(run))
    return both([_spelt(run[i : i + size]) for i in range(len(run) - size + 1)]) if run else None


def needs(pattern: Pattern) -> Formula:
    """Grams that are in every match of the pattern."""
    of_all: list[Formula] = []
    for a in pattern.alternatives:
        runs: list[list[list[str]]] = [[]]
        for i in a.items:
            chars: list[list[str]] | None = None
            if isinstance(i.atom, Lit):
                chars = [[c] for c in i.atom.text]
            elif isinstance(i.atom, CharSet) and not i.atom.negated and 0 < (n := sum(hi - lo + 1 for lo, hi in i.atom.intervals)) <= MOST_WAYS:
                chars = [sorted({chr(c) for lo, hi in i.atom.intervals for c in range(lo, hi + 1)})] if n else None
            if i.optional or chars is None:
                runs.append([])
            elif i.repeated:  # what stands before meets the first round, what follows the last
                runs[-1] = runs[-1] + chars
                runs.append(list(chars))
            else:
                runs[-1] = runs[-1] + chars
        of_all.append(both([_run_needs(r) for r in runs]))
    return either(of_all)


def grams_of(f: Formula) -> list[str]:
    return [] if f is None else [f] if isinstance(f, str) else list(dict.fromkeys(g for p in f[1] for g in grams_of(p)))


def _met(f: Formula, there: Column, number: dict[str, int]) -> Column:
    """Whether the grams of a block, by number, meet the formula."""
    if isinstance(f, str):
        return F.array_contains(there, number[f])
    parts = [_met(p, there, number) for p in f[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if f[0] == "and" else out | p
    return out


# ---- the index ------------------------------------------------------------------------


@dataclass(frozen=True)
class GramIndex:
    spark: SparkSession
    path: str
    text_col: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def candidate_blocks(self, patterns: PatternSet) -> DataFrame | None:
        """(block): those that may have a match; None: all may."""
        f = either([needs(p) for p in patterns.parsed])
        grams = grams_of(f)
        if f is None or len(grams) > MOST_GRAMS:
            return None
        number = {g: i for i, g in enumerate(grams)}
        p = self.table("postings").where(F.col("bucket").isin(sorted({crc32(g.encode()) % BUCKETS for g in grams})) & F.col("gram").isin(grams))
        which = F.element_at(F.create_map(*[x for g, i in number.items() for x in (F.lit(g), F.lit(i))]), F.col("gram"))
        at = p.select("segment", F.explode("blocks").alias("offset"), which.alias("g")).select((F.col("segment") * SEGMENT + F.col("offset")).alias("block"), "g")
        return at.groupBy("block").agg(F.collect_set("g").alias("there")).where(_met(f, F.col("there"), number)).select("block")

    def candidates(self, patterns: PatternSet) -> DataFrame:
        """The rows of blocks that may have a match, with their columns."""
        blocks = self.candidate_blocks(patterns)
        texts = self.table("texts")
        if blocks is None:
            return texts.drop("block")
        found = blocks.join(self.table("files"), "block").limit(MOST_NAMED + 1).collect()
        if len(found) > MOST_NAMED:
            return texts.join(blocks, "block", "left_semi").drop("block")
        if not found:
            return texts.where(F.lit(False)).drop("block")
        named = self.spark.read.schema(texts.schema).parquet(*sorted({r["file"] for r in found}))
        numbers = sorted(r["block"] for r in found)
        return named.where(_ranges(numbers) & F.col("block").isin(numbers)).drop("block")


def _ranges(numbers: list[int]) -> Column:
    """Few ranges that hold the numbers: what a scan can be told."""
    gaps = sorted((b - a, i) for i, (a, b) in enumerate(zip(numbers, numbers[1:], strict=False)) if b - a > 1)
    cuts = sorted(i for _, i in gaps[-(MOST_RANGES - 1) :])
    out = F.lit(False)
    for lo, hi in zip([0, *(c + 1 for c in cuts)], [*cuts, len(numbers) - 1], strict=True):
        out = out | F.col("block").between(numbers[lo], numbers[hi])
    return out


#: Stands for a character that a gram of one or two doesn't have; no code point is as large.
_NO = 0x1FFFFF


def _pairs(texts: list[str], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (gram, block): a gram is three code points, 21 bits each."""
    codes, begin = code_points(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(begin))
    chars, x = np.unique(codes, return_inverse=True)
    blocks, y = np.unique(block, return_inverse=True)
    k, x, y = len(chars) + 1, x.astype(np.int64) + 1, y.astype(np.int64)[of]  # 0: no character
    keys = []
    for size in (1, 2, 3):
        m = max(0, len(codes) - size + 1)
        at = np.flatnonzero(of[:m] == of[size - 1 :][:m])
        g = x[at] * (k * k)
        for j in range(1, size):
            g = g + x[at + j] * k ** (2 - j)
        keys.append(g * len(blocks) + y[at])
    got = np.unique(np.concatenate(keys))
    g, y = np.divmod(got, max(1, len(blocks)))
    c = np.append(_NO, chars.astype(np.int64))
    return (c[g // (k * k)] << 42) | (c[g // k % k] << 21) | c[g % k], blocks[y]


def packed_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) to (gram, segment, blocks of it): a row for a gram in what a task holds at once."""
    parts, held = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        gram, block = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((block, gram))
        gram, block = gram[order], block[order]
        segment = block // SEGMENT
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (segment[1:] != segment[:-1])))
        edges = np.append(first, len(gram))
        g = gram[first]
        body = np.stack([g >> 42, (g >> 21) & _NO, g & _NO], 1).ravel()
        there = body != _NO
        text = body[there].astype("<u4").tobytes().decode("utf-32-le")
        cut = np.append(0, np.cumsum(there.reshape(-1, 3).sum(1))).tolist()
        for i in range(0, len(first), 20_000):
            e = edges[i : i + 20_001]
            lists = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array((block[e[0] : e[-1]] % SEGMENT).astype(np.int32)))
            grams = pa.array([text[a:z] for a, z in zip(cut[i : i + len(e) - 1], cut[i + 1 : i + len(e)], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([grams, pa.array(segment[first[i : i + len(e) - 1]]), lists], ["gram", "segment", "blocks"])

    for b in batches:
        block = b.column(0).to_numpy(zero_copy_only=False)
        for at, part in split_batches(b.column(1).to_pylist()):
            got = _pairs(part, block[at : at + len(part)])
            if len(got[0]):
                parts.append(got)
                held += len(got[0])
            if held >= MOST_HELD:
                yield from rows()
                parts, held = [], 0
    if parts:
        yield from rows()


def build_index(df: DataFrame, path: str, text_col: str = "text", block_rows: int = BLOCK_ROWS) -> GramIndex:
    """Writes the index of ``df`` to a new folder."""
    spark = df.sparkSession
    rows = df.withColumn("block", F.floor(F.monotonically_increasing_id() / F.lit(block_rows)).cast("long"))
    rows.write.option("parquet.block.size", 1 << 20).parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    texts.select("block", F.input_file_name().alias("file")).distinct().write.parquet(f"{path}/files")
    ship(spark)
    p = texts.select("block", F.col("`" + text_col.replace("`", "``") + "`")).mapInArrow(packed_postings, "gram string, segment long, blocks array<int>")
    p = p.withColumn("bucket", F.pmod(F.crc32("gram"), F.lit(BUCKETS)).cast("int"))
    # dealt once, packed; a block that two tasks or two parts of one have read comes twice
    p = p.repartition("bucket").groupBy("bucket", "gram", "segment").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"))
    p.select("gram", "segment", "blocks", "bucket").sortWithinPartitions("bucket", "gram", "segment").write.partitionBy("bucket").parquet(f"{path}/postings")
    return GramIndex(spark, path, text_col)


def indexed_match(index: GramIndex, patterns: PatternSet, keys: list[str] | None = None, **kw) -> DataFrame:
    """``match_all`` over the candidate blocks: the same rows as over all texts."""
    return match_all(index.candidates(patterns), patterns, index.text_col, keys, **kw)
