"""Pattern tables as data: compiled where Spark's tasks are, dealt out when they are large.

A large set of patterns is sorted by text and cut into parts; each part is one row
of a job whose tasks parse it, determinise it and lay out its table.  Parts have
their own first characters for the most part, so a scan by many tables takes hardly
more steps than by one.

All tables together go to every task as long as they stay under a bound of bytes;
the texts are scanned once, where they are, however many tables there are.
Beyond the bound each task holds one table at a time: texts are dealt to (table,
part of the texts) pairs in one job that reads them once, and the table comes as
the first row of its pair.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.patterns import PatternSet
from sievewright.patterns.automaton import Table, build_table, compile_dfa
from sievewright.patterns.parser import parse
from sievewright.patterns.registry import SHARD_ENTRIES, tables_of
from sievewright.shipping import ship
from sievewright.sources.scratch import written

from .bloom import GramGate
from .dfa_kernel import match_batches

#: From so many patterns on they are compiled by tasks.
COMPILE_BY_TASKS = 2_000
#: Fewest patterns of a part.
LEAST_PART = 2_500
#: Bytes of all tables that every task may hold.
MOST_BYTES = 512 << 20
#: No bound: what needs one answer a row holds all tables in each task.
EVERY_BYTE = 1 << 62


def default_shards(cpus: int) -> int:
    """Parts of a pattern set for that many CPUs: half as many more, or one for up to two."""
    return cpus * 3 // 2 if cpus > 2 else 1


def _compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, patterns) to (shard, bytes, data): each part's tables, named by its first pattern."""
    for b in batches:
        for ids, sources in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k, t in enumerate(tables_of(zip(sources, ids, strict=True), SHARD_ENTRIES, lambda s: compile_dfa(parse(s)), build_table)):
                yield pa.RecordBatch.from_arrays([pa.array([f"{ids[0]}-{k}"]), pa.array([t.nbytes], pa.int64()), pa.array([pickle.dumps(t)], pa.binary())], ["shard", "bytes", "data"])


_kept: dict[tuple, DataFrame] = {}


def shard_rows(spark: SparkSession, parts: tuple[tuple[tuple[str, int], ...], ...]) -> DataFrame:
    """(shard, bytes, data): the tables of parts of (text, id), compiled by tasks and written; those of the last sets are kept."""
    key = (spark.sparkContext.applicationId, parts)
    if key not in _kept:
        ship(spark)
        if len(_kept) >= 8:
            del _kept[next(iter(_kept))]
        rows = spark.createDataFrame([([i for _, i in p], [s for s, _ in p]) for p in parts], "ids array<int>, patterns array<string>")
        _kept[key] = written(rows.repartition(len(parts)).mapInArrow(_compiled, "shard string, bytes long, data binary"), "tables")
    return _kept[key]


@lru_cache(8)
def _collected(app: str, parts: tuple) -> tuple[Table, ...]:
    return tuple(pickle.loads(r["data"]) for r in _kept[app, parts].select("shard", "data").orderBy("shard").collect())


def parts_of(patterns: PatternSet, ids: list[int], shards: int | str, cpus: int) -> tuple[tuple[tuple[str, int], ...], ...]:
    """Patterns in order of their text, in ``shards`` parts by a hash of the text or, if not
    told how many, in runs of equal size, as many as the CPUs ask for and the set has use for."""
    chosen = sorted(((patterns.sources[i], i) for i in ids))
    if shards == "auto":
        n = min(default_shards(cpus), max(1, len(chosen) // LEAST_PART))
        cuts = [len(chosen) * k // n for k in range(n + 1)]
        return tuple(tuple(chosen[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)
    own: list[list[tuple[str, int]]] = [[] for _ in range(shards)]
    for s, i in chosen:
        own[zlib.crc32(s.encode()) % shards].append((s, i))
    return tuple(tuple(p) for p in own if p)


def tables_for(spark: SparkSession, patterns: PatternSet, ids: list[int], shards: int | str = 1, most_bytes: int = MOST_BYTES) -> list[Table] | DataFrame:
    """The tables of the patterns; as rows (shard, bytes, data) if all of them are more than a task may hold."""
    cpus = spark.sparkContext.defaultParallelism
    if len(ids) < COMPILE_BY_TASKS and most_bytes >= MOST_BYTES:
        parts = parts_of(patterns, ids, shards, cpus)
        return [t for p in parts for t in patterns.tables([i for _, i in p])]
    parts = parts_of(patterns, ids, "auto" if shards == 1 else shards, cpus)
    rows = shard_rows(spark, parts)
    if (rows.agg(F.sum("bytes")).first()[0] or 0) > most_bytes:
        return rows
    return list(_collected(spark.sparkContext.applicationId, parts))


def _dealt(batches: Iterator[pa.RecordBatch], names: pa.Array, gate: GramGate | None, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows (keys..., data, text), each pair's table before its texts, to matches."""
    table: list[Table] = []
    for b in batches:
        data = b.column(b.num_columns - 2)
        cuts = [0, *np.flatnonzero(np.asarray(data.is_valid())).tolist(), b.num_rows]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if k:
                table, lo = [pickle.loads(data[lo].as_py())], lo + 1
            if hi > lo:
                part = pa.RecordBatch.from_arrays([*b.columns[:-2], b.columns[-1]], [*b.schema.names[:-2], b.schema.names[-1]]).slice(lo, hi - lo)
                yield from match_batches(iter([part]), table, names, gate, with_text)


def dealt_matches(rows: DataFrame, tables: DataFrame, patterns: PatternSet, fields: list[T.StructField], gate: GramGate | None, with_text: bool) -> DataFrame:
    """``rows`` (c0, c1, ..., text) to matches with ``fields``: one job over (table, part of the texts) pairs."""
    spark = rows.sparkSession
    names = [r["shard"] for r in tables.select("shard").collect()]  # a name a table
    n = len(names)
    salts = -(-max(int(spark.conf.get("spark.sql.shuffle.partitions")), n) // n)
    *keys, text = rows.columns
    texts = rows.select(*keys, F.col(text).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    texts = texts.select("*", F.explode(F.array(*[F.lit(x) for x in names])).alias("shard")).withColumn("data", F.lit(None).cast("binary"))
    heads = tables.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-1]], F.lit(None).cast("string").alias("text"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "shard", "data")
    both = texts.unionByName(heads).repartition(n * salts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())
    fn = partial(_dealt, names=pa.array(patterns.sources, pa.string()), gate=gate, with_text=with_text)
    return both.select(*keys, "data", "text").mapInArrow(fn, T.StructType(fields))
