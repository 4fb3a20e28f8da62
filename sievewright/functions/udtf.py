"""SQL access: a table function and an array function over a pattern set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.operators.dfa_kernel import scan, split_batches
from sievewright.patterns import PatternSet
from sievewright.patterns.automaton import Table
from sievewright.shipping import ship

MATCH = T.StructType([T.StructField("pattern_id", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])


def matches_of(texts: pa.Array, tables: list[Table], names: pa.Array) -> pa.Array:
    """A list of matches for each text, by start, pattern and end; a null text has none."""
    parts = [(np.zeros(0, np.int64),) * 4]
    for first, part in split_batches(texts.to_pylist()):
        for t in tables:
            r, p, s, e = scan(t, part)
            parts.append((r + first, p, s, e))
    row, pattern, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    by_name = np.empty(len(names), np.int64)
    by_name[np.argsort(np.array(names.to_pylist(), object), kind="stable")] = np.arange(len(names))
    order = np.lexsort((end, by_name[pattern], start, row)) if len(row) else row
    row, pattern, start, end = (x[order] for x in (row, pattern, start, end))
    cols = [pa.array(pattern.astype(np.int32)), names.take(pa.array(pattern)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
    places = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays(cols, MATCH.names))


def register_array(spark: SparkSession, patterns: PatternSet, name: str = "multi_match_array") -> None:
    """``SELECT multi_match_array(text)``: array of (pattern_id, pattern, start_pos, end_pos)."""
    ship(spark)
    tables, names = patterns.tables(), pa.array(patterns.sources, pa.string())

    @F.arrow_udf(T.ArrayType(MATCH))
    def multi(texts: pa.Array) -> pa.Array:
        return matches_of(texts, tables, names)

    spark.udf.register(name, multi)


def register_udtf(spark: SparkSession, patterns: PatternSet, name: str = "multi_match") -> None:
    """``SELECT * FROM docs, LATERAL multi_match(docs.text)``

    A SQL function over the array function (registered as ``<name>_array``), so
    texts are scanned in Arrow batches and not row by row.
    """
    register_array(spark, patterns, f"{name}_array")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MATCH.fields)
    spark.sql(f"create or replace temporary function {name}(document string) returns table ({columns}) return select m.* from (select explode({name}_array(document)) as m)")
