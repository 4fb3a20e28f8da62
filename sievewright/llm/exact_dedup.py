"""Exact dedup by content sort.

Texts are equal when identical after each run of white space becomes one
space.  The rows are range-partitioned by sampled splitters over the
normalised text, sorted externally by Spark inside each partition, and each
row is compared in full with the one before it.

* Splitters are taken over (first code points, SHA-256, id), so what the
  sample sends to the driver is bounded however long the texts are, and a
  group of copies of any size is divided over partitions by id.
* A run that touches the edge of its partition may go on in the next one.
  Such runs are at most two a partition; their summaries are merged by digest
  and join the rows again, as a broadcast up to ``BROADCAST_EDGES`` (counted).

Defined cases: null text counts as empty; the smallest id stays, a null id
only where the whole group has none; of rows with equal text and id one
stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.shipping import ship

from .common import packed, partitions, quoted, single_spaced, stash, text_or_empty, unpacked

#: Code points of the text that lead the range key; the rest is told apart by
#: the digest, and equality is always decided on the full text.
LEAD = 24
#: About 200 bytes each in a hash table; 20 MB at most.
BROADCAST_EDGES = 100_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, norm, sha) to runs of equal norm.

    Only ids of the open run are held, eight bytes a row at most of one
    partition, which the splitters bound.
    """
    ids: list[pa.Array] = []
    text = sha = None
    first = True

    def emit(ids_, starts, shas, edge):
        """ids_: rows of whole runs; starts: where each begins."""
        n = len(ids_)
        sizes = np.diff(np.append(starts, n))
        at = np.repeat(starts, sizes)
        head = np.zeros(n, bool)
        head[starts] = True
        return pa.RecordBatch.from_arrays(
            [ids_, ids_.take(pa.array(at)), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(head), shas.take(pa.array(np.repeat(np.arange(len(starts)), sizes))), pa.array(np.repeat(edge, sizes))],
            ["doc_id", "keep_id", "group_size", "head", "text_sha256", "edge"],
        )

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        bid, norm, digest = b.column(0), b.column(1), b.column(2)
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if ids:
            new[0] = norm[0].as_py() != text
        held = sum(map(len, ids))
        starts = np.flatnonzero(new)
        shas = digest.take(pa.array(starts))
        if ids:
            starts, shas = np.append(0, held + starts), pa.concat_arrays([pa.array([sha], pa.string()), shas])
        ids.append(bid)
        if len(starts) > 1:
            rows, last = pa.concat_arrays(ids), int(starts[-1])
            edge = np.zeros(len(starts) - 1, bool)
            edge[0], first = first, False
            yield emit(rows.slice(0, last), starts[:-1], shas.slice(0, len(starts) - 1), edge)
            ids = [rows.slice(last)]
        text, sha = norm[n - 1].as_py(), digest[n - 1].as_py()
    if ids:
        yield emit(pa.concat_arrays(ids), np.array([0]), pa.array([sha], pa.string()), np.array([True]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    n = n_partitions or partitions(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("doc_id"), single_spaced(text_or_empty(text_col)).alias("norm")).withColumn("sha", F.sha2("norm", 256))
    key = [F.substring("norm", 1, LEAD), F.col("sha"), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(n, *key).sortWithinPartitions(*key[:2], "norm", key[2])
    kind = rows.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("keep_id", kind), T.StructField("group_size", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("text_sha256", T.StringType()), T.StructField("edge", T.BooleanType())])
    local = stash(dealt.select("doc_id", "norm", "sha").mapInArrow(_runs, out), "exact")
    edges = stash(local.where("edge and head").groupBy(F.col("text_sha256").alias("e_sha")).agg(F.min("keep_id").alias("e_keep"), F.sum("group_size").alias("e_size")), "exact-edges")
    few = edges.count() <= BROADCAST_EDGES
    both = local.join(F.broadcast(edges) if few else edges, (F.col("text_sha256") == F.col("e_sha")) & F.col("edge"), "left")
    return both.select(
        "doc_id",
        F.when(F.col("e_size").isNull(), F.col("keep_id")).otherwise(F.col("e_keep")).alias("keep_id"),
        F.coalesce("e_size", "group_size").alias("group_size"),
        (F.col("head") & F.when(F.col("e_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("e_keep")))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows equal in id and normalised text but not in other columns count as
    repeated: the one smallest by its columns' JSON text stays.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    rows = docs.select(packed(docs), quoted(id_col).alias("id"), F.sha2(single_spaced(text_or_empty(text_col)), 256).alias("sha"))
    both = rows.join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")), "left_semi")
    return both.groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row")).select(*unpacked(docs.columns))
