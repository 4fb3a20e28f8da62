"""MinHash near-dedup by fast similarity sketching.

1. *Sketch.*  Every distinct word shingle of a document is thrown into one of
   ``t`` bins per round and each bin keeps its minimum.  Rounds t..2t-1 aim at
   bin 0..t-1 in turn, so every coordinate is filled in the end; values of an
   earlier round always win.  (Dahlgaard, Knudsen, Thorup 2017: expected time
   O(n + t log t), and the agreement of two sketches concentrates like t
   independent trials.)
2. *Classes.*  Documents with the same shingle set are one node from here on,
   so copies are never expanded into pairs.
3. *Banding.*  ``bands`` groups of ``rows`` coordinates are hashed to keys.
   With the default 32 x 4, two sets at 0.75 share no key with probability
   5e-6.
4. *Stars.*  Each node is compared only with the leader of each of its buckets,
   the node that meets most others over all its own buckets and so stands in the
   middle of its group: at most ``bands`` pairs a node, whatever a bucket's size.
5. *The rest, exactly.*  A bucket whose nodes are not one component by now may
   hide links its star has not seen.  The nodes of such buckets are joined by
   a prefix filter (shingles in one global order, rare first; two sets that
   similar share one of their first shingles at a position that still allows
   the overlap), leaving out pairs that are already connected.  No bucket is
   capped and no pair that could link is skipped.
6. *Verification.*  Every candidate pair is confirmed on the full shingle
   sets of both documents: 100 * |intersection| >= 100 * threshold * |union|.

Shingles and nodes are 64-bit hashes.  Pairs are first screened by comparing
sketches (one byte a coordinate): fewer than ``screen`` of them equal is more
than six standard deviations below the threshold.

Defined cases: null or wordless texts have an empty set and link with nothing
(component_id is their own id); a text with fewer words than a shingle is one
shingle; rows with equal texts are linked, also repeated ids; null ids link
but never name a component that has other ids; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.shipping import ship

from . import tokens as tk
from .common import ARROW_BYTES, arrow_bytes, packed, quoted, stash, text_or_empty, unpacked, without
from .components import components

U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Nodes up to this number are broadcast (8 bytes each) to pick their texts
#: from the corpus; above, the texts are shuffled to meet them.
BROADCAST_NODES = 500_000
#: The shingle order comes from two rows of 2^ORDER_BITS counters (the smaller
#: count holds): 4 MB whatever the input.  Any order gives the same links; a
#: closer count of what is common only makes fewer candidates.
ORDER_BITS = 19
ORDER_PART = 1 << 16


def sketch(s: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Sketches (rows x t) of sets given as hashes ``s`` with row borders ``first``.

    The sketch of an empty set is all EMPTY.
    """
    n = len(first) - 1
    out = np.full((n, t), EMPTY, U)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n), np.diff(first))
    for i in range(2 * t):
        if not len(s):
            break
        h = tk.mix(s, 1000 + i)
        place = ((h >> U(40)) * U(t) >> U(24)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(flat, row * t + place, (U(i) << U(40)) | (h & U((1 << 40) - 1)))
        live = np.unique(row)
        todo = np.zeros(n, bool)
        todo[live] = (out[live] == EMPTY).any(1)
        on = todo[row]
        s, row = s[on], row[on]
    return out


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (n x bands) of ``rows`` coordinates each."""
    keys = np.empty((len(sk), bands), U)
    for k in range(bands):
        h = np.full(len(sk), k + 1, U)
        for r in range(rows):
            h = tk.mix(h * U(31) + sk[:, k * rows + r], 7)
        keys[:, k] = h
    return keys


def set_hash(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, whatever the order of its items."""
    total = np.zeros((len(s) + 1, 2), U)
    np.cumsum(tk.mix(s, 3), out=total[1:, 0])
    np.cumsum(tk.mix(s, 4), out=total[1:, 1])
    d = total[first[1:]] - total[first[:-1]]
    return tk.mix(tk.mix(d[:, 0], 5) + d[:, 1] + np.diff(first).astype(U))


def _sketches(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    t = bands * rows
    for b in batches:
        for i, j, raw, off in tk.blocks(b.column(2)):
            s, first = tk.shingles(*tk.words(raw, off), k)
            n = np.diff(first)
            sk = sketch(s, first, t)
            keys = band_keys(sk, bands, rows).view(np.int64).reshape(-1)
            m = j - i
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(i, m),
                    b.column(1).slice(i, m),
                    pa.array(n.astype(np.int64)),
                    pa.array(set_hash(s, first).view(np.int64), mask=n == 0),
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), pa.array(keys)),
                    pa.array([x.tobytes() for x in (tk.mix(sk, 9) & U(255)).astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "th", "n_shingles", "node", "bands", "sig"],
            )


def _screened(batches: Iterator[pa.RecordBatch], t: int, screen: float) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, sig_u, sig_v) whose sketches agree in enough coordinates."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, t) for c in (2, 3))
            ok = (x == y).mean(1) >= screen
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok))


def _verified(batches: Iterator[pa.RecordBatch], k: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, text_u, text_v) that link on their full sets."""
    for b in batches:
        n = b.num_rows
        keep = np.zeros(n, bool)
        at = 0
        for i in range(0, n, 64):
            part = b.slice(i, 64)
            sides = []
            for c in (2, 3):
                got = []
                for _, _, raw, off in tk.blocks(part.column(c)):
                    s, first = tk.shingles(*tk.words(raw, off), k)
                    got += [s[first[r] : first[r + 1]] for r in range(len(first) - 1)]
                sides.append(got)
            for x, y in zip(*sides, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[at] = both > 0 and 100 * both >= threshold * (len(x) + len(y) - both)
                at += 1
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep))


def _places(s: np.ndarray) -> list[np.ndarray]:
    return [(tk.mix(s, 50 + r) >> U(64 - ORDER_BITS)).astype(np.int64) for r in range(2)]


def _counters(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Counters of a partition's shingles, in parts of ORDER_PART."""
    total = np.zeros((2, 1 << ORDER_BITS), np.uint32)
    for b in batches:
        for _, _, raw, off in tk.blocks(b.column(0)):
            s, _ = tk.shingles(*tk.words(raw, off), k)
            for r, at in enumerate(_places(s)):
                total[r] += np.bincount(at, minlength=total.shape[1]).astype(np.uint32)
    parts = total.reshape(-1, ORDER_PART)
    n = len(parts)
    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId() % 32] * n, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "salt", "n"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in table["n"].to_pylist())
    total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pa.table({"part": table["part"].slice(0, 1), "salt": table["salt"].slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})


def shingle_order(texts: DataFrame, k: int) -> np.ndarray:
    """Counters (2 x 2^ORDER_BITS) of the shingles of column ``text``."""
    kind = "part int, salt int, n binary"
    parts = texts.select("text").mapInArrow(partial(_counters, k=k), kind)
    parts = parts.groupBy("part", "salt").applyInArrow(_added, kind).groupBy("part").applyInArrow(_added, kind)
    out = np.zeros((2, 1 << ORDER_BITS), np.uint32)
    for r in parts.collect():  # as many rows as parts, 4 MB
        out.reshape(-1, ORDER_PART)[r["part"]] = np.frombuffer(r["n"], np.uint32)
    return out


#: n and pos as long: the length test of ``_may_overlap`` multiplies them.
PREFIX = "shingle long, node long, comp long, n long, pos long, indexed boolean"


def _may_overlap(threshold: int) -> str:
    """The condition that sets a (the shorter or equal) and b, which share the
    shingles at a.pos and b.pos, can still reach the threshold."""
    need = f"100 * (1 + least(a.n - a.pos - 1, b.n - b.pos - 1)) * {100 + threshold} >= {100 * threshold} * (a.n + b.n)"
    return f"100 * a.n >= {threshold} * b.n and {need}"


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, threshold: int, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, comp, text) to a row for each shingle of the probing prefix.

    With t the threshold: a set of L shingles probes with its first
    L - ceil(t L) + 1 and is found, by sets at least as long, through its first
    L - ceil(2t/(1+t) L) + 1.
    """
    for b in batches:
        for i, j, raw, off in tk.blocks(b.column(2)):
            s, first = tk.shingles(*tk.words(raw, off), k)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            a, c = _places(s)
            o = np.lexsort((s, np.minimum(order[0][a], order[1][c]), row))
            s = s[o]
            pos = np.arange(len(s)) - np.repeat(first[:-1], n)
            probe = n - -(-threshold * n // 100) + 1
            index = n - -(-2 * threshold * n // (100 + threshold)) + 1
            on = pos < probe[row]
            r = row[on]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s[on].view(np.int64)),
                    b.column(0).slice(i, j - i).take(pa.array(r)),
                    b.column(1).slice(i, j - i).take(pa.array(r)),
                    pa.array(n[r].astype(np.int64)),
                    pa.array(pos[on].astype(np.int64)),
                    pa.array(pos[on] < index[r]),
                ],
                ["shingle", "node", "comp", "n", "pos", "indexed"],
            )


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, th) to (node, text): the text of one document of each node."""
    size = nodes.count()
    rows = docs.select(F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    small = F.broadcast(nodes) if size <= BROADCAST_NODES else nodes
    found = rows.join(small, "th").select("node", "text")
    return found.groupBy("node").agg(F.min("text").alias("text"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 75, bands: int = 32, rows: int = 4, screen: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows, roots).  rows: doc_id, th, n_shingles, node for each row of
    ``docs``; roots: node, root for nodes linked with another.  Both are written tables."""
    ship(docs.sparkSession)
    with arrow_bytes(docs.sparkSession, ARROW_BYTES):
        return _near_links(docs, id_col, text_col, k, threshold, bands, rows, screen)


def _near_links(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int, bands: int, rows: int, screen: float) -> tuple[DataFrame, DataFrame]:
    t = bands * rows
    one = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    kind = one.schema["doc_id"].dataType
    sk = stash(one.mapInArrow(partial(_sketches, k=k, bands=bands, rows=rows), T.StructType([T.StructField("doc_id", kind), T.StructField("th", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])), "near-sketches")
    members = sk.select("doc_id", "th", "n_shingles", "node")
    # One row a class; a class with several texts keeps any one of them (their sets are equal).
    classes = sk.where("node is not null").dropDuplicates(["node"]).select("node", "th", "bands", "sig")
    band = classes.select("node", F.explode("bands").alias("key"))
    held = band.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = stash(band.join(held, "key"), "near-shared")
    # the most central node of a bucket leads it: the one that meets most others in all its buckets
    score = stash(shared.groupBy("node").agg(F.sum("c").alias("score")), "near-scores")
    ranked = shared.join(score, "node").select("key", "node", "score")
    lead = stash(ranked.groupBy("key").agg(F.max(F.struct("score", "node")).alias("leader")).select("key", F.col("leader.node").alias("leader")), "near-leaders")
    buckets = stash(shared.select("key", "node").join(lead, "key"), "near-buckets")
    sigs = stash(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "th", "sig"), "near-sigs")

    def confirmed(pairs: DataFrame, source: DataFrame, name: str) -> DataFrame:
        a = sigs.select(F.col("node").alias("u"), F.col("sig").alias("su"))
        b = sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv"))
        close = pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(partial(_screened, t=t, screen=screen), "u long, v long")
        x = source.select(F.col("node").alias("u"), F.col("text").alias("tu"))
        y = source.select(F.col("node").alias("v"), F.col("text").alias("tv"))
        full = close.join(x, "u").join(y, "v").select("u", "v", "tu", "tv")
        return stash(full.mapInArrow(partial(_verified, k=k, threshold=threshold), "u long, v long"), name)

    texts = stash(_texts(docs, sigs.select("node", "th"), text_col), "near-texts")
    stars = buckets.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    links = confirmed(stars, texts, "near-stars")
    roots = stash(components(links), "near-roots")

    # Buckets that are not one component: their nodes, each with its component.
    comp = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = comp.join(mixed, "key", "left_semi").select("node", "comp").distinct()
    rest = stash(texts.join(rest, "node").select("node", "comp", "text"), "near-rest")
    order = shingle_order(rest, k)
    pre = rest.mapInArrow(partial(_prefixes, k=k, threshold=threshold, order=order), PREFIX)
    pre = stash(pre, "near-prefixes")
    a, b = pre.where("indexed").alias("a"), pre.alias("b")
    cand = a.join(b, F.expr(f"a.shingle = b.shingle and a.comp <> b.comp and (a.n < b.n or (a.n = b.n and a.node <> b.node)) and {_may_overlap(threshold)}"))
    cand = cand.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    more = confirmed(cand, texts, "near-more")
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)
    return members, stash(components(edges), "near-components")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    kept: the row with the smallest id of its component (of rows with equal
    ids all, the id being the name of the component).
    """
    members, roots = near_links(docs, id_col, text_col, **kw)
    ids = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    # written, so that the joins' sides are plain exchanges: then a component or a
    # text with very many documents is split over tasks
    ids = stash(ids.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "near-ids")
    name = stash(ids.groupBy("root").agg(F.min("low").alias("component_id")), "near-names")
    named = stash(ids.join(name, "root").select("node", "component_id"), "near-named")
    out = members.join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "th")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each group, with all its columns: the one with the
    smallest id.  Of rows equal in id and text, the first by their columns'
    JSON text; rows without words all stay."""
    rows = stash(near_dedup(docs, id_col, text_col, **kw), "near-rows")
    left = without(docs, rows.where("not kept").select("doc_id", "th"), id_col, text_col)
    # rows that share the id of their group: one text of it, and one row of that
    same = rows.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("th")).where("n > 1")
    if same.isEmpty():
        return left
    same = stash(same.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")), "near-same")
    every = rows.where("kept and n_shingles > 0").select("doc_id", "th").join(same, F.col("doc_id").eqNullSafe(F.col("s_id"))).select("doc_id", "th")
    rest = without(left, every, id_col, text_col)
    keyed = left.select(packed(left), quoted(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"))
    one = keyed.join(same, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")))
    one = one.groupBy("s_id", "s_th").agg(F.min_by("row", F.to_json("row")).alias("row")).select(*unpacked(docs.columns))
    return rest.unionByName(one)
