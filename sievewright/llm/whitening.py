"""Whitening of embeddings: the leading components of their covariance by block Lanczos.

Entries become whole numbers x = floor(64 * c) + 1000000, so counts, sums and
squared deviations are exact.  The covariance V is never formed.  A pass over
the vectors multiplies it with a block of directions, V Q = mean of
(x - mean) ((x - mean)' Q), centred before multiplying; each task adds up its
own rows and Spark adds up the tasks by dimension.  The driver holds only
matrices of the vectors' length by the number of directions.

Each new block is what the last product leaves after it has been made
orthogonal, twice, to *all* directions so far.  A direction that vanishes (the
space is invariant: a breakdown) is replaced by a fresh random one, so equal
eigenvalues are found again after a restart.  A block has as many directions as
components are asked for, so it can hold all copies of an eigenvalue that are
asked for.  It ends when the residuals |V y - e y| of all leading pairs are
below ``tolerance`` times the largest eigenvalue, or when the directions span
the whole space; the products are kept, so the residuals cost no pass.

The vectors are read once, written as blocks of whole numbers, and every pass
reads those.

Defined cases: a null vector, one with a null or non-finite entry and an empty
one are left out; so are vectors of another length than the most common one
(of several equally common, the longest); repeated rows, null and repeated ids
count and are returned like any other; an empty table, a single vector and
equal vectors have no component and give no rows; components whose eigenvalue
is no more than ``rank_tolerance`` of the largest are noise and left out; an entry
beyond 2^46 is taken as 2^46; a deviation beyond a long is null; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.shipping import ship

from .common import quoted, stash

SCALE, SHIFT = 64, 1_000_000
#: Largest entry that is told from others; 64 times it is exact as a double and as a long.
LARGEST = float(1 << 46)
#: Numbers in a block (8 bytes each while it is worked on).
BLOCK_ENTRIES = 1 << 20


def whole(c: np.ndarray) -> np.ndarray:
    """x of each entry."""
    return np.floor(np.clip(c.astype(np.float64), -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to blocks (dim, n, ids, x) of vectors of one length; vectors with a null or non-finite entry are left out."""
    for b in batches:
        ids, col = b.column(0), b.column(1)
        size = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
        flat = col.flatten()  # without what null rows hide
        values = np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64)
        begin = np.append(0, np.cumsum(size))
        bad = np.append(0, np.cumsum(~np.isfinite(values)))
        fine = (size > 0) & (bad[begin[1:]] == bad[begin[:-1]])
        for d in np.unique(size[fine]).tolist():
            rows = np.flatnonzero(fine & (size == d))
            for part in np.array_split(rows, -(-len(rows) * d // BLOCK_ENTRIES)):
                x = whole(values[begin[part][:, None] + np.arange(d)]) - SHIFT
                narrow = np.abs(x).max() < 2**31
                data = x.astype(np.int32 if narrow else np.int64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([4 if narrow else 8], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.take(pa.array(part))), pa.array([data], pa.binary())],
                    ["dim", "n", "width", "ids", "x"],
                )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each block: its batch, its row in it, its x as a matrix of longs."""
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            width, n = b.column(names.index("width"))[i].as_py(), b.column(names.index("n"))[i].as_py()
            raw = np.frombuffer(b.column(names.index("x"))[i].as_buffer(), np.int32 if width == 4 else np.int64)
            yield b, i, raw.reshape(n, -1).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to (i, s): each task's sum of each dimension."""
    s = None
    for _, _, x in _matrices(batches):
        s = x.sum(0) if s is None else s + x.sum(0)
    if s is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["i", "s"])


@dataclass(frozen=True)
class Centre:
    """n vectors with the sums s of each dimension."""

    n: int
    s: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - s/n: the whole part of the mean is taken off exactly."""
        base = np.array([v // self.n for v in self.s], np.int64)
        rest = np.array([(v % self.n) / self.n for v in self.s])
        return (x - base).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - s)^2 of each row, exact."""
        base = np.array([v // self.n for v in self.s], np.int64)
        most = self.n * (int(np.abs(x - base).max(initial=0)) + 1)
        if x.shape[1] * most * most < 1 << 63:
            off = (x - base) * self.n - np.array([v % self.n for v in self.s], np.int64)
            return (off * off).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.s, strict=True)) for row in x.tolist()]


def _summed(batches: Iterator[pa.RecordBatch], centre: Centre, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks to (i, y): each task's sum of (x - mean) ((x - mean)' q)."""
    total = None
    for _, _, x in _matrices(batches):
        c = centre.centred(x)
        total = c.T @ (c @ q) if total is None else total + c.T @ (c @ q)
    yield from _rows(total)


def _products(batches: Iterator[pa.RecordBatch], centre: Centre, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks to (i, y): each task's sum of z z', z the projections of x - mean on ``axes``."""
    total = None
    for _, _, x in _matrices(batches):
        z = centre.centred(x) @ axes
        total = z.T @ z if total is None else total + z.T @ z
    yield from _rows(total)


def _rows(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        n, b = total.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * b), pa.array(total.ravel()))], ["i", "y"])


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The tasks' matrices (i, y) added up; the driver gets one row for each i."""
    out = np.zeros(shape)
    for r in parts.groupBy("i").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(shape[1])]).alias("y")).collect():
        out[r["i"]] = r["y"]
    return out


def _deviation_total(batches: Iterator[pa.RecordBatch], centre: Centre) -> Iterator[pa.RecordBatch]:
    total = math.fsum(v for _, _, x in _matrices(batches) for v in centre.deviations(x))
    yield pa.RecordBatch.from_arrays([pa.array([total])], ["dev"])


def orthonormal(new: np.ndarray, basis: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Directions of ``new`` orthogonal to ``basis`` and each other; one shorter than
    ``least`` after that is replaced by a random one.  No more than the space has room for."""
    room = basis.shape[0] - basis.shape[1]
    out = np.zeros((basis.shape[0], 0))
    for j in range(min(new.shape[1], room)):
        v, limit = new[:, j], least
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > limit:
                v = v / size
                # what is left of a short vector is not orthogonal any more to the last digit
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v, limit = rng.standard_normal(basis.shape[0]), 1e-6
    return out


def lanczos(product, dim: int, components: int, tolerance: float = 1e-13, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the symmetric operator ``product``: matrix to matrix."""
    rng = np.random.default_rng(seed)
    block = min(components, dim)
    q = np.zeros((dim, 0))
    w = np.zeros((dim, 0))
    new = orthonormal(rng.standard_normal((dim, block)), q, 1e-6, rng)
    while True:
        image = product(new)
        q, w = np.column_stack([q, new]), np.column_stack([w, image])
        t = q.T @ w
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = e[::-1][:block], s[:, ::-1][:, :block]
        y = q @ s
        left = np.linalg.norm(w @ s - y * e, axis=0)
        scale = max(float(e[0]), 0.0)
        if q.shape[1] == dim or (left <= tolerance * scale).all() and scale > 0:
            return e, y / np.linalg.norm(y, axis=0)
        new = orthonormal(image, q, 1e-10 * max(scale, 1e-300), rng)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``blocks`` holds the vectors it was fitted on."""

    blocks: DataFrame
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, tolerance: float = 1e-13, rank_tolerance: float = 1e-12) -> Whitening | None:
    """Fits on all usable rows; None where no component is there."""
    ship(vectors.sparkSession)
    rows = vectors.select(quoted(id_col).alias("id"), quoted(vector_col).cast("array<double>").alias("v")).where("v is not null")
    kind = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("x", T.BinaryType())])
    blocks = stash(rows.mapInArrow(_blocks, kind), "vectors")
    sizes = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    blocks = blocks.where(F.col("dim") == dim)
    s = {r["i"]: r["s"] for r in blocks.mapInArrow(_sums, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    centre = Centre(n, tuple(s[i] for i in range(dim)))
    total = blocks.mapInArrow(partial(_deviation_total, centre=centre), "dev double").agg(F.sum("dev")).first()[0]
    if total == 0:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        return _added(blocks.mapInArrow(partial(_summed, centre=centre, q=q), "i int, y array<double>"), q.shape) / n

    e, y = lanczos(product, dim, components, tolerance)
    on = e > rank_tolerance * e[0]
    e, y = e[on], y[:, on]
    cov = _added(blocks.mapInArrow(partial(_products, centre=centre, axes=y / np.sqrt(e)), "i int, y array<double>"), (len(e), len(e))) / n
    return Whitening(blocks, centre, e, y, total / float(n) ** 3, float(np.abs(cov - np.eye(len(e))).max()))


def _whitened(batches: Iterator[pa.RecordBatch], centre: Centre, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b, i, x in _matrices(batches):
        z = centre.centred(x) @ axes
        dev = pa.array([v if v < 1 << 63 else None for v in centre.deviations(x)], pa.int64())
        ids = b.column(b.schema.names.index("ids"))[i].values
        yield pa.RecordBatch.from_arrays([ids, dev, pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))], ["id", "deviation", "whitened"])


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, **kw) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error (as of the whole fit)."""
    fit = fit_whitening(vectors, id_col, vector_col, components, **kw)
    kind = vectors.select(quoted(id_col)).schema[0].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if fit is None:
        rows, n, shares, error = vectors.sparkSession.createDataFrame([], schema), 0, [0.0], 0.0
    else:
        rows = fit.blocks.mapInArrow(partial(_whitened, centre=fit.centre, axes=fit.vectors / np.sqrt(fit.values)), schema)
        n, shares, error = fit.centre.n, (fit.values / fit.trace).tolist(), fit.identity_error
    rows = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("component", "z"))
    return rows.select(
        "vec_id",
        (F.col("component") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("z").alias("whitened"),
        F.array(*[F.lit(x) for x in shares])[F.col("component")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
