"""Whitening against a plain eigendecomposition, and on small tables."""

from __future__ import annotations

import math
import os
from fractions import Fraction

import numpy as np
import pytest

from sievewright.llm.queries import QUERIES
from sievewright.llm.whitening import lanczos, orthonormal, whitened
from tests.oracle import SF

KIND = "vec_id long, embedding array<float>, label int, n int, whitened string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], KIND).repartition(3)


def plain(rows):
    """Usable (id, vector) rows, exact deviations, covariance, projections of each row on all eigenvectors, eigenvalues."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    mid = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s, strict=True)] for v in x])
    e, u = np.linalg.eigh(mid.T @ mid / n)
    return rows, dev, mid, e[::-1], u[:, ::-1]


def held(got, rows, k):
    """All rows of the result against the plain way; eigenvectors by their invariants, as signs and copies are free."""
    kept, dev, mid, e, u = plain(rows)
    n = len(kept)
    on = e[:k] > 1e-12 * e[0]
    e = e[:k][on]
    assert len(got) == n * len(e)
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, len(e) + 1))
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted((i, d) for (i, _), d in zip(kept, dev, strict=True))
    trace = sum(dev) / n**3
    for r in got:
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-9
    return kept, mid, e, u


def test_query(spark):
    if not os.path.exists(SF):
        pytest.skip("no test tables")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    kept, mid, e, u = held(got, rows, 32)
    want = {(i, c + 1): abs(z) for (i, _), row in zip(kept, mid @ u[:, : len(e)] / np.sqrt(e), strict=True) for c, z in enumerate(row)}
    for r in got:
        assert abs(r["whitened"]) == pytest.approx(want[r["vec_id"], r["component"]], abs=1e-8)


def test_bad_vectors_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(1, 61)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # repeated and null ids
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [1.0, float("nan"), 1.0, 1.0, 1.0]), (94, [float("inf")] * 5), (95, [1.0, 2.0]), (96, [1.0] * 9)]
    got = whitened(table(spark, rows + bad)).collect()
    ids = [r["vec_id"] for r in got if r["component"] == 1]
    assert len(ids) == 63 and ids.count(7) == 3 and ids.count(None) == 1 and max(i or 0 for i in ids) == 60
    held([{**r.asDict(), "vec_id": r["vec_id"] or -1} for r in got], [(i or -1, v) for i, v in rows], 32)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        got = whitened(table(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_low_rank_and_equal_eigenvalues(spark):
    """Rank 2 of 6 gives two components; equal eigenvalues are all found."""
    base = np.array([[1, 2, 0, 0, 1, 0], [0, 1, 3, 0, 0, 1]], float)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 2) @ base).tolist()) for i in range(50)]
    held(whitened(table(spark, rows)).collect(), rows, 32)
    cube = [(i, [float(i >> j & 1) for j in range(4)]) for i in range(16)]
    got = whitened(table(spark, cube)).collect()
    held(got, cube, 32)
    assert {round(r["explained"], 12) for r in got} == {0.25}


def test_large_entries(spark):
    """Deviations stay exact where longs would not do on the way; beyond a long they are null."""
    rows = [(1, [3e4, 500.0]), (2, [-3e4, 250.25]), (3, [2.9e4, 0.0])]
    held(whitened(table(spark, rows)).collect(), rows, 2)
    got = whitened(table(spark, [(1, [1e13, 0.0]), (2, [-1e13, 5.0]), (3, [0.0, 9.0])])).collect()
    assert got and all(r["deviation"] is None for r in got if r["vec_id"] != 3)


def test_lanczos_stops_early_restarts_and_finds_copies():
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    for values, k, most in ((np.r_[2.0 ** -np.arange(40), np.full(260, 1e-13)], 8, 120), (np.r_[np.full(6, 3.0), np.zeros(294)], 6, 300), (np.r_[np.full(5, 3.0), np.full(5, 2.0), np.full(290, 1.0)], 10, 300)):
        v, asked = (u * values) @ u.T, []
        e, y = lanczos(lambda q, v=v, asked=asked: (asked.append(q.shape[1]), v @ q)[1], 300, k)
        assert np.allclose(e, values[:k], atol=1e-12) and np.abs(v @ y - y * e).max() < 1e-11 and np.abs(y.T @ y - np.eye(k)).max() < 1e-10
        assert sum(asked) <= most


def test_orthonormal_replaces_what_vanishes():
    rng = np.random.default_rng(4)
    basis = np.eye(6)[:, :2]
    out = orthonormal(np.column_stack([np.eye(6)[:, 0], np.eye(6)[:, 2], np.eye(6)[:, 2]]), basis, 1e-10, rng)
    assert out.shape == (6, 3) and np.allclose(out.T @ out, np.eye(3)) and np.allclose(basis.T @ out, 0)
    assert orthonormal(np.ones((6, 4)), np.eye(6)[:, :5], 1e-10, rng).shape == (6, 1)
