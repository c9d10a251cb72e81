import math

import numpy as np
import pytest

from loglantern.llm import whitening


def brute_force(rows, count=4):
    """Per vec_id and component: n, deviation, |whitened|, explained; by one dense eigh for
    each length of vector."""
    kept = []
    for i, e in rows:
        if e is not None and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**62 for c in e):
            kept.append((i, [math.floor(256 * float(c)) for c in e]))
    out = []
    for dim in {len(x) for _, x in kept} - {0}:
        mine = [(i, x) for i, x in kept if len(x) == dim]
        fit = sorted({tuple(x) for _, x in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
        v = centred.T @ centred / n
        e, vectors = np.linalg.eigh(v)
        e, vectors = e[::-1], vectors[:, ::-1]
        for i, x in mine:
            far = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            y = np.array([(n * c - s) / n for c, s in zip(x, sums)])
            for k in range(min(count, dim)):
                if e[k] > 1e-12 * e[0] and e[0] > 0:
                    out.append((i, k + 1, n, far if far < 2**63 else None, abs(y @ vectors[:, k]) / math.sqrt(e[k]), e[k] / np.trace(v)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4]))


def check(frame, rows, count=4):
    got = [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in frame.collect()]
    got.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4]))
    want = brute_force(rows, count)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    if want:
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-7, atol=1e-9)


def rows_of(frame):
    return [(r.vec_id, r.embedding) for r in whitening.pick(frame, "vec_id", "embedding").collect()]


def test_small_tables(spark, sf_dir):
    frame = whitening.query(spark, sf_dir)
    check(frame, rows_of(whitening.table(spark, sf_dir, "embeddings")))
    assert {r.identity_error < 1e-10 for r in frame.collect()} == {True}
    signs = {}
    for r in frame.collect():
        signs.setdefault(r.component, []).append(r.whitened)
    assert all(abs(np.mean(w)) < 1e-9 for w in signs.values())  # one sign for all rows


def test_many_triangles(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    frame = whitening.table(spark, sf_dir, "embeddings").repartition(7)
    check(whitening.whiten(frame), rows_of(frame))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    rows += [(7, rows[7][1]), (100, rows[7][1]), (None, rows[3][1]), (None, None), (101, None), (102, []), (103, [nan, 1.0, 1.0]), (104, [inf, 0.0, 0.0])]
    rows += [(105, [None, 1.0, 2.0]), (106, [1e300, 0.0, 0.0]), (107, [2.0**62, 0.0, 0.0])]
    rows += [(200 + i, [float(i), 1.0]) for i in range(9)]  # one entry never changes
    rows += [(300, [1.0, 2.0, 3.0, 4.0]), (301, [1.0, 2.0, 3.0, 4.0])]  # one distinct vector: no variance
    rows += [(400, [-0.0] * 5), (401, [-0.001] * 5), (402, [0.5, -0.5, 0.25, 1e-300, -1e-300])]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, label int, VEC_ID string, x double")
    check(whitening.whiten(frame), rows)
    assert whitening.whiten(frame.where("false")).count() == 0
    assert whitening.whiten(frame.where("embedding IS NULL")).count() == 0


def test_numbers_beyond_64_bits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=4) * 1e9]) for i in range(50)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)
    rows = [(1, [0.0, 3e7]), (2, [2e7, 0.5]), (3, [3e7, 1e7]), (4, [1e7, 1e7])]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)


@pytest.mark.parametrize("kind", ["random", "wide", "graded", "equal", "diagonal", "zero"])
def test_the_solver_against_a_dense_one(kind):
    rng = np.random.default_rng(8)
    rows = {
        "random": lambda: rng.normal(size=(200, 48)),
        "wide": lambda: rng.normal(size=(3, 10)),
        "graded": lambda: rng.normal(size=(200, 30)) * 10.0 ** -np.arange(30),
        "equal": lambda: np.array([[((i >> j) & 1) * 2.0 - 1 if j < 6 else 0.0 for j in range(16)] for i in range(64)]),
        "diagonal": lambda: np.kron(np.eye(12), np.array([[1.0], [-1.0]])),
        "zero": lambda: np.zeros((5, 6)),
    }[kind]()
    centred = rows - rows.mean(axis=0)
    n, r = len(rows), np.linalg.qr(centred, mode="r")
    d, u, p = whitening.bidiagonal(r)
    s, want = whitening.singular_values(d, u), np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(s[: len(want)], want, rtol=0, atol=1e-14 * max(want[0], 1)) and np.allclose(p.T @ p, np.eye(len(p)))
    e, vectors, trace = whitening.components(r, n)
    v = centred.T @ centred / n
    assert np.isclose(trace, np.trace(v)) and np.allclose(vectors.T @ vectors, np.eye(len(e)), atol=1e-12)
    assert np.abs(v @ vectors - vectors * e).max(initial=0) <= 1e-13 * max(e.max(initial=0), 1e-300)
    assert len(e) == min(4, np.linalg.matrix_rank(centred) if kind != "graded" else 4)
