"""Operator 12: whitening of embeddings by a bidiagonal qd solver.

The components are the eigenvectors of the covariance V of the fit list, found without
forming V, which would square the condition:

1. Spark takes the distinct vectors and their exact sums; blocks of centred rows are reduced
   to triangles by QR, block under block within a task, triangles under triangles between
   tasks, in as many rounds as it takes. What is left is R, with V = R' R / n.
2. Householder reflections make R bidiagonal: R = Q B P'.
3. dqds (quotient-difference steps with shifts) finds the singular values of B to high
   relative accuracy; e = s * s / n.
4. A twisted factorisation of B' B - s * s, stationary from the top, progressive from the
   bottom and joined where the twist is least, gives each right singular vector of B, which
   P turns into a component. Vectors of values that lie close together are made orthogonal.

Vectors become whole numbers ``floor(SCALE * c)`` first, so sums and deviations are exact.

Defined cases: vectors that are null, have null or non-finite entries, or entries beyond 64
bits once scaled, are dropped. Every length of vector is fitted and whitened by itself. Ids
play no part; repeated rows each get their rows, and count once in the fit. Components
without variance (fewer distinct vectors than components, constant entries) are left out;
a vector of length 0 has none. A deviation beyond 64 bits is null. Of no rows come none;
other columns do not matter. A worker holds a block of vectors and a triangle of d x d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import pick, saved, table

SCALE = 256
COMPONENTS = 4
FAN_IN = 16  # triangles that one task puts under each other
BLOCK_NUMBERS = 1 << 18  # numbers in a block of rows, 2 MB

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


# --- dense steps, on one d x d triangle ----------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and P, for R = Q B P' by Householder reflections."""
    n = r.shape[1]
    a = np.vstack([r, np.zeros((max(0, n - len(r)), n))])  # square, also with few rows
    p = np.eye(n)
    for i in range(n):
        v, beta = _reflector(a[i:, i])
        a[i:, i:] -= beta * np.outer(v, v @ a[i:, i:])
        if i < n - 2:
            v, beta = _reflector(a[i, i + 1 :])
            a[i:, i + 1 :] -= beta * np.outer(a[i:, i + 1 :] @ v, v)
            p[:, i + 1 :] -= beta * np.outer(p[:, i + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    v = x.copy()
    size = np.abs(v).max(initial=0.0)
    if len(v) < 2 or size == 0 or not np.abs(v[1:]).max():
        return np.zeros_like(v), 0.0
    v /= size
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v, 2.0 / (v @ v)


def singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Of a bidiagonal matrix, descending, by dqds."""
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if size == 0:
        return np.zeros(len(diagonal))
    q, e = np.square(diagonal / size), np.square(upper / size)
    found: list[float] = []
    stack = [(q, e, 0.0)]
    while stack:
        q, e, shift = stack.pop()
        while len(q) > 2:
            if e[-1] <= _EPS**2 * max(shift + q[-1], _TINY):
                found.append(shift + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = np.flatnonzero(e[:-1] <= _EPS**2 * np.maximum(np.minimum(q[:-2], q[1:-1]), _TINY))
            if len(cut):
                stack.append((q[: cut[-1] + 1], e[: cut[-1]], shift))
                q, e = q[cut[-1] + 1 :], e[cut[-1] + 1 :]
                continue
            if q[0] < q[-1]:  # small values are found at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            q, e, shift = _step(q, e, shift)
        if len(q) == 2:
            half, mean = (q[0] + e[0] - q[1]) / 2, (q[0] + e[0] + q[1]) / 2
            high = mean + np.hypot(half, np.sqrt(q[1] * e[0]))
            found += [shift + high, shift + (q[0] * (q[1] / high) if high > 0 else 0.0)]
        else:
            found += [shift + x for x in q]
    return size * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One dqds step; the shift is a lower bound of the least value, made smaller when a
    step shows that it was none."""
    tau = _least(q, e)
    while True:
        done = _dqds(q, e, tau)
        if done is not None:
            return *done, shift + tau
        tau = tau / 4 if tau > _TINY else 0.0


def _least(q: np.ndarray, e: np.ndarray) -> float:
    """A guess at the least value from below, from the last 2 x 2 block of B' B."""
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), np.sqrt(q[-2] * e[-1]), q[-1] + e[-1]
    low = (a + c) / 2 - np.hypot((a - c) / 2, b)
    return max(0.0, 0.98 * min(low, _unshifted(q, e)))


def _unshifted(q: np.ndarray, e: np.ndarray) -> float:
    """The least d of a step without a shift: an upper bound of the least value."""
    d = low = q[0]
    for i in range(len(e)):
        x = d + e[i]
        d = q[i + 1] * (d / x) if x > 0 else q[i + 1]
        low = min(low, d)
    return low


def _dqds(q: np.ndarray, e: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray] | None:
    qq, ee = np.empty_like(q), np.empty_like(e)
    d = q[0] - tau
    for i in range(len(e)):
        if d < 0:
            return None
        qq[i] = d + e[i]
        if qq[i] <= 0:
            ee[i], d = 0.0, q[i + 1] - tau
            continue
        ratio = q[i + 1] / qq[i]
        ee[i] = e[i] * ratio
        d = d * ratio - tau
    if d < 0:
        return None
    qq[-1] = d
    return qq, ee


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: a right singular vector of B for each of the values, the largest ones."""
    size = np.abs(diagonal).max(initial=0.0) or 1.0
    d, u = diagonal / size, upper / size
    out: list[np.ndarray] = []
    for k, value in enumerate(values / size):
        near = [z for z, other in zip(out, values / size) if other * other - value * value <= 1e-6 * values[0] ** 2 / size**2]
        best, worst = None, np.inf
        for twist in _twists(d, u, value * value):
            z = _twisted(d, u, value * value, twist)
            for _ in range(3):
                for other in near:
                    z = z - (other @ z) * other
                length = np.linalg.norm(z)
                if length < 1e-3:  # nothing new at this twist
                    break
                z /= length
            if length < 1e-3:
                continue
            error = np.linalg.norm(_times(d, u, z) - value * value * z)
            if error < worst:
                best, worst = z, error
            if worst <= 64 * _EPS * len(d):
                break
        out.append(best)
    return np.array(out).T.reshape(len(d), len(values))


def _times(d: np.ndarray, u: np.ndarray, z: np.ndarray) -> np.ndarray:
    """B' B z."""
    y = d * z
    y[:-1] += u * z[1:]
    out = d * y
    out[1:] += u * y[:-1]
    return out


def _pivots(d: np.ndarray, u: np.ndarray, square: float) -> tuple[np.ndarray, ...]:
    """The two factorisations of T = B' B - square: L+ D+ L+' from the top (multipliers
    ``low``) and U- D- U-' from the bottom (``high``), and the twist at every place."""
    n = len(d)
    dd, ud, uu = d * d, u * d[:-1], u * u
    top, bottom, low, high = np.empty(n), np.empty(n), np.zeros(n), np.zeros(n)
    s = -square  # stationary: what the shift leaves of each pivot
    for i in range(n):
        top[i] = s + dd[i]
        if i < n - 1:
            pivot = top[i] if abs(top[i]) > _TINY else _TINY
            low[i] = ud[i] / pivot
            s = (s / pivot) * uu[i] - square if uu[i] else -square
    stationary = top - dd
    p = dd[-1] - square  # progressive, from the end
    progressive = np.empty(n)
    progressive[-1] = p
    for i in range(n - 2, -1, -1):
        bottom[i + 1] = uu[i] + p
        pivot = bottom[i + 1] if abs(bottom[i + 1]) > _TINY else _TINY
        high[i] = ud[i] / pivot
        p = (p / pivot) * dd[i] - square
        progressive[i] = p
    return stationary + progressive + square, low, high


def _twists(d: np.ndarray, u: np.ndarray, square: float) -> np.ndarray:
    """Places to join the factorisations at, the best first."""
    gamma, _, _ = _pivots(d, u, square)
    return np.argsort(np.abs(np.nan_to_num(gamma, nan=np.inf)), kind="stable")


def _twisted(d: np.ndarray, u: np.ndarray, square: float, r: int) -> np.ndarray:
    _, low, high = _pivots(d, u, square)
    z = np.zeros(len(d))
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(r, len(d) - 1):
        z[i + 1] = -high[i] * z[i]
    size = np.abs(z).max()
    if not np.isfinite(size):
        return np.eye(len(d))[r]
    z /= size
    return z / np.linalg.norm(z)


def components(r: np.ndarray, n: int, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues above zero, descending, at most ``count``; their vectors as columns; and
    the trace of V = R' R / n."""
    d, u, p = bidiagonal(r)
    values = singular_values(d, u)
    trace = float(np.square(values).sum()) / n
    noise = _EPS * max(r.shape) * (values[0] if len(values) else 0.0)
    kept = values[:count][values[:count] > noise]
    if not len(kept):
        return np.zeros(0), np.zeros((r.shape[1], 0)), trace
    vectors = p @ right_vectors(d, u, kept)
    return np.square(kept) / n, vectors, trace


# --- Spark ---------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, x of the rows whose vectors can be used."""
    rows = pick(vectors, "vec_id", "embedding").where(F.col("embedding").isNotNull())
    scaled = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    limit = 2.0**63 / scale

    def fine(c: Column) -> Column:  # NaN is greater than any number to Spark
        return c.isNotNull() & (c.cast("double") >= -limit) & (c.cast("double") < limit)

    rows = rows.where(F.forall("embedding", fine))
    return rows.select("vec_id", F.size("embedding").alias("dim"), scaled.cast("array<long>").alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _blocks(batches: Iterator[pa.RecordBatch], *others: str) -> Iterator[tuple]:
    """The rows of each length of vector in a batch, some at a time: dim, matrix, others."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            step = max(1, BLOCK_NUMBERS // max(1, int(dim)))
            for i in range(0, len(rows), step):
                part = batch.take(pa.array(rows[i : i + step]))
                yield int(dim), _matrix(part.column("x"), int(dim)), *(part.column(c) for c in others)


def exact_sums(fit: DataFrame) -> DataFrame:
    """dim, n, sums (decimals, by place) of the fit list."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x in _blocks(batches):
            # halves of 32 bits, so that a block's sums fit whatever the numbers
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (high.tolist(), low.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(x)], pa.int64()), *lists], names=["dim", "n", "high", "low"])

    parts = fit.mapInArrow(add, "dim int, n long, high array<long>, low array<long>")
    counts = parts.groupBy("dim").agg(F.sum("n").alias("n"))
    places = parts.select("dim", F.posexplode(F.arrays_zip("high", "low")).alias("place", "halves"))
    total = F.sum(F.col("halves.high").cast("decimal(38,0)") * 4294967296 + F.col("halves.low"))
    sums = places.groupBy("dim", "place").agg(total.cast("decimal(38,0)").alias("s"))
    sums = sums.groupBy("dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "s"))), lambda p: p.s).alias("sums"))
    return counts.where("dim > 0").join(sums, "dim")


def triangles(fit: DataFrame, sums: DataFrame) -> DataFrame:
    """dim, n, sums, r: the triangle of all centred rows of each length of vector."""
    schema = "dim int, r binary"

    def packed(dim: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["dim", "r"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for dim, x, n, total in _blocks(batches, "n", "sums"):
            y = x - _means(n[0].as_py(), total[0].as_py())
            if held is not None and held[0] != dim:
                yield packed(*held)
                held = None
            held = dim, np.linalg.qr(y if held is None else np.vstack([held[1], y]), mode="r")
        if held is not None:
            yield packed(*held)

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        dim = 0
        for batch in batches:
            for d, data in zip(batch.column("dim").to_pylist(), batch.column("r")):
                part = np.frombuffer(data.as_buffer(), float).reshape(-1, d)
                dim, r = d, np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
        yield packed(dim, r)

    def many(frame: DataFrame) -> int:
        return frame.groupBy("dim").count().agg(F.max("count")).first()[0] or 0

    # one length after the other within a task keeps one triangle at a time
    rows = fit.sortWithinPartitions("dim") if fit.select("dim").distinct().limit(2).count() > 1 else fit
    parts = saved(rows.join(sums, "dim").mapInArrow(reduce_rows, schema), "whitening-r")
    while (count := many(parts)) > 1:
        lots = -(-count // FAN_IN)
        dealt = parts.withColumn("lot", F.pmod(F.monotonically_increasing_id(), F.lit(lots)))
        parts = saved(dealt.groupBy("dim", "lot").applyInArrow(_whole(stack), schema), "whitening-r")
    return sums.join(parts, "dim")


def _whole(function):
    """A function of batches as one of the group's table."""

    def apply(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(function(iter(group.to_batches()))))

    return apply


def _means(n: int, sums: list) -> np.ndarray:
    return np.array([int(s) // n + (int(s) % n) / n for s in sums])


def fit(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row for each length of vector: dim, n, sums, values (e), axes (component after
    component), trace."""
    listed = saved(vectors.select("dim", "x").distinct(), "whitening-fit")
    sums = saved(exact_sums(listed), "whitening-sums")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, axes, traces = [], [], []
            for dim, n, data in zip(batch.column("dim").to_pylist(), batch.column("n").to_pylist(), batch.column("r")):
                e, v, trace = components(np.frombuffer(data.as_buffer(), float).reshape(-1, dim), n, count)
                values.append(e.tolist())
                axes.append(v.T.ravel().tolist())
                traces.append(trace)
            lists = [pa.array(c, pa.list_(pa.float64())) for c in (values, axes)]
            out = [batch.column("dim"), batch.column("n"), batch.column("sums"), *lists, pa.array(traces, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["dim", "n", "sums", "values", "axes", "trace"])

    schema = "dim int, n long, sums array<decimal(38,0)>, values array<double>, axes array<double>, trace double"
    model = saved(triangles(listed, sums).mapInArrow(solve, schema), "whitening-model")
    return model.join(_errors(listed, model), "dim", "left")


def _project(x: np.ndarray, n: int, sums: list, values: list, axes: list) -> np.ndarray:
    """Whitened rows, one column for each component."""
    e = np.array(values)
    return (x - _means(n, sums)) @ np.array(axes).reshape(len(e), x.shape[1]).T / np.sqrt(e)


_MODEL = ("n", "sums", "values", "axes")


def _errors(listed: DataFrame, model: DataFrame) -> DataFrame:
    """dim, identity_error: how far the covariance of the whitened fit list is from the
    identity, measured over all of it."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, *of in _blocks(batches, *_MODEL):
            w = _project(x, *(c[0].as_py() for c in of))
            k = w.shape[1]
            pairs = [(a, b, float(w[:, a] @ w[:, b])) for a in range(k) for b in range(a, k)] + [(a, -1, float(w[:, a].sum())) for a in range(k)]
            columns = [pa.array([dim] * len(pairs), pa.int32()), *(pa.array(c) for c in zip(*pairs))] if pairs else None
            if columns:
                columns[1:3] = [c.cast(pa.int32()) for c in columns[1:3]]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "a", "b", "m"])

    rows = listed.join(model.select("dim", *_MODEL), "dim").mapInArrow(moments, "dim int, a int, b int, m double")
    sums = rows.groupBy("dim", "a", "b").agg(F.sum("m").alias("m")).join(model.select("dim", "n"), "dim")
    mean = sums.where("b = -1").select("dim", F.col("a").alias("i"), (F.col("m") / F.col("n")).alias("mean"))
    pairs = sums.where("b >= 0")
    pairs = pairs.join(mean.withColumnsRenamed({"i": "a", "mean": "one"}), ["dim", "a"]).join(mean.withColumnsRenamed({"i": "b", "mean": "other"}), ["dim", "b"])
    entry = F.col("m") / F.col("n") - F.col("one") * F.col("other") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    return pairs.groupBy("dim").agg(F.max(F.abs(entry)).alias("identity_error"))


def whiten(vectors: DataFrame, count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(vectors, scale)
    model = saved(fit(rows, count), "whitening-model")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, ids, *of, trace, error in _blocks(batches, "vec_id", *_MODEL, "trace", "identity_error"):
            n, sums, values, axes = (c[0].as_py() for c in of)
            k = len(values)
            w = _project(x, n, sums, values, axes)
            far = pa.array(_deviations(x, n, sums), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                ids.take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)),
                far.take(each),
                pa.array(w.ravel()),
                pa.array(np.tile(np.array(values) / trace[0].as_py() if k else np.zeros(0), len(x))),
                error.take(each),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.join(model, "dim").mapInArrow(project, schema)


def _deviations(x: np.ndarray, n: int, sums: list) -> list[int | None]:
    """Sum of (n * x - S)^2 for each row, exact; None beyond 64 bits."""
    s = [int(v) for v in sums]
    reach = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, s))
    if reach * reach * len(s) < 2**63:
        y = n * x - np.array(s, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(s, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


SQL = None  # eigenvectors
