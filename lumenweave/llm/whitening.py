"""Embedding whitening from a compensated covariance.

Every task centres its vectors and sums their outer products in double-double. The
products are made by an error-free transformation: a centred entry is cut into slices
of so few bits that the products of slices, summed over a block of rows, fit a double
exactly; so BLAS sums them without rounding, whatever its order, and only these block
sums are added, high and low part, by two-sum. The high and low parts of the tasks'
sums are merged on the executors, row of the matrix by row. The driver gets one
matrix, whose size is that of the vectors and not of the table, and solves it by
Householder tridiagonalisation and divide and conquer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.session import written

#: Entries are scaled and shifted to integers; a row with an entry of this size or more after it has no exact sums and is dropped.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 45
#: Rows whose products are summed at once, bits of a slice, slices: 2 * BITS + log2(ROWS) is at most 53.
ROWS, BITS, SLICES = 2048, 21, 4
EPS = np.finfo(float).eps


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def outer(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows' outer products, in double-double, of at most :data:`ROWS` rows of high + low."""
    largest = np.abs(high).max(axis=0)
    unit = np.ldexp(1.0, np.frexp(np.where(largest > 0, largest, 1.0))[1])
    slices = []
    for _ in range(SLICES):
        unit = np.ldexp(unit, -BITS)
        part = np.rint(high / unit)
        slices.append((part, unit))
        high, low = two_sum(high - part * unit, low)
    total = (np.zeros((high.shape[1],) * 2), np.zeros((high.shape[1],) * 2))
    for weight in range(SLICES - 1, -1, -1):  # the smallest first
        for i in range(weight + 1):
            (a, ua), (b, ub) = slices[i], slices[weight - i]
            total = dd_add(total, (a.T @ b * ua[:, None] * ub, np.zeros_like(total[0])))
    return total


# divide and conquer


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and q with a = q t q': a symmetric matrix by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm <= EPS * EPS * abs(a).max():
            continue
        x[0] += np.copysign(norm, x[0])
        v = x / np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (d - x)) for rho > 0 and ascending d, as (nearest d's place, distance from it).

    All roots at once, by bisection of the distance from the nearer end of each
    interval: 1,100 halvings would pass any double, and it ends when none moves.
    """
    n = len(d)
    z2 = rho * z * z
    ends = np.append(d[1:], d[-1] + z2.sum() * (1 + 4 * EPS))
    gap = ends - d
    f = lambda base, x: 1 + (z2 / ((d[None, :] - base[:, None]) - x[:, None])).sum(axis=1)
    middle = f(d, gap / 2)
    right = (middle < 0) & (np.arange(n) < n - 1)  # the root lies in the right half
    near = np.arange(n) + right
    base = d[near]
    lo = np.where(right, -gap / 2, np.where((middle < 0), gap / 2, 0.0))
    hi = np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    with np.errstate(divide="ignore"):
        for _ in range(1100):
            # while an end is at the pole, halve its exponent's way by halving the distance
            mid = (lo + hi) / 2
            still = (mid != lo) & (mid != hi)
            if not still.any():
                break
            below = f(base, np.where(still, mid, 1.0)) < 0
            lo, hi = np.where(still & below, mid, lo), np.where(still & ~below, mid, hi)
    return near, np.where(right, lo, hi)


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z'."""
    if rho < 0:
        w, v = _rank_one(-d, z, -rho)
        return -w, v
    order = np.argsort(d, kind="stable")
    d, z, n = d[order], z[order].copy(), len(d)
    turn = np.eye(n)
    small = 8 * EPS * max(np.abs(d).max(), rho * (z @ z))
    # deflation: what z doesn't touch, and one of two equal entries, which a rotation frees of z
    live: list[int] = []
    for i in range(n):
        if rho * abs(z[i]) * np.linalg.norm(z) <= small:
            z[i] = 0
        elif live and d[i] - d[live[-1]] <= small:
            j, r = live[-1], np.hypot(z[live[-1]], z[i])
            c, s = z[i] / r, z[j] / r
            turn[:, [j, i]] = turn[:, [j, i]] @ np.array([[c, s], [-s, c]])
            z[j], z[i] = 0, r
            live[-1] = i
        else:
            live.append(i)
    w, vectors = d.copy(), np.eye(n)
    if live:
        at = np.array(live)
        dl, zl = d[at], z[at]
        near, off = _secular(dl, zl, rho)
        # differences d - x without cancellation, and the z for which these are the exact roots
        diff = (dl[:, None] - dl[near][None, :]) - off[None, :]
        m = len(at)
        zhat = np.empty(m)
        for i in range(m):
            others = np.arange(m) != i
            upper = np.append(np.arange(m)[:i], np.arange(m)[i + 1 :])
            ratio = diff[i, np.where(upper < i, upper, upper - 1)] / (dl[i] - dl[others]) if m > 1 else np.ones(0)
            zhat[i] = np.copysign(np.sqrt(abs(diff[i, m - 1] * np.prod(ratio))), zl[i])
        u = zhat[:, None] / diff
        u /= np.linalg.norm(u, axis=0)
        w[at] = dl[near] + off
        vectors[np.ix_(at, at)] = u
    out = np.empty((n, n))
    out[order] = turn @ vectors
    return w, out


def divide_and_conquer(d: np.ndarray, e: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of the tridiagonal matrix with diagonal ``d`` and subdiagonal ``e``.

    The matrix is torn in two halves and a correction of rank one, whose secular
    equation joins the halves' solutions.
    """
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    m = n // 2
    rho = e[m - 1]
    first, second = d[:m].copy(), d[m:].copy()
    first[-1] -= abs(rho)
    second[0] -= abs(rho)
    w1, q1 = divide_and_conquer(first, e[: m - 1])
    w2, q2 = divide_and_conquer(second, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    z = np.concatenate([q1[-1], np.copysign(1.0, rho) * q2[0]])
    w, u = _rank_one(np.concatenate([w1, w2]), z, abs(rho)) if rho else (np.concatenate([w1, w2]), np.eye(n))
    order = np.argsort(w, kind="stable")
    return w[order], (q @ u)[:, order]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit vectors as columns, each with its largest entry positive."""
    scale = np.abs(v).max() if v.size else 0
    if not scale > 0:
        return np.zeros(len(v)), np.eye(len(v))
    d, e, q = tridiagonal(v / scale)
    w, u = divide_and_conquer(d, e)
    vectors = (q @ u)[:, ::-1]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(v))]
    return w[::-1] * scale, vectors * np.copysign(1.0, top)


# on Spark


@dataclass
class Whitening:
    """What the fit list says: its size, the sums of its dimensions and its components, all of the vectors' size."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def means(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sums / n as an integer and a double-double below 1."""
        whole = [s // self.n for s in self.sums]
        high = [(s - self.n * q) / self.n for s, q in zip(self.sums, whole, strict=True)]
        low = [float(Fraction(s - self.n * q, self.n) - Fraction(h)) for s, q, h in zip(self.sums, whole, high, strict=True)]
        return np.array(whole, "int64"), np.array(high), np.array(low)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, high, low = self.means
        a, b = two_sum((x - whole).astype(float), -high)
        return two_sum(a, b - low)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - sums)^2), exact; null where it doesn't fit a long."""
        whole = self.means[0]
        rest = np.array([s - self.n * q for s, q in zip(self.sums, whole.tolist(), strict=True)], dtype=object)
        near = x - whole
        if x.size and (int(np.abs(near).max()) + 1) ** 2 * self.n**2 * x.shape[1] < 1 << 63:
            return ((near * self.n - rest.astype("int64")) ** 2).sum(axis=1).tolist()
        exact = ((near.astype(object) * self.n - rest) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]

    def columns(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The whitened coordinates, and a low part of zeros."""
        high, low = self.centred(x)
        out = (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)
        return out, np.zeros_like(out)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: the vectors as integers, without those that hold a null, a number that is not finite, or one too large."""
    c = F.col("c")
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("c"))
    usable = F.forall(c, lambda v: F.coalesce(F.abs(v) < MOST / SCALE, F.lit(False)))  # NaN is larger than any number
    own = own.where(c.isNotNull() & (F.size(c) > 0) & usable)
    return own.select("id", F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of the vectors and exact sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * size, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0), size)
            n += len(x)
            high = [a + b for a, b in zip(high, (x >> 24).sum(axis=0).tolist(), strict=True)]
            low = [a + b for a, b in zip(low, (x & 0xFFFFFF).sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(size)), "n": [n] * size, "high": high, "low": low}, pa.schema([("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = fit.select("x").mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low")).orderBy("i").collect()
    return (got[0].n if got else 0), [(int(r.high) << 24) + int(r.low) for r in got]


_MATRIX = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])
_KIND = "i int, part int, high array<double>, low array<double>"


def _added(rows: pa.Table) -> pa.Table:
    """The rows of a group, in order of their parts, added in double-double."""
    total = None
    for r in rows.sort_by("part").to_pylist():
        one = (np.array(r["high"]), np.array(r["low"]))
        total = one if total is None else dd_add(total, one)
    return pa.Table.from_pydict({"i": [r["i"]], "part": [r["to"]], "high": [total[0].tolist()], "low": [total[1].tolist()]}, _MATRIX)


def _outer_sum(fit: DataFrame, size: int, out: int, made: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], fan: int = 64) -> np.ndarray:
    """Sum of outer products over ``fit`` of the ``out`` columns (high, low) that ``made`` turns x into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for at in range(0, len(x), ROWS):
                one = outer(*made(x[at : at + ROWS]))
                total = one if total is None else dd_add(total, one)
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": list(range(out)), "part": [part] * out, "high": total[0].tolist(), "low": total[1].tolist()}, _MATRIX)

    sums = fit.select("x").mapInArrow(run, _KIND)
    for over in (fan, fan, 1 << 30):  # a tree over the tasks: no group holds more than ``fan`` rows but the last
        sums = sums.withColumn("to", F.expr(f"cast(part div {over} as int)")).groupBy("i", "to").applyInArrow(_added, _KIND)
    v = np.zeros((out, out))
    for r in sums.collect():  # a matrix of the vectors' size
        v[r.i] = np.array(r.high) + np.array(r.low)
    return (v + v.T) / 2


def fit_whitening(vectors: DataFrame, size: int, top: int = 16) -> Whitening | None:
    """Components of the distinct rows of ``x``, an array of ``size`` integers; None if there is no row."""
    fit = written(vectors.select("x").distinct())
    n, sums = _sums(fit, size)
    if not n:
        return None
    found = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    v = _outer_sum(fit, size, size, found.centred) / n
    values, columns = eigen(v)
    some = int((values[:top] > size * EPS * values[0]).sum())
    found.values, found.vectors, found.trace = values[:some], np.ascontiguousarray(columns[:, :some]), float(np.trace(v))
    if some:
        own = _outer_sum(fit, size, some, found.columns) / n
        found.identity_error = float(np.abs(own - np.eye(some)).max())
    return found


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 16) -> DataFrame:
    """Whitened coordinates: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Entries become integers, floor(64 * c) + 1000000. Rows whose vector is null, empty or
    holds a null, a number that is not finite or one of 5e11 or more are dropped, and so
    are rows of another length than most vectors have (of two, the larger length). The
    fit list is each distinct vector once: ``n`` of them. Components are numbered from
    1 by falling variance, up to ``top``; those without variance have no rows, so a
    table with one distinct vector, or none, gives no row. ``deviation`` is the exact
    sum over dimensions of (n * x - sum)^2, null where it doesn't fit a long;
    ``explained`` the component's share of the trace; ``identity_error`` how far the
    whitened fit list's covariance is from the identity, in its largest entry. Null and
    repeated ids are ids like any other; other columns are ignored.
    """
    own = integers(rows, id_col, vector_col)
    sizes = own.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = sizes[0].size if sizes else 1
    own = own.where(F.size("x") == size)
    found = fit_whitening(own, size, top) if sizes else None
    k = len(found.values) if found else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not k:
            return
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, m = _matrix(part.column(1), size), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array(found.deviation(x), pa.int64()).take(each)
                share = np.tile(found.values / found.trace, m)
                columns = [part.column(0).take(each), np.tile(np.arange(1, k + 1, dtype="int32"), m), np.full(m * k, found.n), deviation, found.columns(x)[0].ravel(), share, np.full(m * k, found.identity_error)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
