"""Embedding whitening by a bidiagonal qd solver.

Blocks of centred vectors are reduced to triangles by Householder QR, and the triangles of all tasks merged in a tree, so
that no covariance is ever formed and what the driver gets is one triangle of the vectors' length. It is brought to
bidiagonal form by Householder reflections; dqds finds all singular values to high relative accuracy, and a twisted
factorisation of the tridiagonal at each wanted value gives its direction. Vectors are then projected on the executors.

Entries c become whole numbers floor(1024 c) + 100000; all statistics are over all rows that count. A row counts unless
its vector is null or empty, or holds an entry that is null, NaN, infinite or beyond 2**18 in size; should lengths
differ, the most frequent length counts. A null id stays null; repeated rows give repeated result rows and count as often;
ties between values get their number by the order in which they are found. Components without variance cannot be
whitened and are left out, so a table of equal vectors gives an empty result, as an empty table does. A deviation that no
long holds is null. Only the id and the vector are read, whatever other columns are named.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shopgauge.llm.vectors import matrix, tree_merged, usable
from shopgauge.session import materialize

#: Fixed values of the contract: scale and offset of entries, components returned.
SCALE, OFFSET, COMPONENTS = 1024, 100000, 8
#: Vectors of one QR block.
BLOCK = 4096
_EPS = np.finfo(float).eps
#: Values closer than this, relative to the greater one, are a cluster: their directions are made orthogonal.
_CLUSTER = 1e-3


# Passes over the vectors.

def _whole(batch: pa.RecordBatch, vector: str, length: int) -> np.ndarray:
    return np.floor(SCALE * matrix(batch.column(vector), length)).astype(np.int64) + OFFSET


def _parts(rows: DataFrame, work, label: str):
    """One pickled result of ``work(batches)`` for each task that has rows, numbered by the task."""
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result = work(b for b in batches if b.num_rows)
        if result is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(result)], pa.binary())], names=["part"])

    return rows.mapInArrow(once, "part binary").select(F.spark_partition_id().cast("long").alias("at"), "part")


def totals(rows: DataFrame, vector: str, length: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry."""
    def work(batches):
        n, sums = 0, [0] * length
        for batch in batches:
            n += batch.num_rows
            sums = [a + b for a, b in zip(sums, _whole(batch, vector, length).sum(axis=0).tolist())]
        return (n, sums) if n else None

    def merge(parts: list[bytes]) -> bytes:
        found = [pickle.loads(p) for p in parts]
        return pickle.dumps((sum(n for n, _ in found), [sum(s) for s in zip(*(s for _, s in found))]))

    return pickle.loads(tree_merged(_parts(rows, work, "sums"), merge, "whitening-sums") or pickle.dumps((0, [0] * length)))


def _centring(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each entry as a whole number and the fraction beside it."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def triangle(rows: DataFrame, vector: str, length: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred vectors."""
    whole, rest = _centring(n, sums)

    def reduced(stack: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(stack), mode="r")

    def work(batches):
        r, stack, height = None, [], 0
        for batch in batches:
            stack.append((_whole(batch, vector, length) - whole) - rest)
            height += batch.num_rows
            if height >= BLOCK:
                r, stack, height = reduced([*([] if r is None else [r]), *stack]), [], 0
        return reduced([*([] if r is None else [r]), *stack]) if stack else r

    def merge(parts: list[bytes]) -> bytes:
        return pickle.dumps(reduced([pickle.loads(p) for p in parts]))

    r = pickle.loads(tree_merged(_parts(rows, work, "triangles"), merge, "whitening-triangles"))
    return np.vstack([r, np.zeros((max(0, length - len(r)), length))])[:length]


# The solver, on one triangle.

def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v^T) x = (alpha, 0, ..)."""
    norm = float(np.linalg.norm(x))
    v = x.copy()
    if norm == 0.0:
        return v, 0.0
    v[0] += math.copysign(norm, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with R = U B V^T for orthogonal U and V."""
    a, size = r.astype(float).copy(), len(r)
    v_all = np.eye(size)
    for k in range(size):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < size - 2:
            v, beta = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            v_all[:, k + 1 :] -= beta * np.outer(v_all[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v_all


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int, float]:
    """One dqds step; also the first place where it went negative (-1 if nowhere) and the value there."""
    q2, e2, d = [], [], q[0] - shift
    if d < 0:
        return q2, e2, 0, d
    for i in range(len(q) - 1):
        top = d + e[i]
        t = q[i + 1] / top if top > 0 else 0.0
        q2.append(top)
        e2.append(e[i] * t)
        d = (d * t if top > 0 else q[i + 1]) - shift
        if d < 0 or not math.isfinite(d):
            return q2, e2, i + 1, d
    q2.append(d)
    return q2, e2, -1, d


def _smaller(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows: where the next shift is tried."""
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], math.sqrt(q[-1] * e[-1]) if len(q) > 1 else 0.0
    half, apart = (a + b) / 2, math.hypot((a - b) / 2, c)
    return max(0.0, half - apart)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling. Shifts are kept below the least one, so every
    transform has positive numbers only, which is what keeps small values accurate."""
    # Entries that cannot matter are split off first; each piece is solved alone.
    found: list[float] = []
    pieces = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above])]
    for q, e in pieces:
        sigma = 0.0
        while q:
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            if e[-1] <= _EPS**2 * (sigma + q[-1]) or q[-1] + e[-1] == 0.0:
                found.append(q.pop() + sigma)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS**2 * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None and sigma == 0.0:
                pieces.append((q[: cut + 1], e[:cut]))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            shift = _smaller(q, e) * (1 - 4 * _EPS) if len(q) > 2 else 0.0
            if len(q) == 2:  # two rows: the values themselves
                a, b, c = q[0] + e[0], q[1], q[0] * q[1]
                big = (a + b) / 2 + math.sqrt(max(0.0, ((a + b) / 2) ** 2 - c))
                found += [big + sigma, (c / big if big > 0 else 0.0) + sigma]
                break
            for _ in range(6):
                q2, e2, failed, value = _transformed(q, e, shift)
                if failed < 0 or shift == 0.0:
                    break
                # Only the last number negative: the shift plus it is a bound from below that is nearly met.
                shift = max(0.0, (shift + value) * (1 - 4 * _EPS)) if failed == len(q) - 1 and math.isfinite(value) else shift / 4
            else:
                shift = 0.0
                q2, e2, failed, value = _transformed(q, e, 0.0)
            q, e, sigma = q2, e2, sigma + shift
    return np.array(sorted(found, reverse=True))


def _twisted(q: np.ndarray, b: np.ndarray, value: float, skip: int) -> np.ndarray:
    """An eigenvector of the tridiagonal (q, b) at ``value``: the factorisations from both ends meet where their
    remainder is smallest (the next smallest for ``skip`` = 1, and so on)."""
    n = len(q)
    tiny = _EPS * (np.abs(q).max() + np.abs(b).max(initial=0.0)) * _EPS + 1e-300
    down, up = np.empty(n), np.empty(n)
    down[0] = q[0] - value
    for i in range(1, n):
        down[i] = q[i] - value - b[i - 1] ** 2 / (down[i - 1] if abs(down[i - 1]) > tiny else math.copysign(tiny, down[i - 1]))
    up[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        up[i] = q[i] - value - b[i] ** 2 / (up[i + 1] if abs(up[i + 1]) > tiny else math.copysign(tiny, up[i + 1]))
    gamma = np.abs(down + up - (q - value))
    r = int(np.argsort(gamma, kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -b[i] * z[i + 1] / (down[i] if abs(down[i]) > tiny else math.copysign(tiny, down[i]))
        if abs(z[i]) > 1e150:
            z /= abs(z[i])
    for i in range(r + 1, n):
        z[i] = -b[i - 1] * z[i - 1] / (up[i] if abs(up[i]) > tiny else math.copysign(tiny, up[i]))
        if abs(z[i]) > 1e150:
            z /= abs(z[i])
    return z / np.linalg.norm(z)


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix at the (falling) squared values, as columns.

    Inside a cluster, and between pieces that do not touch, vectors are made orthogonal to those before them; where
    little is left of one, its factorisation is twisted elsewhere.
    """
    q = diagonal**2 + np.concatenate([[0.0], above**2])
    b = diagonal[:-1] * above
    out: list[np.ndarray] = []
    for k, value in enumerate(values):
        close = [out[j] for j in range(k) if values[j] - value <= _CLUSTER * values[j]]
        best, left = None, -1.0
        for skip in range(len(q)):
            z = _twisted(q, b, float(value), skip)
            for _ in range(2):
                for other in close:
                    z = z - (other @ z) * other
            norm = float(np.linalg.norm(z))
            if norm > left:
                best, left = z / norm if norm > 0 else z, norm
            if left > 0.3 or not close:
                break
        out.append(best)
    return np.array(out).T


@dataclass
class Whitening:
    """Means, unit directions (columns) and variances of the components, and the whole variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    whole_variance: float


def solved(r: np.ndarray, n: int, sums: list[int], components: int = COMPONENTS) -> Whitening:
    """Components of vectors whose centred QR triangle is ``r``; those without variance are left out."""
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0.0:
        return Whitening(n, sums, np.zeros((len(r), 0)), np.zeros(0), 0.0)
    d, e, v = bidiagonal(r / scale)
    squares = dqds(d, e)
    wanted = squares[:components]
    wanted = wanted[wanted > (len(r) * _EPS) ** 2 * squares[0]]
    axes = v @ directions(d, e, wanted)
    return Whitening(n, sums, axes / np.linalg.norm(axes, axis=0), wanted * scale**2 / n, float((r**2).sum()) / n)


def learned(rows: DataFrame, vector: str, length: int, components: int = COMPONENTS) -> Whitening:
    """The components of all vectors of a table of ``usable`` rows."""
    n, sums = totals(rows, vector, length) if length else (0, [])
    if not n:
        return Whitening(0, sums, np.zeros((length, 0)), np.zeros(0), 0.0)
    return solved(triangle(rows, vector, length, n, sums), n, sums, components)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over entries of (n x - S)**2, exactly; None beyond a long."""
    means = [s // n for s in sums]
    rest = np.array([s - m * n for s, m in zip(sums, means)], np.int64)
    near = x - np.array(means, np.int64)
    most = int(np.abs(near).max(initial=0)) * n + n
    if most < 1 << 62 and most * most * x.shape[1] < 1 << 63:
        return ((near * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((a * n - b) ** 2 for a, b in zip(row, rest.tolist())) for row in near.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, vec_id: str, vector: str, length: int, w: Whitening) -> DataFrame:
    """vec_id, deviation and the array ``whitened`` of each vector, written once."""
    whole, rest = _centring(w.n, w.sums) if w.n else (np.zeros(length, np.int64), np.zeros(length))
    project = w.axes / np.sqrt(w.variances)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch, vector, length)
            values = ((x - whole) - rest) @ project
            offsets = pa.array(np.arange(len(x) + 1) * project.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(vec_id), pa.array(_deviations(x, w.n, w.sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return materialize(rows.mapInArrow(work, "vec_id long, deviation long, whitened array<double>"), "whitened")


def identity_error(rows: DataFrame, components: int) -> float:
    """Largest entry, in size, of the covariance of ``whitened`` minus the identity; each part is centred by itself."""
    def merged(found):
        n, mean, moment = found[0]
        for m, other, its in found[1:]:
            apart = other - mean
            moment = moment + its + np.outer(apart, apart) * (n * m / (n + m))
            n, mean = n + m, mean + apart * (m / (n + m))
        return n, mean, moment

    def work(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column("whitened"), components)
            mean = x.mean(axis=0)
            part = (len(x), mean, (x - mean).T @ (x - mean))
            total = part if total is None else merged([total, part])
        return total

    def merge(parts: list[bytes]) -> bytes:
        return pickle.dumps(merged([pickle.loads(p) for p in parts]))

    n, _, moment = pickle.loads(tree_merged(_parts(rows.select("whitened"), work, "moments"), merge, "whitening-moments"))
    return float(np.abs(moment / n - np.eye(components)).max())


def components(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    kept, length = usable(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")), "vector", "vec_id")
    w = learned(kept, "vector", length, count)
    if not len(w.variances):
        return kept.where(F.lit(False)).select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        )
    done = whitened(kept, "vec_id", "vector", length, w)
    shares = F.lit((w.variances / w.whole_variance).tolist())
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(identity_error(done, len(w.variances))).alias("identity_error"),
    )
