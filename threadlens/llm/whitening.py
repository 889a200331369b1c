"""Embedding whitening by a bidiagonal qd solver.

The rows, centred on exact integer sums, are never multiplied into a covariance
matrix, which would square their condition.  Each task folds its rows block by
block into one triangle R by QR; the triangles meet in a tree of bounded fan-in.
Householder reflections bring the last R to an upper bidiagonal B; dqds finds the
squared singular values of B one by one from the smallest, shifted by a bound
from below that is always safe; a twisted factorization of B'B - lambda, one
qd transform from the top and one from the bottom that meet where the pivot is
smallest, gives each direction in one sweep.  Directions of values that lie too
near one another for that come from inverse iteration on the same factorization,
kept orthogonal within their group.

Only a vector length's sums and its few directions reach the driver and the
tasks' closures; their size does not depend on the number of rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from math import sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

SCALE, LIFT = 1024, 100_000
COMPONENTS = 8
FAN_IN = 32
FAN_BYTES = 64 << 20
BLOCK_ROWS = 1024
EPS = float(np.finfo(np.float64).eps)
NEAR = 1e-3
EXACT = 1 << 62


# ------------------------------------------------------------------ the solver


def reflector(x: np.ndarray) -> tuple[np.ndarray | None, float]:
    """(unit v, alpha) with (I - 2 v v') x = alpha e1; None for a vector that is that already."""
    if not np.any(x[1:]):
        return None, float(x[0])
    size = float(np.abs(x).max())
    alpha = -np.copysign(size * sqrt(float(((x / size) ** 2).sum())), x[0])
    v = x / size
    v[0] -= alpha / size
    return v / sqrt(float((v * v).sum())), float(alpha)


def bidiagonal(square: np.ndarray) -> tuple[list[float], list[float], list[np.ndarray | None]]:
    """(diagonal, superdiagonal, right reflectors) of a square matrix."""
    a = square.astype(np.float64).copy()
    d = len(a)
    diagonal, above, right = [], [], []
    for k in range(d):
        v, alpha = reflector(a[k:, k])
        diagonal.append(alpha)
        if v is not None:
            a[k:, k + 1 :] -= np.outer(2 * v, v @ a[k:, k + 1 :])
        if k + 1 < d:
            w, beta = reflector(a[k, k + 1 :])
            above.append(beta)
            right.append(w)
            if w is not None:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k + 1 :] @ w, 2 * w)
    return diagonal, above, right


def turned_back(vectors: np.ndarray, right: list[np.ndarray | None]) -> np.ndarray:
    """Columns in the bidiagonal's coordinates, in those of the matrix."""
    out = vectors.copy()
    for k in range(len(right) - 1, -1, -1):
        if right[k] is not None:
            out[k + 1 :] -= np.outer(2 * right[k], right[k] @ out[k + 1 :])
    return out


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transform: (q, e, the d it went through)."""
    new_q, new_e, through = [], [], []
    d = q[0] - shift
    for k, off in enumerate(e):
        through.append(d)
        top = d + off
        new_q.append(top)
        if top == 0.0:
            new_e.append(0.0)
            d = -shift
            continue
        part = q[k + 1] / top
        new_e.append(off * part)
        d = d * part - shift
    through.append(d)
    new_q.append(d)
    return new_q, new_e, through


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B, falling, from the squares of B's diagonal and superdiagonal.

    A sweep without shift goes through d with 1/d_k the diagonal of the inverse of
    BB', so 1 over their sum is below the smallest eigenvalue: a shift by it never
    passes that value, and nears it the faster the more isolated it is.
    """
    size = max(*q, *e, 0.0) if e else max(q, default=0.0)
    if size == 0.0:
        return [0.0] * len(q)
    found: list[float] = []
    tiny = EPS * EPS
    todo = [([x / size for x in q], [x / size for x in e], 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while len(q) > 1:
            split = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= tiny * (sigma + q[k + 1]) or e[k] <= tiny * tiny), None)
            if split is not None:
                todo.append((q[: split + 1], e[:split], sigma))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            q, e, d = sweep(q, e, 0.0)
            if min(d) > 0.0:
                shift = (1 - 8 * EPS) / sum(1 / x for x in d)
                if shift > tiny * sigma:
                    moved_q, moved_e, moved = sweep(q, e, shift)
                    if min(moved) >= 0.0:
                        q, e, sigma = moved_q, moved_e, sigma + shift
        found.append((sigma + q[0]) * size)
    return sorted(found, reverse=True)


class Twisted(NamedTuple):
    """N diag N' = B'B - value, with N joined at ``at``: multipliers from the top and from the bottom, and pivots."""

    at: int
    top: list[float]
    bottom: list[float]
    pivots: list[float]

    def direction(self) -> np.ndarray:
        """The vector whose residual is the pivot at the joint alone."""
        n = len(self.pivots)
        z = [0.0] * n
        z[self.at] = 1.0
        for k in range(self.at - 1, -1, -1):
            z[k] = -self.top[k] * z[k + 1]
        for k in range(self.at, n - 1):
            z[k + 1] = -self.bottom[k] * z[k]
        out = np.array(z)
        out /= np.abs(out).max()
        return out / sqrt(float(out @ out))

    def solve(self, y: np.ndarray) -> np.ndarray:
        w = y.tolist()
        n, at = len(w), self.at
        for k in range(at):
            w[k + 1] -= self.top[k] * w[k]
        for k in range(n - 1, at, -1):
            w[k - 1] -= self.bottom[k - 1] * w[k]
        w = [a / b for a, b in zip(w, self.pivots, strict=True)]
        for k in range(at - 1, -1, -1):
            w[k] -= self.top[k] * w[k + 1]
        for k in range(at, n - 1):
            w[k + 1] -= self.bottom[k] * w[k]
        return np.array(w)


def twisted(b: list[float], f: list[float], value: float) -> Twisted:
    """The twisted factorization of B'B - ``value`` (which is above 0) whose pivot at the joint is smallest."""
    n = len(b)
    small = EPS * EPS * value
    s, top, plus = [-value], [], []
    for k in range(n - 1):
        pivot = s[k] + b[k] * b[k] or small
        plus.append(pivot)
        top.append(b[k] * f[k] / pivot)
        s.append(f[k] * f[k] * s[k] / pivot - value)
    plus.append(s[-1] + b[-1] * b[-1] or small)
    p = [0.0] * n
    p[-1] = b[-1] * b[-1] - value
    bottom, minus = [0.0] * (n - 1), [0.0] * n
    minus[-1] = p[-1] or small
    for k in range(n - 2, -1, -1):
        pivot = f[k] * f[k] + p[k + 1] or small
        minus[k + 1] = pivot
        bottom[k] = b[k] * f[k] / pivot
        p[k] = p[k + 1] * b[k] * b[k] / pivot - value
    gamma = [s[k] + p[k] + value for k in range(n)]
    at = min(range(n), key=lambda k: abs(gamma[k]))
    return Twisted(at, top, bottom, [*plus[:at], gamma[at] or small, *minus[at + 1 :]])


def directions(b: list[float], f: list[float], wanted: int) -> tuple[list[float], np.ndarray]:
    """The ``wanted`` largest eigenvalues of B'B above rounding, and unit eigenvectors as columns."""
    n = len(b)
    largest = max(map(abs, [*b, *f]), default=0.0)
    cuts = [0, *(k + 1 for k in range(n - 1) if abs(f[k]) <= EPS * largest * EPS or abs(f[k]) <= EPS * min(abs(b[k]), abs(b[k + 1]))), n]
    blocks = []
    for start, end in zip(cuts, cuts[1:]):
        values = dqds([x * x for x in b[start:end]], [x * x for x in f[start : end - 1]])
        blocks.append((start, end, values))
    order = sorted(((v, i, k) for i, (_, _, vs) in enumerate(blocks) for k, v in enumerate(vs)), reverse=True)
    floor = (8 * n * EPS) ** 2 * order[0][0] if order else 0.0
    chosen = [x for x in order[:wanted] if x[0] > floor]
    out = np.zeros((n, len(chosen)))
    group: list[np.ndarray] = []
    for column, (value, i, k) in enumerate(chosen):
        start, end, values = blocks[i]
        parts = b[start:end], f[start : end - 1]
        gaps = [abs(values[j] - value) for j in (k - 1, k + 1) if 0 <= j < len(values)]
        if min(gaps, default=value) > NEAR * value:
            vector = twisted(*parts, value).direction()
        else:
            # The chosen values fall, so those of the same group in the block come one after another.
            near = [c for c in range(column) if chosen[c][1] == i and chosen[c][0] - value <= NEAR * chosen[c][0] * n]
            group = [out[start:end, c] for c in near]
            factors = twisted(*parts, value * (1 + 4 * EPS * len(near)))
            vector = np.array([random.Random(f"{column} {j}").uniform(-1, 1) for j in range(end - start)])
            for _ in range(5):
                vector = factors.solve(vector / np.abs(vector).max())
                vector /= np.abs(vector).max()
                for _ in range(2):
                    for other in group:
                        vector = vector - other * float(other @ vector)
                vector /= sqrt(float(vector @ vector))
        out[start:end, column] = vector
    return [x[0] for x in chosen], out


def solve(triangle: np.ndarray, n: int, wanted: int) -> tuple[list[float], np.ndarray, list[float]]:
    """(eigenvalues, unit eigenvectors as columns, share of the trace) of R'R / n; the largest entry of a vector is positive."""
    size = float(np.abs(triangle).max(initial=0.0)) or 1.0
    triangle = triangle / size
    b, f, right = bidiagonal(triangle)
    values, inner = directions(b, f, wanted)
    vectors = turned_back(inner, right)
    for k in range(vectors.shape[1]):
        if vectors[np.abs(vectors[:, k]).argmax(), k] < 0:
            vectors[:, k] *= -1
    total = float((triangle**2).sum())
    return [v * size / n * size for v in values], vectors, [v / total for v in values]


# -------------------------------------------------------------------- the rows


class Fit(NamedTuple):
    """What is known of the vectors of one length: their number, sums, directions over root values, shares, error."""

    n: int
    sums: list[int]
    turn: np.ndarray | None = None
    shares: list[float] | None = None
    error: float = 0.0


def lifted(vectors: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of integers; what is beyond 2**62 stays there."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.clip(scaled, -float(EXACT), float(EXACT)).astype(np.int64) + LIFT


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums, in integers of any size where 64 bits might not do."""
    return (x if largest(x) * max(1, len(x)) < EXACT else x.astype(object)).sum(0).tolist()


def from_mean(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n*x - S, exact."""
    if max(largest(x) * fit.n, max(map(abs, fit.sums))) >= EXACT:
        x = x.astype(object)
    return x * fit.n - np.array(fit.sums, dtype=x.dtype)


def square_sums(d: np.ndarray) -> list[int]:
    """Exact sum of squares of every row."""
    if largest(d) ** 2 * d.shape[1] >= EXACT:
        d = d.astype(object)
    return (d * d).sum(1).tolist()


def by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, batch.filter(pa.array(dims == dim))


def sums_of(rows: DataFrame) -> dict[int, Fit]:
    """Number and exact sums of the vectors of each length."""

    def added(batches):
        held: dict[int, tuple[int, list[int]]] = {}
        for dim, batch in by_length(batches):
            n, sums = held.get(dim, (0, [0] * dim))
            more = exact_sums(lifted(batch.column("v")))
            held[dim] = n + batch.num_rows, [a + b for a, b in zip(sums, more, strict=True)]
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([n]), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))],
                ["dim", "n", "sums"],
            )

    parts = rows.mapInArrow(added, "dim int, n long, sums array<decimal(38,0)>")
    found = parts.select("dim", "n", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")
    ).collect()
    out: dict[int, Fit] = {}
    for row in sorted(found, key=lambda r: (r["dim"], r["at"])):
        fit = out.setdefault(row["dim"], Fit(row["n"], []))
        fit.sums.append(int(row["s"]))
    return out


def in_tree(parts: DataFrame, meet: Callable[[list[bytes], int], bytes], label: str) -> DataFrame:
    """One row (dim, part, held) per length, from one per task and length, ``FAN_IN`` at a time."""
    now = materialize(parts, label)
    fan = F.greatest(F.lit(2), F.least(F.lit(FAN_IN), F.floor(F.lit(FAN_BYTES) / F.max(F.length("held"))))).cast("int")
    while True:
        most = now.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), fan.alias("fan")).agg(F.max("n"), F.min("fan")).first()
        if (most[0] or 0) <= 1:
            return now
        fan_in = most[1]

        def together(key, group: pd.DataFrame) -> pd.DataFrame:
            dim, part = (int(k) for k in key)
            return pd.DataFrame({"dim": [dim], "part": [part], "held": [meet(group.sort_values("part")["held"].tolist(), dim)]})

        dealt = now.withColumn("bucket", F.floor(F.col("part") / F.lit(fan_in)).cast("int"))
        now = materialize(dealt.groupBy("dim", "bucket").applyInPandas(together, "dim int, part int, held binary"), label)


def triangles(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(dim, part, held): the R of the centred vectors of each length."""

    def folded(batches):
        held: dict[int, list[np.ndarray]] = {}
        for dim, batch in by_length(batches):
            fit = fits[dim]
            centred = from_mean(lifted(batch.column("v")), fit).astype(np.float64) / fit.n
            blocks = held.setdefault(dim, [np.zeros((0, dim))])
            blocks.append(centred)
            if sum(map(len, blocks)) >= max(BLOCK_ROWS, 2 * dim):
                held[dim] = [np.linalg.qr(np.concatenate(blocks), mode="r")]
        part = TaskContext.get().partitionId()
        for dim, blocks in held.items():
            r = np.linalg.qr(np.concatenate(blocks), mode="r")
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["dim", "part", "held"]
            )

    def meet(held: list[bytes], dim: int) -> bytes:
        return np.linalg.qr(np.concatenate([np.frombuffer(h).reshape(-1, dim) for h in held]), mode="r").tobytes()

    return in_tree(rows.mapInArrow(folded, "dim int, part int, held binary"), meet, "triangles")


def solved(found: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, Fit]:
    """The fits with their directions; each length is solved in a task."""

    def made(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                r = np.frombuffer(row["held"]).reshape(-1, dim)
                square = np.zeros((dim, dim))
                square[: len(r)] = r
                values, vectors, shares = solve(square, fits[dim].n, components)
                turn = vectors / np.sqrt(np.array(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([turn.tobytes()], pa.binary()), pa.array([shares], pa.list_(pa.float64()))],
                    ["dim", "turn", "shares"],
                )

    out = dict(fits)
    for row in found.mapInArrow(made, "dim int, turn binary, shares array<double>").collect():
        dim = row["dim"]
        out[dim] = fits[dim]._replace(turn=np.frombuffer(row["turn"]).reshape(dim, -1), shares=list(row["shares"]))
    return out


def moments(n: int, mean: np.ndarray, products: np.ndarray) -> bytes:
    return np.concatenate([[n], mean, products.ravel()]).tobytes()


def joined_moments(held: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred products of several lists together."""
    total, mean, products = 0.0, None, None
    for h in map(np.frombuffer, held):
        k = int((sqrt(4 * len(h) - 3) - 1) / 2)
        n, m, p = h[0], h[1 : 1 + k], h[1 + k :].reshape(k, k)
        if mean is None:
            total, mean, products = n, m, p
            continue
        step = m - mean
        products = products + p + np.outer(step, step) * (total * n / (total + n))
        mean = mean + step * (n / (total + n))
        total += n
    return int(total), mean, products


def with_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, Fit]:
    """The fits with the largest deviation of the whitened covariance from the identity."""

    def gathered(batches):
        held: dict[int, bytes] = {}
        for dim, batch in by_length(batches):
            white = whitened(lifted(batch.column("v")), fits[dim])
            mean = white.mean(0)
            now = moments(len(white), mean, (white - mean).T @ (white - mean))
            held[dim] = moments(*joined_moments([held[dim], now])) if dim in held else now
        part = TaskContext.get().partitionId()
        for dim, h in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([h], pa.binary())], ["dim", "part", "held"]
            )

    found = in_tree(
        rows.mapInArrow(gathered, "dim int, part int, held binary"), lambda held, _: moments(*joined_moments(held)), "moments"
    )
    out = dict(fits)
    for row in found.collect():
        n, _, products = joined_moments([row["held"]])
        error = float(np.abs(products / n - np.eye(len(products))).max(initial=0.0))
        out[row["dim"]] = fits[row["dim"]]._replace(error=error)
    return out


def whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (from_mean(x, fit).astype(np.float64) / fit.n) @ fit.turn


def whiten(rows: DataFrame, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n, deviation decimal(38,0), whitened array, explained array, identity_error), one row per usable vector.

    Vectors that are null, empty or hold null or non-finite entries are left out;
    zero vectors, equal vectors and rows with equal or null ids count as they
    are.  Vectors of each length are a list of their own.  A list has as many
    components as ``components``, its length and its rank allow; the places of
    the others, whose values are 0, hold null in ``whitened`` and 0.0 in
    ``explained``.  A deviation beyond 38 digits is null.
    """
    v = F.col("v")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    source = (
        rows.select(F.col(id).alias("id"), F.col(vector).alias("v")).where(usable & (F.size(v) > 0)).withColumn("dim", F.size(v))
    )
    fits = sums_of(source.select("dim", "v"))
    fits = solved(triangles(source.select("dim", "v"), fits), fits, components)
    fits = with_errors(source.select("dim", "v"), fits)

    def placed(batches):
        for dim, batch in by_length(batches):
            fit = fits[dim]
            x = lifted(batch.column("v"))
            white = whitened(x, fit)
            places, have = min(components, dim), white.shape[1]
            full = np.zeros((len(white), places))
            full[:, :have] = white
            lists = pa.ListArray.from_arrays(
                np.arange(len(white) + 1, dtype=np.int32) * places,
                pa.array(full.ravel(), mask=np.tile(np.arange(places) >= have, len(white))),
            )
            shares = [*fit.shares, *[0.0] * (places - have)]
            deviation = [Decimal(s) if s < 10**38 else None for s in square_sums(from_mean(x, fit))]
            n = len(white)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([fit.n] * n, pa.int64()), pa.array(deviation, pa.decimal128(38, 0)), lists,
                 pa.array([shares] * n, pa.list_(pa.float64())), pa.array([fit.error] * n, pa.float64())],
                ["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(
        placed, f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    ).withColumnRenamed("id", id)


def components_of(rows: DataFrame, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``whiten``, one row per vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    ``deviation`` is a long here, null where it is beyond that range.
    """
    wide = whiten(rows, components, id, vector)
    return wide.select(
        id, "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one"),
    ).select(
        id, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "one.whitened", "one.explained", "identity_error"
    )
