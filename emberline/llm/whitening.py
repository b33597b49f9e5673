"""Operator 12: whitening of embeddings.

Vectors become whole numbers. The *fit list* holds each different vector once. Every partition goes over its part
of the list with Welford's updates (one rank-one update of the centred products for each vector); the partitions'
states are merged by the parallel formula, in groups of about the square root of their number, until one is left.
The driver gets that one state (as many numbers as a covariance matrix has) and solves it by symmetric QR steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut

#: Entries become floor(SCALE * entry).
SCALE = 256
#: Different lengths of vectors in one table, at most; each length is whitened by itself.
LENGTHS = 64
#: An eigenvalue below this share of the trace is rounding: its component has no spread to divide by.
LEAST = 1e-13
_LONG = 1 << 63


# -- running statistics ----------------------------------------------------------------------------------------------
@dataclass
class Spread:
    """Number, mean, centred products and exact sums of the vectors seen."""

    dims: int
    n: int = 0
    mean: np.ndarray = field(default=None)  # type: ignore[assignment]
    products: np.ndarray = field(default=None)  # type: ignore[assignment]
    sums: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.mean is None:
            self.mean, self.products, self.sums = np.zeros(self.dims), np.zeros((self.dims, self.dims)), [0] * self.dims

    def add(self, x: np.ndarray) -> None:
        """Welford's update: the deviation from the old mean times the deviation from the new one."""
        self.n += 1
        before = x - self.mean
        self.mean = self.mean + before / self.n
        self.products += before[:, None] * (x - self.mean)

    def merge(self, other: Spread) -> None:
        """The parallel formula: both products, and what lies between the two means."""
        if not other.n:
            return
        n, apart = self.n + other.n, other.mean - self.mean
        self.products = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


_STATE = pa.schema([("dims", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64())), ("sums", pa.list_(pa.string()))])
_STATE_DDL = "dims int, part long, n long, mean array<double>, products array<double>, sums array<string>"


def _row(s: Spread, part: int) -> dict:
    return {"dims": s.dims, "part": part, "n": s.n, "mean": s.mean.tolist(), "products": s.products.ravel().tolist(), "sums": [str(v) for v in s.sums]}


def _state(row) -> Spread:
    dims = int(row["dims"])
    return Spread(dims, int(row["n"]), np.array(row["mean"], float), np.array(row["products"], float).reshape(dims, dims), [int(v) for v in row["sums"]])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1_024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: bounds what Python holds of long vectors."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def spreads(vectors: DataFrame) -> dict[int, Spread]:
    """The spread of ``vectors`` (column ``x``, arrays of one kind of number) for each of their lengths."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, Spread] = {}
        for batch in batches:
            column = batch.column(0)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            whole = flat.dtype.kind == "i"
            for a, b in zip(ends[:-1], ends[1:]):
                s = held.setdefault(int(b - a), Spread(int(b - a)))
                if len(held) > LENGTHS:
                    raise ValueError(f"vectors of more than {LENGTHS} lengths in one table")
                s.add(flat[a:b].astype(float))
            if whole:  # the exact sums: 32 bits at a time, so that no sum of a batch overflows
                lengths = np.diff(ends)
                for dims in np.unique(lengths).tolist():
                    rows = flat[(ends[:-1][lengths == dims][:, None] + np.arange(dims)).ravel()].reshape(-1, dims)
                    high, low = (rows >> 32).sum(0).tolist(), (rows & 0xFFFFFFFF).sum(0).tolist()
                    held[dims].sums = [t + (h << 32) + v for t, h, v in zip(held[dims].sums, high, low)]
        part = TaskContext.get().partitionId()
        if held:
            yield pa.RecordBatch.from_pylist([_row(s, part) for s in held.values()], schema=_STATE)

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        out = _state(rows[0])
        for row in rows[1:]:
            out.merge(_state(row))
        return pa.Table.from_pylist([_row(out, rows[0]["part"])], schema=_STATE)

    states = cut(vectors.select("x").mapInArrow(seen, _STATE_DDL))
    most = states.groupBy("dims").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = max(1, round(most**0.5)) if most > 8 else 1
        states = cut(states.groupBy("dims", F.pmod(F.xxhash64("part"), F.lit(groups)).alias("_group")).applyInArrow(merged, _STATE_DDL))
        most = groups if groups == 1 else states.groupBy("dims").count().agg(F.max("count")).first()[0]
    found = states.limit(LENGTHS + 1).collect()  # one row for each length
    if len(found) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths in one table")
    return {row["dims"]: _state(row) for row in found}


# -- the eigen-solve -------------------------------------------------------------------------------------------------
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections that leave a diagonal, what lies beside it, and their product."""
    a, n = v.astype(float).copy(), len(v)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if size == 0 or np.abs(x[1:]).max() == 0:
            continue
        u = x / size
        u[0] += np.copysign(np.sqrt(u @ u), u[0])
        u *= np.sqrt(2 / (u @ u))
        side = a[k + 1 :, k + 1 :] @ u
        side -= u * (u @ side) / 2
        a[k + 1 :, k + 1 :] -= np.outer(u, side) + np.outer(side, u)
        a[k + 1 :, k] -= u * (u @ a[k + 1 :, k])
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows: tridiagonal form, then implicit QR steps shifted by the eigenvalue of the last corner (Wilkinson)."""
    n = len(v)
    if n == 0:
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(v)
    vectors, last, tiny = q.T.copy(), n - 1, np.finfo(float).eps
    for _ in range(60 * n):
        small = np.abs(e) <= tiny * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[small] = 0
        while last and e[last - 1] == 0:
            last -= 1
        if not last:
            break
        first = last
        while first and e[first - 1] != 0:
            first -= 1
        half, beside = (d[last - 1] - d[last]) / 2, e[last - 1]
        shift = d[last] - beside * (beside / (half + np.copysign(np.hypot(half, beside), half)))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            p, o, t = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * t + s * s * o, s * s * p - 2 * c * s * t + c * c * o
            e[k] = c * s * (o - p) + (c * c - s * s) * t
            x = e[k]
            if k < last - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            upper = vectors[k].copy()
            vectors[k] = c * upper + s * vectors[k + 1]
            vectors[k + 1] = c * vectors[k + 1] - s * upper
    else:
        raise ArithmeticError("the QR steps did not converge")
    order = np.argsort(-d, kind="stable")
    return d[order], vectors[order]


# -- the operator ----------------------------------------------------------------------------------------------------
@dataclass
class Whitener:
    """What whitening needs of a fit list: number, sums, the first components, their eigenvalues and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def of(cls, spread: Spread, count: int) -> Whitener:
        v = spread.covariance()
        values, vectors = eigen(v)
        return cls(spread.n, spread.sums, vectors[:count], np.maximum(values[:count], 0.0), float(np.trace(v)))

    def usable(self) -> np.ndarray:
        return self.values > LEAST * self.trace

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n * x - S, and the exact sum of its squares (None where that is no long)."""
        top = int(np.abs(x).max(initial=0)) if x.size and x.min() > -_LONG else _LONG
        most = self.n * top + max(map(abs, self.sums), default=0)
        if most * most * max(x.shape[1], 1) < _LONG:
            away = self.n * x - np.array(self.sums, np.int64)
            return away.astype(float), (away * away).sum(1).tolist()
        exact = [[self.n * v - s for v, s in zip(row, self.sums)] for row in x.tolist()]
        squares = [sum(v * v for v in row) for row in exact]
        return np.array(exact, float).reshape(x.shape), [s if s < _LONG else None for s in squares]

    def whiten(self, away: np.ndarray) -> np.ndarray:
        """Rows of ``apart`` on the components, each divided by its standard deviation; nan where there is none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable(), np.sqrt(self.values), np.nan)
        return (away / self.n) @ self.components.T / scale


def whole_numbers(embeddings: DataFrame, key: str, column: str) -> DataFrame:
    """key and ``x``, for rows whose vector is not null and holds numbers that are finite and, scaled, fit a long."""
    scaled = F.transform(F.col(column), lambda c: c.cast("double") * F.lit(float(SCALE)))
    held = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < F.lit(float(_LONG)), F.lit(False)))  # nan is above all numbers
    kept = embeddings.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), scaled.alias("x"), held.alias("_held")).where("_held")
    return kept.select(key, F.transform("x", lambda c: F.floor(c).cast("long")).alias("x"))


def whiten(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", count: int = 4) -> DataFrame:
    """The first ``count`` whitened components of every row's vector.

    Returns per row and component (fewer than ``count`` where vectors are shorter): key, component, n, deviation,
    whitened, explained, identity_error. Rows whose vector is null, or holds null, a number that is not finite, or
    one beyond a long once scaled, are left out; so are vectors without entries, which have no component. Repeated
    vectors count once in the fit and keep all their rows; null keys stay null. Vectors of different lengths are
    whitened apart. A component without spread (one vector, or all on a line) has null for ``whitened``, and no
    part in ``identity_error``; without any spread ``explained`` is 0. A deviation beyond a long is null. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = cut(whole_numbers(embeddings, key, column).where(F.size("x") > 0))
    fit = cut(rows.select("x").distinct())
    models = {dims: Whitener.of(s, count) for dims, s in spreads(fit).items()}

    measured = _errors(fit, models)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in _slices(batches):
            keys, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, x in enumerate(vectors):
                by_length.setdefault(len(x), []).append(i)
            for dims, places in by_length.items():
                m = models[dims]
                away, deviations = m.apart(np.array([vectors[i] for i in places], np.int64))
                got, k = m.whiten(away), len(m.values)
                share = (m.values / m.trace).tolist() if m.trace > 0 else [0.0] * k
                columns = [
                    [keys[i] for i in places for _ in range(k)],
                    list(range(1, k + 1)) * len(places),
                    [m.n] * (k * len(places)),
                    [d for d in deviations for _ in range(k)],
                    [None if v != v else v for v in got.ravel().tolist()],
                    share * len(places),
                    [measured[dims]] * (k * len(places)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return rows.mapInArrow(finished, f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _errors(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """For each length, how far the covariance of the whitened fit list is from the identity, measured over the list."""

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors = batch.column(0).to_pylist()
            for dims in sorted({len(x) for x in vectors}):
                m = models[dims]
                got = m.whiten(m.apart(np.array([x for x in vectors if len(x) == dims], np.int64))[0])[:, m.usable()]
                yield pa.RecordBatch.from_arrays([pa.array([dims] * len(got), pa.int32()), pa.array(got.tolist(), pa.list_(pa.float64()))], ["dims", "x"])

    if not models:
        return {}
    errors = {}
    whitened = fit.mapInArrow(white, "dims int, x array<double>")
    for dims in models:  # at most LENGTHS
        found = spreads(whitened.where(F.col("dims") == dims).where(F.size("x") > 0))
        errors[dims] = max((float(np.abs(s.covariance() - np.eye(s.dims)).max()) for s in found.values()), default=0.0)
    return errors
