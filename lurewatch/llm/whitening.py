"""Whitening of embeddings on their leading principal components, found by spectrum slicing.

Vectors become whole numbers (``floor(scale * component)``), so sums and products of
any number of tasks add up exactly and in any order.  The covariance V is taken over
the distinct vectors: one pass sums each dimension, the next multiplies what is left
after a centre is subtracted.  Both are Spark aggregates; the driver holds one d x d
matrix.

On that matrix LDL^T factors of V - s tell how many eigenvalues exceed s (the signs
of the pivots).  Halving an interval by these counts isolates the j-th largest
eigenvalue; Rayleigh quotient iteration converges from there, and two more counts on
either side of its result certify that it is number j.  An interval that shrinks to
rounding holds equal eigenvalues, whose vectors are made orthogonal to those found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import packed, stored, unpacked
from .vectors import usable

#: Whole numbers of this size or more take no part, like infinite ones: exact sums of their products leave two longs.
LARGEST = float(1 << 44)


def positive_pivots(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are above zero: the inertia of its LDL^T factors.

    Bunch and Kaufman's pivots of one or two rows keep the factors bounded.
    """
    a, k, n, above = a.copy(), 0, len(a), 0
    tiny = np.finfo(float).tiny
    while k < n:
        column = np.abs(a[k + 1:, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most, two = (column.max() if len(column) else 0.0), False
        if most > 0 and abs(a[k, k]) < 0.6403882032022076 * most:
            other = np.abs(a[r, k:])
            other[r - k] = 0
            if abs(a[k, k]) * other.max() < 0.6403882032022076 * most * most:
                two = abs(a[r, r]) < 0.6403882032022076 * other.max()
                at = k + 1 if two else k
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        if two:
            block, rest = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2]
            above += int((np.linalg.eigvalsh(block) > 0).sum())
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot = a[k, k] if abs(a[k, k]) > tiny else -tiny
            above += int(pivot > 0)
            if most > 0:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k + 1:, k] / pivot)
            k += 1
    return above


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above rounding, falling, and their unit vectors as columns."""
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    if not size > 0:
        return np.zeros(0), np.zeros((d, 0))
    v = v / size
    noise = 64 * d * np.finfo(float).eps
    counts: dict[float, int] = {}

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = positive_pivots(v - s * np.eye(d))
        return counts[s]

    values, found = [], np.zeros((d, 0))
    for j in range(1, min(most, d) + 1):
        low, high = noise, 1.0 + noise
        if count(low) < j:
            break
        while True:
            for s in sorted(counts):  # what the counts for other numbers say about this one
                if counts[s] >= j:
                    low = max(low, s)
                else:
                    high = min(high, s)
            alone = count(low) == j and count(high) == j - 1
            if alone or high - low <= noise:
                value, vector = _rayleigh(v, (low + high) / 2, found)
                near = max(2 * noise, 4 * float(np.linalg.norm(v @ vector - value * vector)))
                sure = count(value - near) >= j > count(value + near)
                if (sure and near <= 1e3 * noise) or high - low <= noise:
                    break
            count((low + high) / 2)
        values.append(value * size)
        found = np.column_stack([found, vector])
    return np.array(values), found


def _rayleigh(v: np.ndarray, shift: float, found: np.ndarray, steps: int = 30) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from an inverse iteration at ``shift``, orthogonal to ``found``."""
    d = len(v)

    def solved(s: float, x: np.ndarray) -> np.ndarray:
        try:
            y = np.linalg.solve(v - s * np.eye(d), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (s + np.finfo(float).eps) * np.eye(d), x)
        y -= found @ (found.T @ y)
        y /= np.linalg.norm(y)
        y -= found @ (found.T @ y)
        return y / np.linalg.norm(y)

    x = np.cos(np.arange(1, d + 1) * 1.618)
    x -= found @ (found.T @ x)
    for _ in range(3):
        x = solved(shift, x / np.linalg.norm(x))
    value, best = x @ v @ x, (np.inf, 0.0, x)
    for _ in range(steps):
        off = float(np.linalg.norm(v @ x - value * x))
        if off >= best[0]:
            break
        best = (off, float(value), x)
        x = solved(value, x)
        value = x @ v @ x
    return best[1], best[2]


@dataclass
class Model:
    """Whitening of vectors of one length: whole centre, what it leaves of the mean, and the components."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - sums) squared, exactly."""
        d, left = x - self.centre, [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]
        most = self.n * int(np.abs(d).max(initial=0)) + max(map(abs, left), default=0)
        if most * most * max(1, len(left)) < 1 << 63:
            return ((self.n * d - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(a) - b) ** 2 for a, b in zip(row, left)) for row in d]


def whole(rows: DataFrame, vector: str, scale: float) -> DataFrame:
    """``rows`` with ``_x``, the vector as whole numbers; rows that take no part go."""
    x = F.col(f"`{vector}`").cast("array<double>")
    inside = F.forall("_c", lambda c: F.abs(c) < LARGEST / scale)
    return (rows.withColumn("_c", x).filter(usable(F.col("_c")) & inside)
            .withColumn("_x", F.transform("_c", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))).drop("_c"))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1]
    values = column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, values[starts[at][:, None] + np.arange(d)]


def _halves(values: list[int]) -> tuple[list[int], list[int]]:
    """Whole numbers of up to 95 bits as high and low longs whose sums cannot overflow."""
    return [v >> 32 for v in values], [v & 0xFFFFFFFF for v in values]


def _summed(parts: DataFrame) -> dict[int, dict[int, tuple[int, list[int]]]]:
    """Add rows ``d, i, n, high, low`` over the tasks: for each length and ``i`` the count and the exact sums."""
    def add(rows: pa.Table) -> pa.Table:
        def total(name: str) -> list[int]:
            return rows.column(name).combine_chunks().flatten().to_numpy().reshape(len(rows), -1).sum(axis=0).tolist()

        return pa.table({"d": rows.column("d")[:1], "i": rows.column("i")[:1],
                         "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()),
                         "high": pa.array([total("high")], pa.list_(pa.int64())),
                         "low": pa.array([total("low")], pa.list_(pa.int64()))})

    out: dict = {}
    for r in parts.groupBy("d", "i").applyInArrow(add, _SUMS).collect():
        out.setdefault(r["d"], {})[r["i"]] = (r["n"], [(h << 32) + x for h, x in zip(r["high"], r["low"])])
    return out


_SUMS = "d int, i int, n long, high array<long>, low array<long>"


def _told(totals: dict[tuple[int, int], tuple[int, list[int]]]) -> pa.RecordBatch:
    keys = sorted(totals)
    halves = [_halves(totals[k][1]) for k in keys]
    return pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
        pa.array([totals[k][0] for k in keys], pa.int64()), pa.array([h for h, _ in halves], pa.list_(pa.int64())),
        pa.array([x for _, x in halves], pa.list_(pa.int64()))], ["d", "i", "n", "high", "low"])


def _each(found: DataFrame, rows_of) -> DataFrame:
    """Whole sums of every task: ``rows_of(matrix)`` gives lists of whole numbers, numbered from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            for at, x in _matrices(batch.column(0)):
                for i, own in enumerate(rows_of(x)):
                    n, old = totals.get((x.shape[1], i), (0, [0] * len(own)))
                    totals[x.shape[1], i] = n + len(at), [a + b for a, b in zip(old, own)]
        if totals:
            yield _told(totals)

    return found.mapInArrow(run, _SUMS)


def _exact_sum(x: np.ndarray) -> list[int]:
    if len(x) * int(np.abs(x).max(initial=0)) < 1 << 62:
        return x.sum(axis=0).tolist()
    return [sum(map(int, column)) for column in x.T]


def _exact_products(d: np.ndarray) -> list[list[int]]:
    """d^T d in whole numbers; floating point multiplies only what it holds exactly."""
    if len(d) * int(np.abs(d).max(initial=0)) ** 2 < 1 << 53:
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64).tolist()
    own = d.astype(object)
    return (own.T @ own).tolist()


def fit(rows: DataFrame, vector: str = "embedding", components: int = 4, scale: float = 256.0) -> dict[int, Model]:
    """Models by length of vector, over the distinct whole vectors of that length.

    An empty table has no model; components without variance are left out.
    """
    distinct = stored(whole(rows, vector, scale).select("_x").distinct(), "whitening-fit")
    sums = {d: own[0] for d, own in _summed(_each(distinct, lambda x: [_exact_sum(x)])).items()}
    centres = {d: np.array([(2 * s + n) // (2 * n) for s in own], np.int64) for d, (n, own) in sums.items()}
    products = _summed(_each(distinct, lambda x: _exact_products(x - centres[x.shape[1]])))
    models = {}
    for d, (n, own) in sums.items():
        rest = np.array([float(s - n * int(c)) / n for s, c in zip(own, centres[d])])
        v = np.array([[float(p) / n for p in products[d][i][1]] for i in range(d)]) - np.outer(rest, rest)
        v = (v + v.T) / 2
        values, vectors = leading(v, components)
        models[d] = Model(n, own, centres[d], rest, float(np.trace(v)), values, vectors)
    _measure(distinct, models)
    return models


def _measure(distinct: DataFrame, models: dict[int, Model]) -> None:
    """Set ``error``: how far the covariance of the whitened fit list is from the identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                w = models[x.shape[1]].whitened(x)
                w = np.column_stack([w, np.ones(len(w))])
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(
            [t.ravel().tolist() for t in totals.values()], pa.list_(pa.float64()))], ["d", "t"])

    entries = distinct.mapInArrow(run, "d int, t array<double>").select("d", F.posexplode("t").alias("i", "t"))
    totals: dict[int, dict[int, float]] = {}
    for r in entries.groupBy("d", "i").agg(F.sum("t").alias("t")).collect():
        totals.setdefault(r["d"], {})[r["i"]] = r["t"]
    for d, own in totals.items():
        k = len(models[d].values)
        t = np.array([own[i] for i in range(len(own))]).reshape(k + 1, k + 1) / models[d].n
        if k:
            models[d].error = float(np.abs(t[:k, :k] - np.outer(t[:k, k], t[:k, k]) - np.eye(k)).max())


def whiten(rows: DataFrame, models: dict[int, Model], vector: str = "embedding", carry: list[str] | None = None,
           scale: float = 256.0) -> DataFrame:
    """One row for each row of ``rows`` that takes part and each component; nothing is shuffled.

    ``carry`` columns (default: all) and ``component`` (from 1), ``n``, ``deviation``
    (decimal), ``whitened``, ``explained``, ``identity_error``.  Vectors that are NULL or
    empty or hold NULL, non-finite or huge (``LARGEST``) entries take no part; vectors of
    another length have a model of their own; repeated rows get equal results.  Where the
    fit list has no variance there is no component and so no row.
    """
    results = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    carry = [c for c in rows.columns if c not in results] if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch.column(1)):
                m = models.get(x.shape[1])
                if m is None or not len(m.values):
                    continue
                k, w = len(m.values), m.whitened(x)
                deviation = [Decimal(v) for v in m.deviation(x) for _ in range(k)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(k * len(at), m.n), pa.int64()), pa.array(deviation, pa.decimal128(38, 0)),
                    pa.array(w.ravel()), pa.array(np.tile(m.values / m.trace, len(at))),
                    pa.array(np.full(k * len(at), m.error))],
                    ["_row", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    own = whole(rows.select(packed(carry), F.col(f"`{vector}`").alias("_vector")), "_vector", scale).select("_row", "_x")
    schema = StructType([own.schema["_row"]])
    for f in StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, "
                                "identity_error double").fields:
        schema = schema.add(f)
    return own.mapInArrow(run, schema).select(*unpacked(carry), *results)
