"""Embedding whitening by leading principal components, found by FEAST contour integration.

Sums over the vectors are exact integers, added up by Spark, so the covariance does not depend on how rows
are dealt.  Only that matrix (one number for two dimensions) meets the driver.  There its leading
eigenpairs are found: inertia counts of shifted factorisations enclose them in intervals; for each, a
quadrature of complex shifted solves along a circle through the interval's ends projects random vectors onto
its eigenspace, and Rayleigh-Ritz extracts the pairs, until as many as the inertia counts have converged.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm import bitslice, storage

#: Nodes of the quadrature on the upper half of the circle.
NODES = 8
#: Rows that a task turns into numbers at once.
ROWS = 8192
_EXACT = 2**53


def inertia(a: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of the symmetric ``a`` above ``shift``: positive pivots of the factorisation of a - shift.

    Pivots are 1 by 1 or 2 by 2, chosen over the whole rest (Bunch and Parlett), so their signs are those of the
    eigenvalues.
    """
    rest = a - shift * np.eye(len(a))
    above = 0
    while len(rest):
        size = np.abs(rest)
        diagonal = int(np.argmax(np.diagonal(size)))
        i, j = divmod(int(np.argmax(size)), len(rest))
        if size[i, j] == 0:
            break
        if size[diagonal, diagonal] >= 0.6404 * size[i, j]:
            pivot = [diagonal]
            above += rest[diagonal, diagonal] > 0
        else:
            pivot = [i, j]
            above += 1  # the off-diagonal element outweighs both diagonal ones: one sign each
        keep = np.delete(np.arange(len(rest)), pivot)
        side = rest[np.ix_(keep, pivot)]
        rest = rest[np.ix_(keep, keep)] - side @ np.linalg.solve(rest[np.ix_(pivot, pivot)], side.T)
        rest = (rest + rest.T) / 2
    return int(above)


def feast(a: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of the symmetric ``a`` between ``low`` and ``high``: (values, vectors as columns)."""
    d = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(-0.5j * np.pi * (nodes - 1))
    width = min(d, 2 * count + 4)
    norm = float(np.abs(a).sum(axis=1).max())
    while True:
        y = np.random.default_rng(seed).standard_normal((d, width))
        for _ in range(12):
            if width < d:
                q = np.zeros((d, width))
                for turn, weight in zip(turns, weights, strict=True):
                    solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - a, y)
                    q += weight / 2 * (radius * turn * solved).real
            else:
                q = np.eye(d)
            basis, _ = np.linalg.qr(q)
            values, small = np.linalg.eigh(basis.T @ a @ basis)
            y = basis @ small
            inside = np.flatnonzero((values >= low) & (values <= high))
            if width == d and len(inside) != count:
                # An eigenvalue lies on an end of the interval within rounding: those nearest to its middle count.
                inside = np.sort(np.argsort(np.abs(values - centre), kind="stable")[:count])
            worst = np.abs(a @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0.0)
            if len(inside) == count and worst <= 32 * np.finfo(float).eps * norm:
                return values[inside], y[:, inside]
            if width == d:
                return values[inside], y[:, inside]
        width = min(d, 2 * width)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the covariance ``v``, falling, and their unit vectors as columns.

    Eigenvalues that are zero within rounding (d * 2^-52 of the trace) are left out.
    """
    d, scale = len(v), float(np.trace(v))
    if d == 0 or not scale > 0:
        return np.zeros(0), np.zeros((d, 0))
    a = v / scale
    floor, top = d * 2.0**-52, 1.0 + 1e-9
    wanted = min(k, inertia(a, floor))
    values, vectors = [], []
    open_ = [(floor, top, inertia(a, floor))]
    while open_ and sum(map(len, values)) < wanted:
        low, high, n = open_.pop()
        if n == 0:
            continue
        if n <= max(4, wanted) or high - low < 1e-13:
            found = feast(a, low, high, n)
            values.append(found[0])
            vectors.append(found[1])
            continue
        for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
            cut = low + part * (high - low)
            near = 1e-9 * (high - low)
            above = inertia(a, cut)
            if inertia(a, cut - near) == above == inertia(a, cut + near):
                break  # no eigenvalue lies on the cut
        upper = above - (inertia(a, high) if high < top else 0)
        open_ += [(low, cut, n - upper), (cut, high, upper)]
    if not values:
        return np.zeros(0), np.zeros((d, 0))
    # One more Rayleigh-Ritz step over all intervals: vectors of different ones become orthogonal to rounding.
    basis, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    e, small = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-e, kind="stable")[:wanted]
    u = basis @ small[:, order]
    u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return e[order] * scale, u / np.linalg.norm(u, axis=0)


def _padded(lists: pa.Array, dims: int) -> np.ndarray:
    rows = bitslice._matrix(lists)
    return np.pad(rows, ((0, 0), (0, dims - rows.shape[1]))) if rows.shape[1] < dims else rows


def _minus(rows: np.ndarray, centre: list[int]) -> np.ndarray:
    """rows - centre, exactly: 64-bit numbers where they fit, else Python's."""
    most = max(map(abs, centre), default=0) + int(max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0)))))
    kind = np.int64 if most < 2**63 else object
    return rows.astype(kind) - np.array(centre, dtype=kind)


def _products(y: np.ndarray) -> np.ndarray:
    """The exact matrix of products of columns, as Python numbers."""
    d = y.shape[1]
    most = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
    if most * most >= _EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    total = np.zeros((d, d), dtype=object)
    step = len(y) if most == 0 else max(1, min(len(y), _EXACT // (most * most)))
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _summed(fit: DataFrame, centre: list[int] | None, dims: int) -> dict[tuple[int, int], int]:
    """Exact sums over the fit list by (i, j): of column i with j = -1, the count as (-1, -1), or of products if centred.

    A task adds up its rows first; what it passes on depends on the number of dimensions alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims, dims) if centre is not None else dims, dtype=object), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _padded(batch.column(0).slice(at, ROWS), dims)
                n += len(rows)
                total = total + (_products(_minus(rows, centre)) if centre is not None else _column_sums(rows))
        if n:
            if centre is None:
                i, j, values = [*range(dims), -1], [-1] * (dims + 1), [*total, n]
            else:
                upper = np.triu_indices(dims)
                i, j, values = upper[0].tolist(), upper[1].tolist(), list(total[upper])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(values)], names=["i", "j", "s"])

    parts = fit.select("x").mapInArrow(work, "i int, j int, s decimal(38,0)")
    return {(r[0], r[1]): int(r[2]) for r in parts.groupBy("i", "j").agg(F.sum("s")).collect()}


def _column_sums(rows: np.ndarray) -> np.ndarray:
    most = max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0))))
    kind = np.int64 if most * max(1, len(rows)) < 2**63 else object
    return rows.astype(kind).sum(axis=0).astype(object)


def whiten(rows: DataFrame, k: int = 4, factor: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every vector on the ``k`` leading components, scaled to unit variance: ``id_col``, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are dropped.  An entry c becomes
    x = floor(factor * c); what does not fit 64 bits becomes the nearest number that does.  Shorter vectors count
    as padded with zeros.  Means and covariance are those of the distinct x vectors (n of them); null and repeated
    ids and repeated rows are kept as rows.  Components of zero variance cannot be scaled and are left out, so a
    table of one distinct vector, of empty vectors, or without rows gives an empty result, and one of fewer than
    ``k`` dimensions fewer components.  Equal eigenvalues have no order of their own: any orthonormal choice
    is right, and the same one is made for all rows.  Other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType
    x = bitslice.quantised(F.col(vec_col), factor)
    kept = rows.select(F.col(id_col).alias("id"), x.alias("x")).where("x IS NOT NULL")
    fit = storage.written(kept.select("x").distinct(), "fit-list")
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
    sums = _summed(fit, None, dims) if dims else {}
    n = sums.get((-1, -1), 0)
    s = [sums.get((i, -1), 0) for i in range(dims)]
    centre = [(2 * t + n) // (2 * n) for t in s] if n else []
    rest = [t - n * c for t, c in zip(s, centre, strict=False)]
    v = np.zeros((dims, dims))
    if n:
        products = _summed(fit, centre, dims)
        for (i, j), p in products.items():
            v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    e, u = leading(v, k)
    if len(e) == 0:
        storage.drop(fit)
        return spark.createDataFrame([], schema)
    shift = np.array([r / n for r in rest])
    scale = u / np.sqrt(e)
    explained = [float(t / np.trace(v)) for t in e]

    def projected(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = _minus(_padded(lists, dims), centre)
        return y, (y.astype(np.float64) - shift) @ scale

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(e) + 1, len(e)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                _, w = projected(batch.column(0).slice(at, ROWS))
                total += np.concatenate([w.sum(axis=0, keepdims=True), w.T @ w])
        at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel().astype(np.int32)), pa.array(at[1].ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    got = np.zeros((len(e) + 1, len(e)))
    for i, j, t in fit.select("x").mapInArrow(measured, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        got[i, j] = t / n
    error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(len(e))).max())
    storage.drop(fit)
    m = len(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y, w = projected(batch.column(1).slice(at, ROWS))
                ids = batch.column(0).slice(at, ROWS)
                most = n * max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))) + max(map(abs, rest))
                z = y.astype(np.int64 if most * most * dims < 2**63 else object) * n - np.array(rest, dtype=np.int64 if most < 2**62 else object)
                deviation = (z * z).sum(axis=1)
                spread = pa.array(deviation).cast(pa.decimal128(38, 0)) if deviation.dtype == np.int64 else _decimals(list(deviation))
                again = pa.array(np.repeat(np.arange(len(w), dtype=np.int32), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(again),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(w))),
                        pa.array(np.full(len(w) * m, n, dtype=np.int64)),
                        spread.take(again),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(w))),
                        pa.array(np.full(len(w) * m, error)),
                    ],
                    names=schema.names,
                )

    return kept.mapInArrow(work, schema)
