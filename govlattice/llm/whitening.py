"""Whitened principal components of vectors, from an exact covariance and refined eigenvectors.

Entries become whole numbers, x = floor(256 * c), so sums and products over
the distinct vectors are exact: whatever the partitions and their order, the
covariance is the same to the last bit. Its eigenvectors are computed in single
precision first and then corrected by the iteration of Ogita and Aishima, which
needs matrix products in higher precision only. Eigenvalues too close together
for that are rotated by an eigenproblem of their own subspace in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlattice.session import bounded_rows, cut_lineage

SCALE = 256
# Larger entries have no 64-bit whole number.
MOST = float(1 << 54)
# Vectors may have this many dimensions: the driver holds the covariance matrix.
DIMENSIONS = 4_096
# Whole numbers that a double holds without rounding.
EXACT = 1 << 53
LIMB = 20
ROWS = 4_096


def exact_gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers, exactly, as Python integers.

    Products and sums stay below 2^53, so the matrix products of doubles do not
    round; larger entries are split into limbs first.
    """
    size = y.shape[1]
    total = np.zeros((size, size), object)
    largest = int(np.abs(y).max(initial=0))
    limbs = [y]
    if largest * largest * ROWS >= EXACT:
        limbs = []
        while largest:
            limbs.append(y & ((1 << LIMB) - 1))
            y, largest = y >> LIMB, largest >> LIMB
        limbs.append(y)  # the signs
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs[: i + 1]):
            part = np.zeros((size, size), object)
            for at in range(0, len(y), ROWS):
                part += (a[at : at + ROWS].T.astype(float) @ b[at : at + ROWS].astype(float)).astype(np.int64)
            total += (part if i == j else part + part.T) << (LIMB * (i + j))
    return total


def exact_dot(y: np.ndarray, other: list[int]) -> np.ndarray:
    """``y @ other`` of whole numbers, exactly."""
    bound = int(np.abs(y).max(initial=0)) * max(map(abs, other), default=0) * max(1, len(other))
    if bound < 1 << 62:
        return y @ np.array(other, np.int64)
    return y.astype(object) @ np.array(other, object)


def _state(a: np.ndarray, x: np.ndarray) -> tuple:
    """Vectors by falling eigenvalue, what they lack in orthogonality and diagonality, and the gap that can be trusted."""
    r, s = np.eye(len(a), dtype=a.dtype) - x.T @ x, x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    r, s = r[np.ix_(order, order)], s[np.ix_(order, order)]
    off = s - np.diag(np.diag(s))
    reach = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    return x[:, order], r, off, values[order], reach


def refined_eigenvectors(a: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix, in extended precision."""
    size = len(a)
    a = a.astype(np.longdouble)
    scale = np.abs(a).max()
    if not scale > 0:
        return np.zeros(size, np.longdouble), np.eye(size, dtype=np.longdouble)
    a = a / scale
    unit = np.eye(size, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    for _ in range(2):
        x = x + x @ (unit - x.T @ x) / 2
    small = np.finfo(np.longdouble).eps * 8
    last = np.inf
    for _ in range(rounds):
        x, r, off, values, reach = _state(a, x)
        turned = False
        borders = np.flatnonzero(values[:-1] - values[1:] > reach) + 1
        for lo, hi in zip([0, *borders], [*borders, size]):
            block = off[lo:hi, lo:hi]
            if hi - lo == 1 or np.abs(block).max() <= small:
                continue
            # The subspace's own eigenproblem, moved to zero: its differences now count in full.
            inner = block + np.diag(values[lo:hi] - values[lo:hi].mean())
            own = np.linalg.eigh((inner / np.abs(inner).max()).astype(float))[1][:, ::-1]
            x[:, lo:hi] = x[:, lo:hi] @ own.astype(np.longdouble)
            turned = True
        if turned:
            x, r, off, values, reach = _state(a, x)
        gap = values[None, :] - values[:, None]
        # Pairs that are too close for now only become orthogonal.
        apart = np.abs(gap) > reach
        step = np.where(apart, (off + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        np.fill_diagonal(step, np.diag(r) / 2)
        x = x + x @ step
        change = np.abs(step).max()
        # Each round squares the error, down to the rounding of the products over the smallest gap.
        if not turned and (change <= small or (last < 1e-10 and change > last / 2)):
            break
        last = np.inf if turned else change
    x = x + x @ (unit - x.T @ x) / 2
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


@dataclass(frozen=True)
class Components:
    """What tasks need to project a vector: integer centre, sums beyond it, directions and eigenvalues."""

    n: int
    centre: np.ndarray  # whole numbers next to the means
    beyond: list[int]  # sums of x less n times the centre
    directions: np.ndarray  # dimension x component
    values: np.ndarray
    trace: float

    def whitened(self, y: np.ndarray) -> np.ndarray:
        rest = np.array([g / self.n for g in self.beyond])
        return (y - rest) @ (self.directions / np.sqrt(self.values))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            n += len(x)
            safe = int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 62
            total += x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), _decimals([n, *total])], ["i", "v"])

    parts = fit.mapInArrow(work, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
    found = {r["i"]: int(r["v"]) for r in bounded_rows(parts, DIMENSIONS + 1, "dimensions")}
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def _products(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    size = len(centre)
    upper = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = exact_gram(_matrix(batch.column(0), size) - centre)
            total = part if total is None else total + part
        if total is not None:
            at = [pa.array(u.astype(np.int32)) for u in upper]
            yield pa.RecordBatch.from_arrays([*at, _decimals(total[upper])], ["i", "j", "v"])

    parts = fit.mapInArrow(work, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((size, size), object)
    for r in parts.collect():  # one row for each pair of dimensions
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = int(r["v"])
    return total


def _extended(top: int, bottom: int) -> np.longdouble:
    """A quotient of whole numbers to the precision of two doubles."""
    high = top / bottom
    return np.longdouble(high) + np.longdouble(float(Fraction(top, bottom) - Fraction(high)))


def fit_components(fit: DataFrame, size: int, most: int) -> Components | None:
    """Leading components of the distinct vectors ``x``; None without vectors or without variance."""
    n, sums = _sums(fit, size)
    if not n:
        return None
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    beyond = [s - n * int(c) for s, c in zip(sums, centre)]
    products = _products(fit, centre)
    covariance = np.zeros((size, size), np.longdouble)
    for i in range(size):
        for j in range(i + 1):
            covariance[i, j] = covariance[j, i] = _extended(n * products[i, j] - beyond[i] * beyond[j], n * n)
    values, vectors = refined_eigenvectors(covariance)
    trace = np.trace(covariance)
    found = int((values[:most] > trace * size * np.finfo(float).eps).sum())
    if not found:
        return None
    vectors = vectors[:, :found]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(found)])
    return Components(
        n, centre, beyond, (vectors * signs).astype(float), values[:found].astype(float), float(trace)
    )


def _identity_error(fit: DataFrame, model: Components) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    size, width = len(model.centre), len(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + width * width)
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0), size) - model.centre)
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    parts = fit.mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    sums = np.array([r["v"] for r in parts]) / model.n
    means, products = sums[:width], sums[width:].reshape(width, width)
    return float(np.abs(products - np.outer(means, means) - np.eye(width)).max())


def whiten(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4
) -> DataFrame:
    """One row for each vector and leading component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    The model is fitted to each distinct vector of whole numbers once; every
    vector is projected, repeated ones and repeated ids too. Left out are null
    and empty vectors, those with a null, non-finite or (2^54 and more) too
    large entry, and those whose length is not the one that most distinct
    vectors have (ties: the longer). Components without variance have no rows,
    so vectors that are all equal, and an empty table, give none. Of equal
    eigenvalues any basis is taken; a component's largest entry is positive.
    ``deviation`` is a decimal of 38 digits (null beyond), the rest of the sums
    is exact at any size. Other columns are not read.
    """
    entry = F.col(vector_column)
    fine = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < MOST) & ~F.isnan(c))
    rows = vectors.filter(F.coalesce(fine & (F.size(entry) > 0), F.lit(False))).select(
        F.col(id_column).alias("_id"),
        F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE)).alias("_x"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    schema = (
        f"_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double,"
        " identity_error double"
    )
    renamed = {"_id": id_column}
    distinct = cut_lineage(rows.select("_x").distinct())
    lengths = distinct.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    size = usual[0]["d"] if usual else 0
    if size > DIMENSIONS:
        raise ValueError(f"vectors of more than {DIMENSIONS} dimensions")
    fit = distinct.filter(F.size("_x") == size)
    model = fit_components(fit, size, components) if size else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnsRenamed(renamed)
    error = _identity_error(fit, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.values)
        rest = sum(g * g for g in model.beyond)
        for batch in batches:
            many = batch.num_rows
            if not many:
                continue
            y = _matrix(batch.column(1), size) - model.centre
            # (n * x - S)^2 in terms of what the centre leaves.
            largest = int(np.abs(y).max())
            squares = (y * y if largest**2 * size < 1 << 62 else y.astype(object) ** 2).sum(axis=1)
            across = exact_dot(y, model.beyond)
            exact = [model.n**2 * int(q) - 2 * model.n * int(p) + rest for q, p in zip(squares, across)]
            held = [Decimal(v) if v < 10**38 else None for v in exact]
            at = np.repeat(np.arange(many), width)
            arrays = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), many)),
                pa.array(np.full(many * width, model.n)),
                pa.array(held, pa.decimal128(38, 0)).take(pa.array(at)),
                pa.array(model.whitened(y).ravel()),
                pa.array(np.tile(model.values / model.trace, many)),
                pa.array(np.full(many * width, error)),
            ]
            names = ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.filter(F.size("_x") == size).mapInArrow(work, schema).withColumnsRenamed(renamed)
