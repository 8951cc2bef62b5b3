"""Whitening of vectors by the leading components of their covariance, which is never formed.

Entries are whole numbers x = floor(UNIT * c) + SHIFT. The components are fitted on each distinct x vector once: block
Lanczos with full reorthogonalisation asks Spark for products of the covariance with a block of vectors. A pass centres
each row, then adds Xt(X v) over the rows of a task; the tasks' sums, of dimensions x block numbers each, are added by a
few tasks before the driver adds those. A block that has lost rank (a breakdown) goes on with random directions; the
search ends when the residuals of all wanted components are below TOLERANCE of the largest eigenvalue, or when the basis
spans the space. Sums and deviations are exact whole numbers; the trace is the sum of deviations, so explained shares need
no pass of their own.

A vector that is null or empty, or holds an entry that is null, not finite or beyond LARGEST, takes no part, nor does one
that isn't as long as most vectors (the shorter of equally frequent lengths). Other rows stay, whatever their id: null
ids, repeated ids and repeated rows are rows each. A component whose eigenvalue is at most ZERO of the largest one, as all
are where there is one distinct vector, can't be scaled and is left out. Equal eigenvalues leave their components' order
and directions open; one choice holds for all rows. Columns besides vec_id and embedding aren't read. An empty table gives
no rows. The driver holds dimensions x dimensions numbers at most, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import map_batches
from .lineage import stored

UNIT, SHIFT, LARGEST = 64, 1_000_000, 2.0**40
TOLERANCE, ZERO = 1e-14, 1e-12
#: Rows that a task multiplies at a time, and tasks that add the sums of all others.
ROWS, COMBINERS = 4096, 16


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where(e.isNotNull() & (F.size(e) > 0) & fine)
    length = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(UNIT)) * c) + F.lit(SHIFT).cast("long"))
    return rows.where(F.size("embedding") == (length["length"] if length else 0)).select("vec_id", x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The x vectors, ROWS at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            x = batch.column("x").slice(i, ROWS)
            yield x.flatten().to_numpy().reshape(len(x), -1)


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of part(x) over blocks of the rows' x; None without rows. Whole numbers have to fit 64 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches):
            now = part(x)
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([total.dtype.str]), pa.array([list(total.shape)], pa.list_(pa.int64()))], ["sum", "kind", "shape"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                now = np.frombuffer(row["sum"], row["kind"])
                total, kept = now if total is None else total + now, row
        if total is not None:
            yield pa.RecordBatch.from_pylist([kept | {"sum": total.tobytes()}])

    schema = "sum binary, kind string, shape array<long>"
    rows = map_batches(map_batches(fit, add, schema).repartition(COMBINERS), again, schema).collect()
    return sum(np.frombuffer(r["sum"], r["kind"]) for r in rows).reshape(rows[0]["shape"]) if rows else None


def orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Unit vectors orthogonal to the basis and each other, spanning the block; directions it lacks are random ones.

    As many as the block has columns, or as the space has room for.
    """
    found = basis
    for k in range(min(block.shape[1], len(block) - basis.shape[1])):
        v, size = block[:, k], np.linalg.norm(block[:, k])
        while True:
            for _ in range(3):
                v = v - found @ (found.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size:
                break
            v = random.normal(size=len(block))  # a breakdown: go on with a new direction
            size = np.linalg.norm(v)
        found = np.column_stack((found, v / left))
    return found[:, basis.shape[1] :]


def leading(product: Callable[[np.ndarray], np.ndarray], dimensions: int, k: int, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their eigenvectors (columns) of a symmetric matrix known by its products."""
    random = np.random.default_rng(seed)
    k = min(k, dimensions)
    block = random.normal(size=(dimensions, k))
    basis, images = np.empty((dimensions, 0)), np.empty((dimensions, 0))
    while True:
        block = orthonormal(block, basis, random)
        image = product(block)
        basis, images = np.column_stack((basis, block)), np.column_stack((images, image))
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        residuals = np.linalg.norm(images @ turn - vectors * values, axis=0)
        if basis.shape[1] == dimensions or (residuals <= tolerance * values[0]).all():
            vectors = vectors / np.linalg.norm(vectors, axis=0)
            return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1, 1)
        block = image


@dataclass
class Whitening:
    """n distinct vectors, their mean as whole numbers and remainders (mean = base + rest / n), and the components."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Per row the sum of (n * x - sum of x)**2 over dimensions, exact: 64-bit numbers, or Python's where those don't do."""
        off = x - self.base
        widest = self.n * (max(int(off.max(initial=0)), -int(off.min(initial=0))) + 1)
        if widest**2 * x.shape[1] >= 1 << 63:
            return ((off.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(1)
        return ((off * self.n - self.rest) ** 2).sum(1)


def _low_high(x: np.ndarray) -> np.ndarray:
    """Sums of the numbers' low and high parts by dimension, and in the last place how many rows there are."""
    high, low = x >> 20, x & ((1 << 20) - 1)
    return np.append(np.stack((low.sum(0), high.sum(0))), [[len(x)], [0]], 1)


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening by the leading components of fit's distinct x vectors; None without rows."""
    sums = summed(fit, _low_high)
    if sums is None:
        return None
    n = int(sums[0, -1])
    whole = [int(low) + (int(high) << 20) for low, high in sums[:, :-1].T]
    model = Whitening(n, np.array([s // n for s in whole]), np.array([s % n for s in whole]), np.empty((len(whole), 0)), np.empty(0), np.empty(0), 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        return summed(fit, lambda x: (c := model.centred(x)).T @ (c @ block)) / n

    # deviations may exceed 64 bits together: sums of their low, middle and high parts
    parts = lambda d: np.array([int(v) for v in ((d & 0xFFFFFFFF).sum(), ((d >> 32) & 0xFFFFFFFF).sum(), (d >> 64).sum())]) if d.dtype == object else np.array([(d & 0xFFFFFFFF).sum(), (d >> 32).sum(), 0])
    low, middle, high = (int(v) for v in summed(fit, lambda x: parts(model.deviations(x))))
    trace = (low + (middle << 32) + (high << 64)) / n**3
    values, vectors = leading(product, len(whole), components)
    good = values > max(ZERO * values[0], 0)
    if not trace or not good.any():
        return model
    model.values, model.vectors, model.explained = values[good], vectors[:, good], values[good] / trace
    middle = summed(fit, lambda x: model.whitened(x).sum(0)) / n
    spread = summed(fit, lambda x: (w := model.whitened(x) - middle).T @ w) / n
    model.identity_error = float(np.abs(spread - np.eye(len(model.values))).max())
    return model


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Per row that takes part and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    n is the number of distinct x vectors, deviation the row's sum of (n * x - sum of x)**2 over dimensions, whitened its
    centred x projected on the component and divided by the root of the eigenvalue, explained the eigenvalue's share of
    the trace, identity_error the largest entry by which the whitened fit rows' covariance differs from the identity.
    """
    rows = whole_vectors(vectors)
    model = fit_whitening(stored(rows.select("x").distinct()), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                k = len(model.values)
                deviation = pa.array([int(d) for d in model.deviations(x)], pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(len(x)), k))
                size = len(x) * k
                columns = [part.column("vec_id").take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(size, model.n), deviation.take(at)]
                columns += [model.whitened(x).ravel(), np.tile(model.explained, len(x)), np.full(size, model.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return map_batches(rows, run, schema)
