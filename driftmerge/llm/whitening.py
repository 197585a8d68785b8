"""Whitening of embeddings by LOBPCG.

Entries become whole numbers, x = floor(scale * entry) + shift, so that their number n and the sums S are exact. The covariance
V is never formed: each step multiplies a block of directions by it in one pass over all rows, which are centred first and
exactly, as (n x - S) / n. Tasks add their rows' products up, groups of tasks' products are added by tasks again, and the driver gets at most
``MEETING`` blocks of dimensions x directions, whatever the number of rows.

A step is a Rayleigh-Ritz approximation on the iterate, its residuals and the directions of the step before, made orthonormal.
Some guard directions beyond the components wanted keep the last of those from converging slowly. The iteration ends when the residuals
of all components, from a product with the final vectors, are below ``TOLERANCE`` times the largest eigenvalue; an eigenvalue lies within
its residual of the value given (Weyl). If it doesn't get there in ``MOST_STEPS``, it raises an error.

Defined results: rows whose vector is null, empty or holds a null or an entry that isn't finite are left out, as are those
whose length isn't that of most vectors (of equally many, the longer); ids may be null and repeat, every row counts; components whose
eigenvalue is zero to double precision can't be whitened and are left out, so equal vectors, and a table without rows, give none.
An entry whose x doesn't fit a long, or a row whose deviation doesn't, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import table

COMPONENTS, GUARDS, SCALE, SHIFT = 32, 8, 64, 1_000_000
TOLERANCE, MOST_STEPS, MEETING = 1e-12, 500, 32


def vectors(column: pa.Array, dimensions: int | None = None, scale: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and x of those; with no dimensions given, how long the vectors of all rows are, -1 for those that don't count."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    body = column.flatten()
    value = body.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(value))]
    end = np.cumsum(size)
    fine = (size > 0) & (bad[end] == bad[end - size])
    if dimensions is None:
        return fine, np.where(fine, size, -1)
    fine &= size == dimensions
    x = np.floor(scale * value[np.repeat(fine, size)])
    if len(x) and np.abs(x).max() > 2**62:
        raise OverflowError("an entry is too large to be a whole number")
    return fine, (x.astype(np.int64) + shift).reshape(int(fine.sum()), dimensions)


@dataclass
class Whitening:
    """n, the sums of each dimension, the components (a column each) with eigenvalues and residuals, and the trace of V."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    steps: int
    scale: int = SCALE
    shift: int = SHIFT

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which rows count, and n x - S of those, exact."""
        fine, x = vectors(column, len(self.sums), self.scale, self.shift)
        return fine, self.n * x - self.sums

    def whitened(self, off: np.ndarray) -> np.ndarray:
        return (off / self.n) @ (self.components / np.sqrt(self.values))


def added(rows: DataFrame, column: str, make: Callable[[pa.Array], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what `make` gives for each batch of vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += make(batch.column(0))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    def meet(parts: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for cell in parts.sort_by("task").column("total"):  # in a fixed order, so that a second run gives the same
            total += np.frombuffer(cell.as_buffer()).reshape(shape)
        return pa.table([parts.column("task")[:1], pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    parts = rows.select(column).mapInArrow(part, "task int, total binary")
    met = parts.groupBy(F.pmod("task", F.lit(MEETING))).applyInArrow(meet, "task int, total binary").collect()
    return sum((np.frombuffer(bytes(r.total)).reshape(shape) for r in sorted(met, key=lambda r: r.task)), np.zeros(shape))


def counted(rows: DataFrame, column: str, scale: int, shift: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sums of their dimensions."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, many = np.unique(vectors(batch.column(0))[1], return_counts=True)
            yield pa.record_batch([pa.array(size), pa.array(many.astype(np.int64))], ["size", "many"])

    sizes = rows.select(column).mapInArrow(lengths, "size long, many long").filter("size > 0").groupBy("size").agg(F.sum("many").alias("many"))
    most = sizes.orderBy(F.desc("many"), F.desc("size")).first()
    if most is None:
        return 0, np.zeros(0, np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most.size, np.int64)
        for batch in batches:
            total += vectors(batch.column(0), most.size, scale, shift)[1].sum(0)
        yield pa.record_batch([pa.array(np.arange(most.size)), pa.array(total)], ["dimension", "total"])

    held = rows.select(column).mapInArrow(sums, "dimension long, total long").groupBy("dimension").agg(F.sum("total").alias("total")).collect()
    return most.many, np.array([r.total for r in sorted(held, key=lambda r: r.dimension)], np.int64)


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal directions of a block beyond those it is held against; what is rounding alone is left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for a in against:
            block = block - a @ (a.T @ block)
        if not block.shape[1]:
            return block
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10 * max(1.0, size[0])]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, guards: int = GUARDS, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The largest eigenvalues of a positive matrix given by its product with a block: values, vectors, certified residuals and steps."""
    wanted = min(wanted, dimensions)
    many = min(dimensions, wanted + guards)
    x = orthonormal(np.random.default_rng(seed).standard_normal((dimensions, many)))
    ax, before = product(x), np.zeros((dimensions, 0))
    for step in range(most_steps):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax = x @ turn[:, ::-1], ax @ turn[:, ::-1]
        values = values[::-1]
        residual = ax - x * values
        if (np.linalg.norm(residual[:, :wanted], axis=0) <= tolerance * max(values[0], 0)).all():
            x = orthonormal(x)
            ax = product(x)  # not what the steps carried on, but the vectors as they are now
            small, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
            x, ax, values = x @ turn[:, ::-1], ax @ turn[:, ::-1], small[::-1]
            residual = ax - x * values
            held = np.linalg.norm(residual[:, :wanted], axis=0)
            if (held <= tolerance * max(values[0], 0)).all():
                return values[:wanted], x[:, :wanted], held, step + 1
        fresh = orthonormal(residual, x)
        fresh = np.hstack([fresh, orthonormal(before, x, fresh)])
        if not fresh.shape[1]:
            ax = product(x)
            continue
        basis, image = np.hstack([x, fresh]), np.hstack([ax, product(fresh)])
        small, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        turn = turn[:, ::-1][:, :many]
        before = fresh @ turn[many:]
        x, ax = basis @ turn, image @ turn
    raise RuntimeError(f"residuals are above the tolerance after {most_steps} steps")


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of all vectors of a table."""
    n, sums = counted(rows, column, scale, shift)
    d = len(sums)
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, 0, scale, shift)
    if not n:
        return model

    def product(block: np.ndarray) -> np.ndarray:
        def make(batch: pa.Array) -> np.ndarray:
            off = model.centred(batch)[1] / n
            return off.T @ (off @ block)

        return added(rows, column, make, block.shape) / n

    model.trace = float(added(rows, column, lambda batch: ((model.centred(batch)[1] / n) ** 2).sum(keepdims=True)[0], (1,))[0] / n)
    if model.trace > 0:
        values, basis, residuals, steps = lobpcg(product, d, components)
        kept = values > 4 * d * np.finfo(float).eps * values[0]
        model = Whitening(n, sums, basis[:, kept], values[kept], residuals[kept], model.trace, steps, scale, shift)
    return model


def identity_error(rows: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest entry of the whitened rows' covariance minus the identity, in absolute value, measured over all rows."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = added(rows, column, lambda batch: model.whitened(model.centred(batch)[1]).sum(0), (k,)) / model.n

    def make(batch: pa.Array) -> np.ndarray:
        w = model.whitened(model.centred(batch)[1]) - mean
        return w.T @ w

    return float(np.abs(added(rows, column, make, (k, k)) / model.n - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Whitening, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    error = identity_error(rows, model, column)
    k = len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, off = model.centred(batch.column(1))
            ids = batch.column(0).filter(pa.array(fine))
            if not k or not len(ids):
                continue
            if (off.astype(float) ** 2).sum(1).max() > 2**62:
                raise OverflowError("a deviation is too large to be a long")
            at, m = np.repeat(np.arange(len(ids)), k), len(ids)
            cells = [ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array((off * off).sum(1)[at])]
            cells += [pa.array(model.whitened(off).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.record_batch(cells, [x.split()[0] for x in WHITENED.split(", ")])

    return rows.select(F.col(id_column).cast("long").alias("vec_id"), column).mapInArrow(run, WHITENED)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return transform(rows, fit(rows))
