"""Whitening of embeddings by their leading principal components, found with Jacobi-Davidson.

Entries become whole numbers, x = floor(256 * c), and the distinct x-vectors are the fit list.
Its covariance V is never built: a pass over the written fit list centres each block of
vectors and gives V times a few columns at once, summed in Spark, so the driver holds some
columns of the length of a vector and nothing else. Rayleigh-Ritz on the subspace gives the
wanted pairs; each that has not converged is corrected by a few steps of MINRES on the
equation projected away from all wanted and locked vectors, all in lockstep, one pass per step.
A pair whose residual has reached `EXACT` of the largest eigenvalue is locked.

A lost executor costs the blocks it was reading: every pass starts from the written table.

Defined results: a vector that is null, or holds a null, a non-finite entry or one beyond
`LARGEST` (x would not be exact in double precision), gives no row, nor does one whose
length is not that of most others (of equally many, the longest). A null vec_id stays null.
Repeated rows each give their rows; in the fit list a vector stands once. A component
without variance is not given, so one distinct vector, or none, gives no rows. A deviation
that no long can hold is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut

COMPONENTS = 4
SCALE = 256
LARGEST = 2.0**45
INNER = 6  # steps of MINRES per correction
SUBSPACE = 32  # vectors of the subspace at most; then it starts anew from the best
SEED = 11
EPS = float(np.finfo(np.float64).eps)
EXACT = 64 * EPS
STALLED = 6  # corrections without a smaller residual
_WIDTHS = (np.int16, np.int32, np.int64)

Product = Callable[[np.ndarray], np.ndarray]


def vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x: the rows that count, as whole numbers."""
    entries = F.col("c").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("c"))
    fits = F.forall(entries, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))  # NaN exceeds all
    rows = rows.where(F.col("c").isNotNull()).where(fits)
    return rows.select("vec_id", F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _usual_length(rows: DataFrame) -> int:
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"] or 0


def _stack(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def fit_list(rows: DataFrame, d: int) -> DataFrame:
    """The distinct vectors as a written table of blocks: rows, packed numbers of the narrowest width."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch, d)
            width = next(w for w in _WIDTHS if not len(x) or np.array_equal(x.astype(w), x))
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int32()), pa.array([x.astype(width).tobytes()])], names=["rows", "block"]
            )

    return cut(rows.select("x").distinct().mapInArrow(pack, "rows int, block binary"))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    kinds = {np.dtype(w).itemsize: w for w in _WIDTHS}
    for batch in batches:
        for rows, block in zip(batch.column("rows").to_pylist(), batch.column("block").to_pylist()):
            if rows:
                yield np.frombuffer(block, kinds[len(block) // (rows * d)]).reshape(rows, d)


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * d
        for x in _blocks(batches, d):
            # Halves of 32 bits: their sums stay exact for any number of rows that a block holds.
            high, low = (x.astype(np.int64) >> 32).sum(axis=0), (x.astype(np.int64) & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low)]
            count += len(x)
        if count:
            yield pa.RecordBatch.from_pydict(
                {"at": pa.array(range(-1, d), pa.int32()), "total": pa.array([count, *total], pa.decimal128(38, 0))}
            )

    sums = fit.mapInArrow(add, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    found = {r["at"]: int(r["total"]) for r in sums.collect()}  # a row per dimension
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


def _summed(fit: DataFrame, mean: np.ndarray, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One pass: the sum over all blocks of `of(centred block)`, an array of `shape`."""
    d = len(mean)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _blocks(batches, d):
            total += of(x - mean)
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size, dtype=np.int32), "part": total.ravel()})

    sums = fit.mapInArrow(add, "at int, part double").groupBy("at").agg(F.sum("part").alias("total"))
    found = sums.toArrow()
    total = np.zeros(int(np.prod(shape)))
    total[found.column("at").to_numpy()] = found.column("total").to_numpy()
    return total.reshape(shape)


def _minres(product: Product, right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Each column of `right` solved by itself, one product a step for all."""

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    def size(a: np.ndarray) -> np.ndarray:
        return np.broadcast_to(np.linalg.norm(a, axis=0), a.shape).copy()

    solved, before, far, near = (np.zeros_like(right) for _ in range(4))
    zero, one = np.zeros_like(right), np.ones_like(right)
    start = size(right)
    left, link, now = start, zero, over(right, start)
    (c, s), (c_old, s_old) = (one, zero), (one, zero)
    for _ in range(steps):
        grown = product(now)
        along = np.broadcast_to((now * grown).sum(axis=0), right.shape)
        grown = grown - along * now - link * before
        ahead = size(grown)
        # The new column of the tridiagonal matrix under the last two rotations and a new one.
        corner = c * along - c_old * s * link
        second, third = s * along + c_old * c * link, s_old * link
        pivot = np.hypot(corner, ahead)
        (c_old, s_old), (c, s) = (c, s), (over(corner, pivot), over(ahead, pivot))
        far, near = near, over(now - third * far - second * near, pivot)
        solved = solved + c * left * near
        left = -s * left
        before, now, link = now, over(grown, ahead), ahead
        if not (np.abs(left) > tolerance * start).any():
            break
    return solved


def _added(basis: np.ndarray, found: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `found` adds to `basis`."""
    for _ in range(2):
        found = found - basis @ (basis.T @ found)
        norms = np.linalg.norm(found, axis=0)
        found = found[:, norms > 0] / norms[norms > 0]
    if not found.size:
        return found
    left, values, _ = np.linalg.svd(found, full_matrices=False)
    left = left[:, values > 1e-8]
    left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0] if left.size else left


def jacobi_davidson(product: Product, d: int, wanted: int, inner: int = INNER, subspace: int = SUBSPACE) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors of the symmetric `product`."""
    wanted = min(wanted, d)
    subspace = max(subspace, 4 * wanted)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, min(d, 2 * wanted))))[0]
    image = product(basis)
    locked, values = np.zeros((d, 0)), []
    rounds, stalled, least = 0, 0, np.inf
    while True:
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        basis, image, theta = basis @ turn[:, ::-1], image @ turn[:, ::-1], theta[::-1]
        need = wanted - len(values)
        residual = image[:, :need] - basis[:, :need] * theta[:need]
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0) / max(abs(theta[0]), *(abs(v) for v in values), np.finfo(float).tiny)
        stalled = 0 if sizes.max() < least else stalled + 1
        least = min(least, sizes.max())
        # A subspace that is the whole space is exact; a residual that rounding holds up cannot fall further.
        settled = basis.shape[1] + len(values) == d or (stalled >= STALLED and sizes.max() <= d * EXACT)
        done = need if settled else int(np.argmax(np.append(sizes > EXACT, True)))
        if done:
            locked, values = np.hstack([locked, basis[:, :done]]), [*values, *theta[:done]]
            basis, image, theta, residual = basis[:, done:], image[:, done:], theta[done:], residual[:, done:]
            need, least, stalled = need - done, np.inf, 0
            if not need:
                return np.array(values), locked
        if basis.shape[1] + need > subspace:
            kept = max(2 * wanted, subspace // 3)
            basis, image, theta = basis[:, :kept], image[:, :kept], theta[:kept]
        aside, shift = np.hstack([locked, basis[:, :need]]), theta[:need]

        def project(columns: np.ndarray) -> np.ndarray:
            columns = columns - aside @ (aside.T @ columns)
            return columns - aside @ (aside.T @ columns)

        rounds += 1
        correction = _minres(lambda v: project(product(v) - v * shift), project(-residual), inner, 0.5**rounds)
        fresh = _added(np.hstack([locked, basis]), correction)
        if not fresh.shape[1]:  # the correction holds nothing new: any direction will do
            fresh = _added(np.hstack([locked, basis]), np.random.default_rng(SEED + rounds).standard_normal((d, need)))
        basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: exact sums, components as columns, their eigenvalues and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Learns from the distinct vectors of `rows` (vec_id, x), all of length `d`."""
    nothing = Whitening(0, [0] * d, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not d:
        return nothing
    blocks = fit_list(rows, d)
    n, sums = _totals(blocks, d)
    if n < 2:
        return nothing
    mean = np.array([(s // n) + (s % n) / n for s in sums])
    trace = float(_summed(blocks, mean, (d,), lambda x: np.square(x).sum(axis=0)).sum()) / n

    def product(columns: np.ndarray) -> np.ndarray:
        return _summed(blocks, mean, columns.shape, lambda x: x.T @ (x @ columns)) / n

    values, found = jacobi_davidson(product, d, components)
    # Once more over the found vectors together: their order and values as accurate as a product is.
    image = product(found)
    values, turn = np.linalg.eigh((found.T @ image + image.T @ found) / 2)
    values, found = values[::-1], found @ turn[:, ::-1]
    some = values > d * EPS * trace
    values, found = values[some], found[:, some]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(values))])
    k = len(values)
    scaled = found / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    seen = _summed(blocks, mean, (k + 1, k), moments) / n
    covariance = seen[:k] - np.outer(seen[k], seen[k])
    error = float(np.abs(covariance - np.eye(k)).max()) if k else 0.0
    return Whitening(n, sums, found, values, values / trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n*x-S)^2; None where no long can hold it."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if x.shape[1] * largest**2 < 1 << 63:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component."""
    d, k = model.components.shape
    mean = np.array([(s // model.n) + (s % model.n) / model.n for s in model.sums]) if model.n else np.zeros(d)
    scaled = model.components / np.sqrt(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x, rows_in = _stack(batch, d), batch.num_rows
            at = pa.array(np.repeat(np.arange(rows_in), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(at),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_in)),
                "n": pa.array(np.full(rows_in * k, model.n, np.int64)),
                "deviation": pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(at),
                "whitened": ((x - mean) @ scaled).ravel(),
                "explained": np.tile(model.explained, rows_in),
                "identity_error": np.full(rows_in * k, model.identity_error),
            })

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(work, schema)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that counts."""
    rows = vectors(embeddings)
    d = _usual_length(rows)
    rows = rows.where(F.size("x") == d)
    return apply(rows, fit(rows, d, components))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
