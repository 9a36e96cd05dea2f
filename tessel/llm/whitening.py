"""Embedding whitening: the first principal components by matrix-free block Lanczos, rows projected on them.

Entries become integers x = floor(64 c) + 1000000. The fit list holds each distinct x vector once; its
size n and sums S are exact, so a centred vector is (n x - S) / n of exact integers. The covariance is
never formed: one pass over the fit list multiplies it with a block of vectors (every task sums
Xᵀ(X B) of its centred rows, Spark adds the tasks' d x b matrices). The driver holds the Krylov basis
and its products, d x d numbers at most. Every new block is orthogonalised against the whole basis,
twice. Where a block loses rank, an invariant subspace is complete and fresh random vectors
orthogonal to the basis go on in its place. The search ends when the residuals of the wanted pairs
are below `TOLERANCE` of the largest eigenvalue, or when the basis spans all dimensions. The trace
comes from the rows' deviations, not from eigenvalues.

Odd input: vectors that are null, or hold null or non-finite entries, or entries of 2**46 and more in
size (their x isn't exact), are dropped. Vectors of several lengths can't share a covariance: those
of the most frequent length (the longest of equally frequent ones) are kept, vectors of length 0 are
dropped. Repeated and null vec_ids keep a row each. Components without variance (an eigenvalue below
`NO_VARIANCE` of the trace) can't be whitened and give no rows: a table of equal vectors gives none.
A deviation beyond the range of a long is null. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, table

#: Components asked for, and vectors multiplied in one pass.
COMPONENTS, BLOCK = 16, 16
#: Residual that ends the search, relative to the largest eigenvalue; least eigenvalue, relative to the trace.
TOLERANCE, NO_VARIANCE = 1e-13, 1e-13
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 46


def integer_rows(vectors: DataFrame, vec: str = "embedding", carry: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns `carry` and x (array of long, without the shift, which centring takes out) of the rows that can be used."""
    entry = F.col(f"`{vec}`").cast("array<double>")
    sound = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda c: F.coalesce(F.abs(c) < float(MOST), F.lit(False)) & ~F.isnan(c))
    rows = vectors.select(*carry, entry.alias("e")).where(sound)
    lengths = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    return rows.where(F.size("e") == d).select(*carry, F.transform("e", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Moments:
    """n and the per-dimension sums (with the shift) of the fit list, as Python integers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S of each row; exact, as integers of Python where 64 bits may not do."""
        total = [s - self.n * SHIFT for s in self.sums]
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
        kind = np.int64 if largest < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(total, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n x - S)^2 of each row; None beyond the range of a long."""
        part = self.scaled(x)
        near = (part.astype(np.float64) ** 2).sum(axis=1)
        if near.max(initial=0.0) < 2.0**62:
            return (part * part).sum(axis=1).tolist()
        out: list[int | None] = [None] * len(part)
        for i in np.flatnonzero(near < 2.0**63 * (1 + 1e-9)):
            exact = sum(int(v) ** 2 for v in part[i])
            out[i] = exact if exact < 1 << 63 else None
        return out


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once."""
    return rows.select("x").distinct()


def moments(fit: DataFrame) -> Moments:
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()
    return Moments(n, [int(r.s) + n * SHIFT for r in sorted(sums, key=lambda r: r.i)])


def _summed(fit: DataFrame, task, size: int) -> np.ndarray:
    """The sum over all tasks of the array of `size` doubles that `task` makes of its batches' matrices."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += task(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    got = fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r.i] = r.v
    return out


def covariance_times(fit: DataFrame, m: Moments, block: np.ndarray) -> np.ndarray:
    """V B for a block B: one pass over the fit list."""
    d, b = block.shape
    shared = fit.sparkSession.sparkContext.broadcast(block)

    def task(x):
        y = m.centred(x)
        return (y.T @ (y @ shared.value)).ravel()

    out = _summed(fit, task, d * b).reshape(d, b) / m.n
    shared.unpersist()
    return out


def trace(fit: DataFrame, m: Moments) -> float:
    """The sum of the variances: the deviations of all rows of the fit list over n^3, here in doubles."""
    return float(_summed(fit, lambda x: np.array([(m.centred(x) ** 2).sum()]), 1)[0]) / m.n


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, width: int) -> np.ndarray:
    """An orthonormal block of `width` vectors orthogonal to `basis`: the span of `block`, and random directions for what it lacks."""
    d = basis.shape[0]
    scale = np.linalg.norm(block, axis=0).max(initial=0.0)
    out = np.zeros((d, 0))
    source = block
    while out.shape[1] < width:
        have = np.hstack([basis, out])
        for _ in range(2):
            source = source - have @ (have.T @ source)
        u, s, _ = np.linalg.svd(source, full_matrices=False)
        new = u[:, s > 1e-10 * scale][:, : width - out.shape[1]]
        # Small directions carry rounding of the large ones: once more against all.
        for _ in range(2):
            new = new - have @ (have.T @ new)
        new, _ = np.linalg.qr(new) if new.shape[1] else (new, None)
        out = np.hstack([out, new])
        source = rng.standard_normal((d, width - out.shape[1]))
        scale = np.linalg.norm(source, axis=0).max(initial=0.0)
    return out


def block_lanczos(times, d: int, k: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, passes) of the `k` largest of a symmetric operator given by `times(B)`."""
    # A block finds as many vectors of one eigenvalue as it has columns: not fewer than are wanted.
    rng, block = np.random.default_rng(seed), max(block, k)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new = orthonormal(rng.standard_normal((d, min(block, d))), basis, rng, min(block, d))
    passes = 0
    while True:
        image = times(new)
        passes += 1
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        vectors = basis @ inner
        left = d - basis.shape[1]
        if not left:
            break
        residuals = np.linalg.norm(images @ inner - vectors * values, axis=0)
        if len(values) == k and residuals.max() <= tolerance * max(values[0], 0.0):
            break
        new = orthonormal(image, basis, rng, min(block, left))
    return values, vectors / np.linalg.norm(vectors, axis=0), passes


def whiten(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """`key`, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    spark = vectors.sparkSession
    rows = integer_rows(vectors, vec, (key,))
    fit = checkpoint(fit_list(rows))
    m = moments(fit)
    d = len(m.sums)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if m.n == 0:
        return spark.createDataFrame([], schema)
    whole = trace(fit, m)
    values, axes, _ = block_lanczos(lambda b: covariance_times(fit, m, b), d, min(components, d))
    kept = values > NO_VARIANCE * whole if whole > 0 else np.zeros(len(values), bool)
    values, axes = values[kept], axes[:, kept]
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], schema)
    project = axes / np.sqrt(values)
    shared = spark.sparkContext.broadcast(project)

    def square(x):
        w = m.centred(x) @ shared.value
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    sums = _summed(fit, square, k * k + k) / m.n
    mean = sums[k * k :]
    error = float(np.abs(sums[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / whole

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            x = _matrix(batch.column(1))
            w = m.centred(x) @ shared.value
            deviation = pa.array(m.deviations(x), pa.int64())
            each = pa.array(np.repeat(np.arange(count), k))
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, m.n)), deviation.take(each), pa.array(w.ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, 16 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
