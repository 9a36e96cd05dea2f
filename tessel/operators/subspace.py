"""Probabilistic principal components: a low-dimensional Gaussian of vectors by distributed subspace iteration.

Every pass sums Xᵀ(X Q) of centred rows per task for a thin block Q, orthonormalised on the driver
(d x k numbers); neither rows nor the d x d covariance are gathered. Vectors that are null, or hold
null or non-finite entries, or have another length than most, are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Components:
    """Rows, mean, unit axes as columns, their variances, and the variance of every other direction."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    noise: float


def sound(df: DataFrame, vector: str) -> DataFrame:
    """The usable vectors as `_v`, array of doubles, beside all columns."""
    rows = df.withColumn("_v", F.col(vector).cast("array<double>"))
    rows = rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    usual = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("_v") == (usual[0].d if usual else 0))


def _summed(rows: DataFrame, task, size: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += task(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in rows.select("_v").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def fit(df: DataFrame, vector: str, k: int, rounds: int = 300, close: float = 1e-10, extra: int = 8, seed: int = 3) -> Components:
    """The maximum-likelihood model with k components; `extra` more directions go along, so that close eigenvalues part sooner."""
    rows = sound(df, vector).cache()
    first = rows.select(F.size("_v").alias("d")).head()
    if first is None:
        raise ValueError("no usable vectors")
    d, n = first.d, rows.count()
    mean = _summed(rows, lambda x: x.sum(axis=0), d) / n
    trace = float(_summed(rows, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0]) / n
    b = min(d, k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    values = np.zeros(b)
    for _ in range(rounds):
        image = _summed(rows, lambda x, q=q: ((x - mean).T @ ((x - mean) @ q)).ravel(), d * b).reshape(d, b) / n
        small = q.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        axes, left = q @ inner, image @ inner
        if np.linalg.norm(left[:, :k] - axes[:, :k] * values[:k], axis=0).max() <= close * max(values[0], 1e-300) or b == d:
            q = axes
            break
        q = np.linalg.qr(left)[0]
    rows.unpersist()
    noise = (trace - values[:k].sum()) / (d - k) if d > k else 0.0
    return Components(n, mean, q[:, :k], values[:k], float(noise))


def project(model: Components, x: Column) -> list[Column]:
    """Coordinates of a vector column along the axes."""
    dot = lambda u: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in u]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return [dot(model.axes[:, i]) - float(model.mean @ model.axes[:, i]) for i in range(len(model.values))]


def logpdf(model: Components, x: Column) -> Column:
    """Log-density of a vector column (array of doubles of the model's length) under the model, in column expressions."""
    d, k = model.axes.shape
    centre = F.array(*[F.lit(float(v)) for v in model.mean])
    whole = F.aggregate(F.zip_with(x, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    shrink = [1 - model.noise / float(v) for v in model.values]
    inside = sum((c * c * s for c, s in zip(project(model, x), shrink, strict=True)), F.lit(0.0))
    constant = d * math.log(2 * math.pi) + float(np.log(model.values).sum()) + (d - k) * math.log(model.noise)
    return -0.5 * (constant + (whole - inside) / model.noise)
