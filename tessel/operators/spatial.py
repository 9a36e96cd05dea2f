"""Vectors and positions: Gram moments, kernel densities, variograms, neighbours of a stated query set."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.running import quantiles

#: Queries that are sent along or make a block; rows of a part that a block meets.
SENT_QUERIES, PART_ROWS = 10_000, 20_000


def vector_moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance of an array column: a partial Gram matrix per task, summed by Spark per cell row."""
    n_dim = df.select(F.size(column)).where(F.col(column).isNotNull()).limit(1).head()
    d = n_dim[0] if n_dim else 0

    def part(batches):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            x = np.stack(pdf[column].to_numpy()).astype(float) if len(pdf) else np.zeros((0, d))
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pd.DataFrame({"i": range(d), "n": n, "s": s, "g": list(g)})

    rows = df.where(F.col(column).isNotNull()).select(column).mapInPandas(part, "i int, n long, s double, g array<double>")
    out = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*[F.sum(F.col("g")[j]) for j in range(d)]).alias("g")).orderBy("i").collect()
    if not out:
        return 0, np.zeros(0), np.zeros((0, 0))
    n = out[0].n
    mean = np.array([r.s for r in out]) / n
    return n, mean, np.array([r.g for r in out]) / n - np.outer(mean, mean)


def mvn_score(df: DataFrame, column: str, mean: np.ndarray, cov: np.ndarray, ridge: float = 1e-6, name: str = "ll") -> DataFrame:
    """Add the multivariate normal log-density, in Arrow batches."""
    k = len(mean)
    chol = np.linalg.cholesky(cov + ridge * np.eye(k))
    const = -0.5 * k * math.log(2 * math.pi) - np.log(np.diag(chol)).sum()

    @F.pandas_udf("double")
    def ll(x: pd.Series) -> pd.Series:
        z = np.linalg.solve(chol, (np.stack(x.to_numpy()).astype(float) - mean).T)
        return pd.Series(const - 0.5 * (z * z).sum(axis=0))

    return df.withColumn(name, ll(column))


def silverman_bandwidth(df: DataFrame, column: str) -> DataFrame:
    """0.9 min(sd, IQR / 1.349) n^(-1/5); the deviation alone where the IQR is 0."""
    quarters = quantiles(df, column, [0.25, 0.75]).select((F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    s = df.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd")).crossJoin(quarters)  # two single rows
    spread = F.when(F.col("iqr") == 0, F.col("sd")).otherwise(F.least("sd", F.col("iqr") / 1.349))
    return s.select((0.9 * spread * F.pow("n", F.lit(-0.2))).alias("bandwidth"))


def kde_grid(df: DataFrame, column: str, grid: list[float], bandwidth: float, bins_per_bandwidth: int = 0) -> DataFrame:
    """(x, density) on a stated grid of points: values are counted first, then each distinct value meets the grid."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    pts = counts.withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    z = (F.col("x") - F.col("v")) / bandwidth
    return pts.groupBy("x").agg((F.sum(F.col("c") * F.exp(-z * z / 2)) / (F.sum("c") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def nearest_of_queries(df: DataFrame, key: str, column: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, distance, rank): exact neighbours of a query set of any size, within blocks of rows.

    Up to `SENT_QUERIES` queries are sent along in one pass over the rows; more are cut into blocks of
    about as many, and every block meets every part of the rows. Each task keeps its k best per query,
    and those are merged.
    """
    out = "query long, key long, distance double"
    rows, asked = df.where(F.col(column).isNotNull()).select(key, column), queries.select(key, column)
    q = asked.limit(SENT_QUERIES + 1).collect()

    def best(ids, qs, keys, x):
        for i in range(len(ids)):
            d = np.sqrt(((x - qs[i]) ** 2).sum(axis=1))
            d[keys == ids[i]] = np.inf
            near = np.lexsort((keys, d))[:k]
            near = near[np.isfinite(d[near])]
            yield pd.DataFrame({"query": ids[i], "key": keys[near], "distance": d[near]})

    if len(q) <= SENT_QUERIES:
        ids, qs = np.array([r[0] for r in q]), np.array([r[1] for r in q], float)

        def scan(batches):
            for pdf in batches:
                if len(pdf) and len(ids):
                    yield from best(ids, qs, pdf[key].to_numpy(), np.stack(pdf[column].to_numpy()).astype(float))

        found = rows.mapInPandas(scan, out)
    else:
        blocks, parts = math.ceil(asked.count() / SENT_QUERIES), math.ceil(rows.count() / PART_ROWS)
        own = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select(key, column, own(max(1, parts)).alias("part"), every(blocks).alias("block"))
        right = asked.where(F.col(column).isNotNull()).select(key, column, own(blocks).alias("block"), every(max(1, parts)).alias("part"))

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "distance": np.zeros(0)})
            if not len(x) or not len(y):
                return none
            return pd.concat([none, *best(y[key].to_numpy(), np.stack(y[column].to_numpy()).astype(float), x[key].to_numpy(), np.stack(x[column].to_numpy()).astype(float))])

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, out)

    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def variogram(df: DataFrame, x: str, value: str, lags: int, width: float) -> DataFrame:
    """(lag, n, gamma) of values along a line, by bins of distance: a row meets only rows of near cells, in aggregated form.

    Cells of one bin width hold count, sum and sum of squares; pairs of cells stand for their pairs
    of rows, so the work grows with cells x lags, not with rows squared.
    """
    cell = F.floor(F.col(x) / width)
    c = df.where(F.col(value).isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    left = c.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags))))
    right = c.select(F.col("cell").alias("cell2"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    j = left.join(right, F.col("cell") + F.col("lag") == F.col("cell2"))
    total = F.col("n2") * F.col("q") + F.col("n") * F.col("q2") - 2 * F.col("s") * F.col("s2")
    return j.groupBy("lag").agg(F.sum(F.col("n") * F.col("n2")).alias("n"), (F.sum(total) / (2 * F.sum(F.col("n") * F.col("n2")))).alias("gamma"))
