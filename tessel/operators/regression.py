"""Regression from Gram sums: least squares, ridge, logistic and Poisson by weighted steps, robust errors, folds and resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.running import running


def _design(columns: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]


def gram(df: DataFrame, columns: list[str], y: Column, w: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'WX, X'Wy and the rows, in one aggregation; as many numbers as pairs of columns."""
    x, w = _design(columns), w if w is not None else F.lit(1.0)
    p = len(x)
    aggs = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(w * x[i] * y).alias(f"b{i}") for i in range(p)] + [F.count("*").alias("n")]
    row = df.agg(*aggs).head()
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, np.array([row[f"b{i}"] or 0.0 for i in range(p)]), row["n"]


def ols(df: DataFrame, columns: list[str], y: str, ridge: float = 0.0) -> np.ndarray:
    """Coefficients, the intercept first and never penalised."""
    g, b, _ = gram(df, columns, F.col(y).cast("double"))
    pen = ridge * np.eye(len(b))
    pen[0, 0] = 0
    return np.linalg.solve(g + pen, b)


def _linear(columns: list[str], beta: np.ndarray) -> Column:
    return sum((F.lit(float(b)) * c for b, c in zip(beta, _design(columns), strict=True)), F.lit(0.0))


def glm(df: DataFrame, columns: list[str], y: str, family: str = "logistic", iterations: int = 25, tolerance: float = 1e-10) -> np.ndarray:
    """Iteratively reweighted least squares: each step is one aggregation over the cached rows."""
    rows = df.select(*columns, y).cache()
    t = F.col(y).cast("double")
    beta = np.zeros(len(columns) + 1)
    if family == "poisson":
        beta[0] = math.log(max(rows.agg(F.avg(t)).head()[0], 1e-12))
    for _ in range(iterations):
        eta = _linear(columns, beta)
        mu = 1 / (1 + F.exp(-eta)) if family == "logistic" else F.exp(eta)
        w = mu * (1 - mu) if family == "logistic" else mu
        g, b, _ = gram(rows, columns, eta + (t - mu) / w, w)
        new = np.linalg.solve(g, b)
        moved, beta = np.abs(new - beta).max(), new
        if moved < tolerance:
            break
    rows.unpersist()
    return beta


def robust_errors(df: DataFrame, columns: list[str], y: str, cluster: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and HC1 standard errors; clustered ones where `cluster` is given (scores summed per cluster)."""
    g, b, n = gram(df, columns, F.col(y).cast("double"))
    beta, inv, p = np.linalg.solve(g, b), np.linalg.inv(g), len(b)
    e = F.col(y).cast("double") - _linear(columns, beta)
    scores = df.select(*[(x * e).alias(f"s{i}") for i, x in enumerate(_design(columns))], *([cluster] if cluster else []))
    if cluster:
        scores = scores.groupBy(cluster).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)])
    row = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)], F.count("*").alias("g")).head()
    meat = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
    k = row["g"]
    factor = k / (k - 1) * (n - 1) / (n - p) if cluster else n / (n - p)
    return beta, np.sqrt(factor * np.diag(inv @ meat @ inv))


def newey_west(df: DataFrame, order: list[str], value: str, by: str | None = None) -> DataFrame:
    """Mean of a series and its error with Bartlett weights over floor(4 (n/100)^(2/9)) lags, factor n / (n - 1)."""
    keys = [by] if by else []
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    j = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    w = Window.partitionBy(*keys).orderBy(*order)
    e = j.withColumn("e", F.col(value) - F.col("mean"))
    lags = F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int")
    # A row meets the rows before it through one array, as long as the lags of the longest series (a few dozen).
    most = stats.agg(F.max(lags)).head()[0] or 0
    past = F.collect_list("e").over(w.rowsBetween(-most, 0))
    cross = e.withColumn("past", F.reverse(past)).withColumn("l", lags)
    own = F.aggregate(F.transform("past", lambda x, i: F.when(i == 0, x * F.col("e")).when(i <= F.col("l"), 2 * (1 - i / (F.col("l") + 1)) * x * F.col("e")).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return cross.withColumn("c", own).groupBy(*keys, "n", "mean").agg(F.sum("c").alias("s")).select(*keys, "n", "mean", F.sqrt(F.col("s") / F.col("n") ** 2 * F.col("n") / (F.col("n") - 1)).alias("se"))


# Folds and resampling: columns of fold numbers and weights; no row is moved for them.


def kfold(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Contiguous folds of the order; sizes differ by at most one, the larger ones first."""
    ranked = running(df, order, {"before": ("sum", F.lit(1), False)})
    n = df.agg(F.count("*").alias("_n"))
    big, size = F.col("_n") % k, F.floor(F.col("_n") / k)
    edge = big * (size + 1)
    fold = F.when(F.col("before") < edge, F.floor(F.col("before") / (size + 1))).otherwise(big + F.floor((F.col("before") - edge) / size))
    return ranked.crossJoin(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("_n", "before")


def stratified_kfold(df: DataFrame, label: str, order: list[str], k: int) -> DataFrame:
    """Position within the label's rows modulo k."""
    ranked = running(df, order, {"before": ("sum", F.lit(1), False)}, [label])
    return ranked.withColumn("fold", (F.col("before") % k).cast("int")).drop("before")


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n, fold): the largest group next to the lightest fold; as many rows as groups, dealt on the driver."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()
    load, out = [0] * k, []
    for r in sizes:
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += r["n"]
        out.append((r[group], r["n"], f))
    return df.sparkSession.createDataFrame(out, f"{group} {dict(df.dtypes)[group]}, n long, fold int")


def time_series_folds(n: int, k: int, gap: int = 0) -> list[tuple[int, int, int]]:
    """(train end, test start, test end) of expanding windows; the last test ends with the series."""
    size = n // (k + 1)
    return [(max(0, (i + 1) * size - gap), (i + 1) * size, n if i == k - 1 else (i + 2) * size) for i in range(k)]


def poisson_bootstrap(df: DataFrame, key: str, value: str, replicates: int, by: list[str] | None = None) -> DataFrame:
    """(by, replicate, n, mean) with Poisson(1) weights that depend on the key and replicate alone, so they survive any repartitioning."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])
    u = F.pmod(F.xxhash64(F.col(key), F.col("replicate")), F.lit(1 << 30)) / float(1 << 30)
    w = sum((F.when(u >= float(c), 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", w)
    return rows.groupBy(*(by or []), "replicate").agg(F.sum("_w").alias("n"), (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("mean"))
