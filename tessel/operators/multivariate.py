"""Vectors, compositions, bags and dependence: directions on a sphere, log-ratios, multinomials, copulas, graphs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.running import running


def log_ratios(parts: list[Column]) -> list[Column]:
    """Orthonormal log-ratio coordinates of a composition: each part against the geometric mean of those before it."""
    logs, out = [F.ln(p) for p in parts], []
    for n in range(1, len(parts)):
        mean = sum(logs[1:n], logs[0]) / n
        out.append(math.sqrt(n / (n + 1)) * (mean - logs[n]))
    return out


def from_log_ratios(coordinates: list[Column]) -> list[Column]:
    """The composition (adding up to 1) of log-ratio coordinates."""
    d = len(coordinates) + 1
    logs = []
    for k in range(d):
        terms = [c * math.sqrt((i + 1) / (i + 2)) * (1 / (i + 1) if k <= i else -1.0 if k == i + 1 else 0.0) for i, c in enumerate(coordinates)]
        logs.append(sum(terms[1:], terms[0]))
    total = sum((F.exp(c) for c in logs[1:]), F.exp(logs[0]))
    return [F.exp(c) / total for c in logs]


def covariance(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, n, m_i, v_i_j): means and population covariances in one aggregation."""
    c = [F.col(x) for x in columns]
    aggs = [F.count("*").alias("n"), *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(c)]]
    aggs += [F.covar_pop(c[i], c[j]).alias(f"v_{i}_{j}") for i in range(len(c)) for j in range(i, len(c))]
    return df.groupBy(*(by or [])).agg(*aggs)


#: Coefficients of a rational approximation to the normal quantile (relative error below 1.2e-9).
_PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def probit(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1."""
    tail = lambda q: _poly(_PROBIT_C, F.sqrt(-2 * F.ln(q))) / _poly(_PROBIT_D, F.sqrt(-2 * F.ln(q)))
    q = p - 0.5
    middle = _poly(_PROBIT_A, q * q) * q / _poly(_PROBIT_B, q * q)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)


def normal_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add z_<column>: the normal quantile of rank / (n + 1), equal values sharing their mean rank; rows with a null are left out."""
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    n = rows.agg(F.count("*").alias("_n"))
    for c in columns:
        per = rows.groupBy(F.col(c).alias("_x")).agg(F.count("*").alias("_t"))
        ranks = running(per, ["_x"], {"_b": ("sum", F.col("_t"), False)}).crossJoin(F.broadcast(n))
        z = ranks.select("_x", probit((F.col("_b") + (F.col("_t") + 1) / 2) / (F.col("_n") + 1)).alias(f"z_{c}"))
        rows = rows.join(z, F.col(c) == F.col("_x")).drop("_x")
    return rows


def gaussian_copula(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho): correlations of the columns' normal scores."""
    scores = normal_scores(df, columns)
    names = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = scores.agg(*[F.corr(f"z_{a}", f"z_{b}").alias(f"r{k}") for k, (a, b) in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("rho")) for k, (a, b) in enumerate(names)])))


def gaussian_copula_logpdf(zs: list[Column], corr: np.ndarray) -> Column:
    """Log-density of a Gaussian copula at normal scores."""
    inverse = np.linalg.inv(corr) - np.eye(len(zs))
    quad = F.lit(0.0)
    for i in range(len(zs)):
        for j in range(len(zs)):
            quad = quad + float(inverse[i, j]) * zs[i] * zs[j]
    return F.lit(-0.5 * float(np.linalg.slogdet(corr)[1])) - 0.5 * quad


def clayton_logpdf(u: Column, v: Column, theta: float) -> Column:
    """Log-density of the bivariate Clayton copula, theta > 0."""
    s = F.pow(u, F.lit(-theta)) + F.pow(v, F.lit(-theta)) - 1
    return math.log1p(theta) - (theta + 1) * (F.ln(u) + F.ln(v)) - (2 + 1 / theta) * F.ln(s)


def frank_logpdf(u: Column, v: Column, theta: float) -> Column:
    """Log-density of the bivariate Frank copula, theta not 0."""
    g = -math.expm1(-theta)
    d = g - (1 - F.exp(-theta * u)) * (1 - F.exp(-theta * v))
    return math.log(theta * g) - theta * (u + v) - 2 * F.ln(F.abs(d))


def gumbel_logpdf(u: Column, v: Column, theta: float) -> Column:
    """Log-density of the bivariate Gumbel copula, theta >= 1."""
    x, y = -F.ln(u), -F.ln(v)
    s = F.pow(x, F.lit(theta)) + F.pow(y, F.lit(theta))
    r = F.pow(s, F.lit(1 / theta))
    return -r - F.ln(u) - F.ln(v) + (theta - 1) * (F.ln(x) + F.ln(y)) + (1 / theta - 2) * F.ln(s) + F.ln(r + theta - 1)


def fit_multinomial(df: DataFrame, key: str, level: str, count: str | None = None) -> DataFrame:
    """(level, n, p) of bags given as (key, level, count) rows: each level's share of all that the bags hold."""
    c = F.lit(1) if count is None else F.col(count)
    per = df.where(F.col(level).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(level).alias("level")).agg(F.sum(c).alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("_t")))).select("level", "n", (F.col("n") / F.col("_t")).alias("p"))


def score_multinomial(df: DataFrame, model: DataFrame, key: str, level: str, count: str | None = None) -> DataFrame:
    """(key, total, ll): sum of count x ln p over a bag's levels, without the multinomial coefficient; levels unknown to the model give -infinity."""
    c = F.lit(1) if count is None else F.col(count)
    rows = df.select(F.col(key).alias("k"), F.col(level).alias("l"), c.cast("double").alias("c")).where("c > 0")
    both = rows.join(model.select(F.col("level").alias("m"), "p"), F.col("l") == F.col("m"), "left")
    return both.groupBy(F.col("k").alias(key)).agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.coalesce(F.ln("p"), F.lit(float("-inf")))).alias("ll"))


def mean_direction(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """(by, n, direction, length): unit vectors of the nonzero vectors, their mean's direction and length."""
    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("norm > 0")
    cells = rows.select(*by, "norm", F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    sums = cells.groupBy(*by).agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda z: z["s"]).alias("s"))
    return sums.select(*by, "n", F.transform("s", lambda x: x / F.col("total")).alias("direction"), (F.col("total") / F.col("n")).alias("length"))


def concentration_start(length: Column, dim: int) -> Column:
    """The usual closed approximation to a von Mises-Fisher concentration."""
    r = F.least(length, F.lit(1 - 1e-10))
    return r * (dim - r * r) / (1 - r * r)


def bessel_ratio(order: float, kappa: float) -> float:
    """I(order, kappa) / I(order - 1, kappa), by its continued fraction from the far end."""
    n = int(2 * kappa + 60)
    out = 0.0
    for k in range(n, 0, -1):
        out = 1 / (2 * (order - 1 + k) / kappa + out)
    return out


def concentration(length: float, dim: int, steps: int = 3) -> float:
    """The concentration whose mean length this is, by Newton steps from the closed approximation."""
    r = min(length, 1 - 1e-10)
    kappa = r * (dim - r * r) / (1 - r * r)
    if kappa <= 0 or r >= 1 - 1e-9:
        return kappa
    for _ in range(steps):
        a = bessel_ratio(dim / 2, kappa)
        kappa = max(kappa - (a - r) / (1 - a * a - (dim - 1) / kappa * a), 1e-300)
    return kappa


def edge_probability(edges: DataFrame, nodes: DataFrame, by: list[str] | None = None, directed: bool = True) -> DataFrame:
    """(by, nodes, edges, p): distinct edges (src, dst) other than loops over the pairs that could be edges."""
    by = by or []
    ends = edges.where("src <> dst").select(*by, *(("src", "dst") if directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))).distinct()
    m = ends.groupBy(*by).agg(F.count("*").alias("edges"))
    n = nodes.groupBy(*by).agg(F.count("*").alias("nodes"))
    both = n.join(m, by, "left") if by else n.crossJoin(F.broadcast(m))
    pairs = F.col("nodes") * (F.col("nodes") - 1) / (1 if directed else 2)
    return both.select(*by, "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(pairs > 0, F.coalesce("edges", F.lit(0)) / pairs).otherwise(0.5).alias("p"))
