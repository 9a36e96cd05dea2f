"""Families whose shape comes from third and fourth moments, and families of counts.

Importing this module adds them to the registry of `families`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.special import NEG_INF, lgamma, normal_log_cdf_column
from tessel.operators.families import _EULER, _LN_2PI, Family, Params, Stats, _inside, _mean_var, _normal, _weight, register

#: The least variance, the bounds of a tail shape and of a power, as results depend on them.
_LEAST, _TAIL, _POWER = 1e-12, (-1.0, 1 / 3 - 1e-4), (0.25, 50.0)


def _thirds(x: Column, w: Column) -> Stats:
    return {"n": F.sum(w), "s1": F.sum(w * x), "s2": F.sum(w * x * x), "s3": F.sum(w * x * x * x)}


def _skewness(s: Stats) -> tuple[Column, Column, Column]:
    m, v = _mean_var(s)
    v = F.greatest(v, F.lit(_LEAST))
    return m, v, (s["s3"] / s["n"] - 3 * m * s["s2"] / s["n"] + 2 * m * m * m) / F.pow(v, F.lit(1.5))


def _exgaussian(s: Stats) -> Params:
    """Three moments; data that lean left get a small exponential part, too strong a lean half of the variance."""
    m, v, skew = _skewness(s)
    tau = F.when(skew > _LEAST, F.pow(F.greatest(skew, F.lit(0.0)) / 2, F.lit(1 / 3))).otherwise(1e-3) * F.sqrt(v)
    rest = v - tau * tau
    over = rest <= _LEAST
    sigma2 = F.when(over, F.greatest(v / 2, F.lit(_LEAST))).otherwise(rest)
    tau = F.when(over, F.sqrt(F.greatest(v - sigma2, F.lit(_LEAST)))).otherwise(tau)
    return {"mu": m - tau, "sigma2": sigma2, "lam": 1 / F.greatest(tau, F.lit(_LEAST))}


def _exgaussian_logpdf(x: Column, p: Params) -> Column:
    sigma = F.sqrt(p["sigma2"])
    return F.ln(p["lam"]) + p["lam"] * (p["mu"] - x + p["lam"] * p["sigma2"] / 2) + normal_log_cdf_column((x - p["mu"]) / sigma - p["lam"] * sigma)


register(Family("exgaussian", ("mu", "sigma2", "lam"), _thirds, _exgaussian, _exgaussian_logpdf))


def _skew_normal(s: Stats) -> Params:
    """Skewness gives delta, cut below the largest skewness that the family has."""
    m, v, skew = _skewness(s)
    most = (4 - math.pi) / 2 * (2 / math.pi) ** 1.5 / (1 - 2 / math.pi) ** 1.5 * (1 - 1e-6)
    skew = F.greatest(F.least(skew, F.lit(most)), F.lit(-most))
    two_thirds = F.pow(F.abs(skew), F.lit(2 / 3))
    share = two_thirds / (two_thirds + ((4 - math.pi) / 2) ** (2 / 3))
    delta = F.signum(skew) * F.least(F.sqrt(share * math.pi / 2), F.lit(1 - 1e-9))
    scale = F.sqrt(v / (1 - 2 / math.pi * delta * delta))
    return {"loc": m - scale * math.sqrt(2 / math.pi) * delta, "scale": scale, "shape": delta / F.sqrt(1 - delta * delta)}


def _skew_normal_logpdf(x: Column, p: Params) -> Column:
    z = (x - p["loc"]) / p["scale"]
    return math.log(2) - F.ln(p["scale"]) + _normal(z, F.lit(0.0), F.lit(1.0)) + normal_log_cdf_column(p["shape"] * z)


register(Family("skew_normal", ("loc", "scale", "shape"), _thirds, _skew_normal, _skew_normal_logpdf))


def _bisect(f, lo: float, hi: float, steps: int = 80) -> float:
    """Where the increasing f passes 0, or the nearer end."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _gev_skewness(xi: float) -> float:
    if abs(xi) < 1e-6:
        return 1.1395470994046487
    g1, g2, g3 = (math.gamma(1 - k * xi) for k in (1, 2, 3))
    return math.copysign(1.0, xi) * (g3 - 3 * g2 * g1 + 2 * g1**3) / (g2 - g1 * g1) ** 1.5


def _gev_driver(s: dict[str, float]) -> dict[str, float]:
    """Skewness grows with the tail's shape; location and scale follow from mean and variance."""
    m = s["s1"] / s["n"]
    v = max(s["s2"] / s["n"] - m * m, 0.0)
    if v == 0:
        return {"loc": m, "scale": _LEAST, "shape": 0.0}
    skew = (s["s3"] / s["n"] - 3 * m * s["s2"] / s["n"] + 2 * m**3) / v**1.5
    xi = _bisect(lambda k: _gev_skewness(k) - skew, *_TAIL)
    if abs(xi) < 1e-6:
        scale = math.sqrt(6 * v) / math.pi
        return {"loc": m - scale * _EULER, "scale": scale, "shape": 0.0}
    g1, g2 = math.gamma(1 - xi), math.gamma(1 - 2 * xi)
    scale = math.sqrt(v) * abs(xi) / math.sqrt(g2 - g1 * g1)
    return {"loc": m - scale * (g1 - 1) / xi, "scale": scale, "shape": xi}


def _gev_logpdf(x: Column, p: Params) -> Column:
    z = (x - p["loc"]) / p["scale"]
    t = 1 + p["shape"] * z
    log_t = F.ln(F.when(t > 0, t)) / p["shape"]
    heavy = _inside(t > 0, -F.ln(p["scale"]) - (1 + p["shape"]) * log_t - F.exp(-log_t))
    return F.when(F.abs(p["shape"]) < 1e-9, -F.ln(p["scale"]) - z - F.exp(-z)).otherwise(heavy)


register(Family("generalized_extreme_value", ("loc", "scale", "shape"), _thirds, None, _gev_logpdf, _gev_driver))


def _generalized_gaussian_driver(s: dict[str, float]) -> dict[str, float]:
    """The power solves the excess kurtosis, which falls with it."""
    n, mu = s["n"], s["s1"] / s["n"]
    m2 = s["s2"] / n - mu * mu
    if m2 <= 0:
        return {"mu": mu, "alpha": 1e-6, "beta": 2.0}
    m4 = s["s4"] / n - 4 * mu * s["s3"] / n + 6 * mu * mu * s["s2"] / n - 3 * mu**4
    g = math.lgamma
    beta = _bisect(lambda b: m4 / m2**2 - math.exp(g(5 / b) + g(1 / b) - 2 * g(3 / b)), *_POWER)
    return {"mu": mu, "alpha": math.sqrt(m2 * math.exp(g(1 / beta) - g(3 / beta))), "beta": beta}


register(
    Family(
        "generalized_gaussian",
        ("mu", "alpha", "beta"),
        lambda x, w: {**_thirds(x, w), "s4": F.sum(w * x * x * x * x)},
        None,
        lambda x, p: F.ln(p["beta"]) - math.log(2) - F.ln(p["alpha"]) - lgamma(1 / p["beta"]) - F.pow(F.abs(x - p["mu"]) / p["alpha"], p["beta"]),
        _generalized_gaussian_driver,
    )
)


def _log_series_driver(s: dict[str, float]) -> dict[str, float]:
    mean = s["s1"] / s["n"]
    return {"p": _bisect(lambda p: -p / ((1 - p) * math.log1p(-p)) - mean, 1e-12, 1 - 1e-12)}


register(Family("log_series", ("p",), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x)}, None, lambda x, p: _inside((x >= 1) & (x == F.floor(x)), x * F.ln(p["p"]) - F.ln(x) - F.ln(-F.log1p(-p["p"]))), _log_series_driver))


def beta_binomial(trials: int) -> Family:
    """Successes in a given number of trials; both shapes from mean and variance, concentration cut to 1e-6 .. 1e8."""

    def solve(s: Stats) -> Params:
        m, v = _mean_var(s)
        share = F.least(F.greatest(m / trials, F.lit(1e-12)), F.lit(1 - 1e-12))
        rho = (v / (trials * share * (1 - share)) - 1) / (trials - 1) if trials > 1 else F.lit(0.0)
        rho = F.least(F.greatest(rho, F.lit(1 / (1e8 + 1))), F.lit(1 - 1e-9))
        s_ = F.least(F.greatest(1 / rho - 1, F.lit(1e-6)), F.lit(1e8))
        return {"trials": F.lit(float(trials)), "a": share * s_, "b": (1 - share) * s_}

    def logpdf(x: Column, p: Params) -> Column:
        n, a, b = p["trials"], p["a"], p["b"]
        choose = lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1)
        return _inside((x >= 0) & (x <= n) & (x == F.floor(x)), choose + lgamma(x + a) + lgamma(n - x + b) - lgamma(n + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b))

    return Family("beta_binomial", ("trials", "a", "b"), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x), "s2": F.sum(w * x * x)}, solve, logpdf)


register(beta_binomial(10))


def point_mass(value: float) -> Family:
    """All mass on one given value."""
    return Family("point_mass", ("value",), lambda x, w: {"n": F.sum(w)}, lambda s: {"value": F.lit(float(value))}, lambda x, p: F.when(x == p["value"], 0.0).otherwise(F.lit(NEG_INF)))


register(point_mass(0.0))

register(Family("uniform_spike", ("spike", "p", "low", "levels"), lambda x, w: {}, None, lambda x, p: F.when(x == p["spike"], F.ln(p["p"])).when((x >= p["low"]) & (x < p["low"] + p["levels"]) & (x == F.floor(x)), F.ln(1 - p["p"]) - F.ln(p["levels"] - 1)).otherwise(F.lit(NEG_INF))))


def fit_uniform_spike(df: DataFrame, column: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, spike, p, low, levels): integers all alike but one; the spike is the level that makes the data likeliest, the least of equals."""
    by = by or []
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*by, x.alias("_x")).agg(F.sum(_weight(df, weight)).alias("_c"))
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_x").alias("low"), (F.max("_x") - F.min("_x") + 1).alias("levels"))
    both = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))
    c, n = F.col("_c"), F.col("_n")
    rest = F.when(c == n, 0.0).otherwise((n - c) * (F.ln((n - c) / n) - F.ln(F.col("levels") - 1)))
    best = F.max(F.struct((rest + c * F.ln(c / n)).alias("ll"), (-F.col("_x")).alias("minus"), (c / n).alias("p"))).alias("_b")
    return both.groupBy(*by, "low", "levels").agg(best).select(*by, (-F.col("_b.minus")).alias("spike"), F.col("_b.p").alias("p"), "low", "levels")
