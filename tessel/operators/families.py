"""Probability families as one-pass aggregates, closed-form parameters and density expressions.

A family is three rules: `stats` names the weighted sums it needs, `solve` turns those sums into
parameters (Column algebra where the solution is closed, so a fit stays one lazy aggregation, per
group or overall), and `logpdf` is a Column over a row and parameters. Rows that a family can't have
get -infinity, never null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.special import NEG_INF, digamma, lgamma, log_bessel, log_of, trigamma

Stats = dict[str, Column]
Params = dict[str, Column]
_LN_2PI = math.log(2 * math.pi)
_EULER = 0.5772156649015329


@dataclass(frozen=True)
class Family:
    name: str
    params: tuple[str, ...]
    stats: Callable[[Column, Column], Stats]
    solve: Callable[[Stats], Params] | None
    logpdf: Callable[[Column, Params], Column]
    #: On the driver, from a dictionary of sums, where no closed form exists.
    solve_on_driver: Callable[[dict[str, float]], dict[str, float]] | None = None


FAMILIES: dict[str, Family] = {}


def register(family: Family) -> Family:
    """Add a family to the registry; this is how users extend the engine."""
    FAMILIES[family.name] = family
    return family


def _moments(x: Column, w: Column) -> Stats:
    return {"n": F.sum(w), "s1": F.sum(w * x), "s2": F.sum(w * x * x)}


def _mean_var(s: Stats) -> tuple[Column, Column]:
    m = s["s1"] / s["n"]
    return m, s["s2"] / s["n"] - m * m


def _inside(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(NEG_INF))


def _gaussian_solve(s: Stats, floor: float = 1e-8) -> Params:
    m, v = _mean_var(s)
    return {"mu": F.when(s["n"] == 0, 0.0).otherwise(m), "sigma2": F.when(v <= 0, F.lit(floor)).otherwise(F.greatest(v, F.lit(floor)))}


def _normal(x: Column, mu: Column, sigma2: Column) -> Column:
    return -0.5 * (_LN_2PI + F.ln(sigma2)) - (x - mu) ** 2 / (2 * sigma2)


register(Family("gaussian", ("mu", "sigma2"), _moments, _gaussian_solve, lambda x, p: _normal(x, p["mu"], p["sigma2"])))
register(Family("lognormal", ("mu", "sigma2"), lambda x, w: _moments(F.ln(x), w), _gaussian_solve, lambda x, p: _inside(x > 0, _normal(F.ln(x), p["mu"], p["sigma2"]) - F.ln(x))))
register(Family("exponential", ("beta",), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x)}, lambda s: {"beta": s["s1"] / s["n"]}, lambda x, p: _inside(x >= 0, -F.ln(p["beta"]) - x / p["beta"])))
register(Family("poisson", ("lam",), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x)}, lambda s: {"lam": F.greatest(s["s1"] / s["n"], F.lit(1e-12))}, lambda x, p: _inside((x >= 0) & (x == F.floor(x)), x * F.ln(p["lam"]) - p["lam"] - lgamma(x + 1))))
register(Family("geometric", ("p",), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x)}, lambda s: {"p": F.least(F.greatest(s["n"] / s["s1"], F.lit(1e-12)), F.lit(1 - 1e-12))}, lambda x, p: _inside((x >= 1) & (x == F.floor(x)), F.ln(p["p"]) + (x - 1) * F.ln(1 - p["p"]))))
register(Family("bernoulli", ("p",), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x)}, lambda s: {"p": F.when(s["n"] == 0, 0.5).otherwise(F.least(F.greatest(s["s1"] / s["n"], F.lit(1e-12)), F.lit(1 - 1e-12)))}, lambda x, p: F.when(x == 1, log_of(p["p"])).when(x == 0, log_of(1 - p["p"])).otherwise(F.lit(NEG_INF))))
register(Family("binomial", ("p", "n_trials", "low"), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x), "lo": F.min(x), "hi": F.max(x)}, lambda s: {"p": (s["s1"] - s["lo"] * s["n"]) / (s["n"] * (s["hi"] - s["lo"])), "n_trials": s["hi"] - s["lo"], "low": s["lo"]}, lambda x, p: _inside((x >= p["low"]) & (x <= p["low"] + p["n_trials"]), lgamma(p["n_trials"] + 1) - lgamma(x - p["low"] + 1) - lgamma(p["n_trials"] - x + p["low"] + 1) + (x - p["low"]) * F.ln(p["p"]) + (p["n_trials"] - x + p["low"]) * F.ln(1 - p["p"]))))
register(Family("pareto", ("xm", "alpha"), lambda x, w: {"n": F.sum(w), "lo": F.min(x), "sl": F.sum(w * F.ln(x))}, lambda s: {"xm": s["lo"], "alpha": s["n"] / (s["sl"] - s["n"] * F.ln(s["lo"]))}, lambda x, p: _inside(x >= p["xm"], F.ln(p["alpha"]) + p["alpha"] * F.ln(p["xm"]) - (p["alpha"] + 1) * F.ln(x))))
register(Family("uniform", ("low", "high"), lambda x, w: {"lo": F.min(x), "hi": F.max(x)}, lambda s: {"low": s["lo"], "high": F.greatest(s["hi"], s["lo"] + 1e-12)}, lambda x, p: _inside((x >= p["low"]) & (x <= p["high"]), -F.ln(p["high"] - p["low"]))))
register(Family("rayleigh", ("sigma",), lambda x, w: {"n": F.sum(w), "s2": F.sum(w * x * x)}, lambda s: {"sigma": F.sqrt(s["s2"] / (2 * s["n"]))}, lambda x, p: _inside(x > 0, F.ln(x) - 2 * F.ln(p["sigma"]) - x * x / (2 * p["sigma"] ** 2))))
register(Family("halfnormal", ("sigma",), lambda x, w: {"n": F.sum(w), "s2": F.sum(w * x * x)}, lambda s: {"sigma": F.sqrt(s["s2"] / s["n"])}, lambda x, p: _inside(x >= 0, 0.5 * math.log(2 / math.pi) - F.ln(p["sigma"]) - x * x / (2 * p["sigma"] ** 2))))
register(Family("inverse_gaussian", ("mu", "lam"), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x), "si": F.sum(w / x)}, lambda s: {"mu": s["s1"] / s["n"], "lam": 1 / (s["si"] / s["n"] - s["n"] / s["s1"])}, lambda x, p: _inside(x > 0, 0.5 * (F.ln(p["lam"]) - _LN_2PI - 3 * F.ln(x)) - p["lam"] * (x - p["mu"]) ** 2 / (2 * p["mu"] ** 2 * x))))


def _logistic(s: Stats) -> Params:
    m, v = _mean_var(s)
    return {"loc": m, "scale": F.sqrt(3 * v) / math.pi}


def _gumbel(s: Stats) -> Params:
    m, v = _mean_var(s)
    scale = F.sqrt(v * 6) / math.pi
    return {"loc": m - _EULER * scale, "scale": scale}


def _z(x: Column, p: Params) -> Column:
    return (x - p["loc"]) / p["scale"]


register(Family("logistic", ("loc", "scale"), _moments, _logistic, lambda x, p: -_z(x, p) - F.ln(p["scale"]) - 2 * F.log1p(F.exp(-_z(x, p)))))
register(Family("gumbel", ("loc", "scale"), _moments, _gumbel, lambda x, p: -F.ln(p["scale"]) - _z(x, p) - F.exp(-_z(x, p))))


def student_t(df: float = 5.0) -> Family:
    """Degrees of freedom are given; location and scale by moments."""

    def solve(s: Stats) -> Params:
        m, v = _mean_var(s)
        return {"df": F.lit(df), "loc": m, "scale": F.sqrt(v * (df - 2) / df)}

    c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return Family("student_t", ("df", "loc", "scale"), _moments, solve, lambda x, p: c - F.ln(p["scale"]) - (df + 1) / 2 * F.log1p(_z(x, p) ** 2 / df))


register(student_t())


def _gpd(s: Stats) -> Params:
    m, v = _mean_var(s)
    xi = F.least(F.greatest(0.5 * (1 - m * m / v), F.lit(-5.0)), F.lit(0.499))
    return {"xi": xi, "scale": m * (1 - xi)}


register(Family("generalized_pareto", ("xi", "scale"), _moments, _gpd, lambda x, p: _inside((x >= 0) & (1 + p["xi"] * x / p["scale"] > 0), -F.ln(p["scale"]) - (1 + 1 / p["xi"]) * F.log1p(p["xi"] * x / p["scale"]))))


def tweedie_moments(power: float = 1.5) -> Family:
    def solve(s: Stats) -> Params:
        m, v = _mean_var(s)
        return {"mean": m, "phi": v / F.pow(m, F.lit(power))}

    def logpdf(x: Column, p: Params) -> Column:
        # The saddle-point form for x > 0; the point mass at 0 is exact.
        lam = F.pow(p["mean"], F.lit(2 - power)) / (p["phi"] * (2 - power))
        dev = 2 * (F.pow(x, F.lit(2 - power)) / ((1 - power) * (2 - power)) - x * F.pow(p["mean"], F.lit(1 - power)) / (1 - power) + F.pow(p["mean"], F.lit(2 - power)) / (2 - power))
        return F.when(x == 0, -lam).when(x > 0, -0.5 * (_LN_2PI + F.ln(p["phi"]) + power * F.ln(x)) - dev / (2 * p["phi"])).otherwise(F.lit(NEG_INF))

    return Family("tweedie", ("mean", "phi"), _moments, solve, logpdf)


register(tweedie_moments())


def _fourth(x: Column, w: Column) -> Stats:
    return {"n": F.sum(w), "s2": F.sum(w * x * x), "s4": F.sum(w * x * x * x * x)}


def _nakagami(s: Stats) -> Params:
    omega = s["s2"] / s["n"]
    return {"m": omega**2 / (s["s4"] / s["n"] - omega**2), "omega": omega}


def _rician(s: Stats) -> Params:
    m2, m4 = s["s2"] / s["n"], s["s4"] / s["n"]
    root = F.sqrt(F.greatest(2 * m2 * m2 - m4, F.lit(0.0)))
    s2 = (m2 - root) / 2
    return {"nu": F.sqrt(F.greatest(m2 - 2 * s2, F.lit(0.0))), "sigma": F.sqrt(s2)}


register(Family("nakagami", ("m", "omega"), _fourth, _nakagami, lambda x, p: _inside(x > 0, math.log(2) + p["m"] * F.ln(p["m"] / p["omega"]) - lgamma(p["m"]) + (2 * p["m"] - 1) * F.ln(x) - p["m"] * x * x / p["omega"])))


def _log_bessel0(z: Column) -> Column:
    return log_bessel(0, z)


register(Family("rician", ("nu", "sigma"), _fourth, _rician, lambda x, p: _inside(x > 0, F.ln(x) - 2 * F.ln(p["sigma"]) - (x * x + p["nu"] ** 2) / (2 * p["sigma"] ** 2) + _log_bessel0(x * p["nu"] / p["sigma"] ** 2))))


def _skellam(s: Stats) -> Params:
    m, v = _mean_var(s)
    v = F.greatest(v, F.abs(m))
    return {"mu1": (v + m) / 2, "mu2": (v - m) / 2}


register(Family("skellam", ("mu1", "mu2"), _moments, _skellam, lambda x, p: _inside(x == F.floor(x), x / 2 * F.ln(p["mu1"] / p["mu2"]) - p["mu1"] - p["mu2"] + log_bessel(F.abs(x), 2 * F.sqrt(p["mu1"] * p["mu2"])))))


def _circle(x: Column, w: Column) -> Stats:
    return {"n": F.sum(w), "c": F.sum(w * F.cos(x)), "s": F.sum(w * F.sin(x))}


def _rbar(s: Stats) -> Column:
    return F.sqrt(s["c"] ** 2 + s["s"] ** 2) / s["n"]


def _von_mises(s: Stats) -> Params:
    r = _rbar(s)
    kappa = F.when(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(1 / (r**3 - 4 * r**2 + 3 * r))
    return {"mu": F.atan2(s["s"], s["c"]), "kappa": kappa}


register(Family("von_mises", ("mu", "kappa"), _circle, _von_mises, lambda x, p: p["kappa"] * F.cos(x - p["mu"]) - _LN_2PI - _log_bessel0(p["kappa"])))
register(Family("wrapped_normal", ("mu", "sigma2"), _circle, lambda s: {"mu": F.atan2(s["s"], s["c"]), "sigma2": -2 * F.ln(_rbar(s))}, lambda x, p: F.ln(sum((F.exp(-((F.pmod(x - p["mu"] + math.pi, F.lit(2 * math.pi)) - math.pi + 2 * math.pi * k) ** 2) / (2 * p["sigma2"])) for k in range(-3, 4)), F.lit(0.0))) - 0.5 * (_LN_2PI + F.ln(p["sigma2"]))))
register(Family("wrapped_cauchy", ("mu", "rho"), _circle, lambda s: {"mu": F.atan2(s["s"], s["c"]), "rho": _rbar(s)}, lambda x, p: F.ln(1 - p["rho"] ** 2) - _LN_2PI - F.ln(1 + p["rho"] ** 2 - 2 * p["rho"] * F.cos(x - p["mu"]))))


def _laplace_free(x: Column, w: Column) -> Stats:
    return {"n": F.sum(w), "med": F.median(x)}


# The scale needs the median first, so its fit takes two aggregations (fit_laplace); the density is a plain expression.
register(Family("laplace", ("loc", "b"), _laplace_free, None, lambda x, p: -F.ln(2 * p["b"]) - F.abs(x - p["loc"]) / p["b"]))


def _gamma_driver(s: dict[str, float]) -> dict[str, float]:
    """Newton on ln k - digamma(k) = ln(mean) - mean(ln)."""
    mean, c = s["s1"] / s["n"], math.log(s["s1"] / s["n"]) - s["sl"] / s["n"]
    k = (3 - c + math.sqrt((c - 3) ** 2 + 24 * c)) / (12 * c)
    for _ in range(50):
        step = (math.log(k) - digamma(k) - c) / (1 / k - trigamma(k))
        k = max(k - step, k / 10)
        if abs(step) < 1e-13 * k:
            break
    return {"k": k, "theta": mean / k}


def _inverse_gamma_driver(s: dict[str, float]) -> dict[str, float]:
    g = _gamma_driver(s)
    return {"alpha": g["k"], "beta": 1 / g["theta"]}


def _beta_driver(s: dict[str, float]) -> dict[str, float]:
    """Newton on the two log moments, from a moment start."""
    m, v = s["s1"] / s["n"], s["s2"] / s["n"] - (s["s1"] / s["n"]) ** 2
    t = max(m * (1 - m) / v - 1, 1e-3)
    a, b, la, lb = m * t, (1 - m) * t, s["sl"] / s["n"], s["sm"] / s["n"]
    for _ in range(100):
        g1, g2 = la - digamma(a) + digamma(a + b), lb - digamma(b) + digamma(a + b)
        q = trigamma(a + b)
        h11, h22 = q - trigamma(a), q - trigamma(b)
        det = h11 * h22 - q * q
        da, db = (h22 * g1 - q * g2) / det, (h11 * g2 - q * g1) / det
        a, b = max(a - da, a / 10), max(b - db, b / 10)
        if abs(da) + abs(db) < 1e-12 * (a + b):
            break
    return {"a": a, "b": b}


def _weibull_driver(s: dict[str, float]) -> dict[str, float]:
    """Shape from mean and variance by bisection on the coefficient of variation."""
    m, v = s["s1"] / s["n"], s["s2"] / s["n"] - (s["s1"] / s["n"]) ** 2
    want, lo, hi = math.log1p(v / m**2), 0.05, 100.0
    for _ in range(200):
        k = (lo + hi) / 2
        if math.lgamma(1 + 2 / k) - 2 * math.lgamma(1 + 1 / k) > want:
            lo = k
        else:
            hi = k
    return {"shape": k, "scale": m / math.gamma(1 + 1 / k)}


register(Family("gamma", ("k", "theta"), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x), "sl": F.sum(w * F.ln(x))}, None, lambda x, p: _inside(x > 0, (p["k"] - 1) * F.ln(x) - x / p["theta"] - lgamma(p["k"]) - p["k"] * F.ln(p["theta"])), _gamma_driver))
register(Family("inverse_gamma", ("alpha", "beta"), lambda x, w: {"n": F.sum(w), "s1": F.sum(w / x), "sl": -F.sum(w * F.ln(x))}, None, lambda x, p: _inside(x > 0, p["alpha"] * F.ln(p["beta"]) - lgamma(p["alpha"]) - (p["alpha"] + 1) * F.ln(x) - p["beta"] / x), _inverse_gamma_driver))
register(Family("beta", ("a", "b"), lambda x, w: {**_moments(x, w), "sl": F.sum(w * F.ln(x)), "sm": F.sum(w * F.ln(1 - x))}, None, lambda x, p: _inside((x > 0) & (x < 1), lgamma(p["a"] + p["b"]) - lgamma(p["a"]) - lgamma(p["b"]) + (p["a"] - 1) * F.ln(x) + (p["b"] - 1) * F.ln(1 - x)), _beta_driver))
register(Family("weibull", ("shape", "scale"), _moments, None, lambda x, p: _inside(x > 0, F.ln(p["shape"] / p["scale"]) + (p["shape"] - 1) * F.ln(x / p["scale"]) - F.pow(x / p["scale"], p["shape"])), _weibull_driver))


def negative_binomial(r: float) -> Family:
    """Failures before the r-th success; r is given."""
    return Family("negative_binomial", ("r", "p"), lambda x, w: {"n": F.sum(w), "s1": F.sum(w * x)}, lambda s: {"r": F.lit(r), "p": r * s["n"] / (r * s["n"] + s["s1"])}, lambda x, p: _inside((x >= 0) & (x == F.floor(x)), lgamma(x + p["r"]) - lgamma(p["r"]) - lgamma(x + 1) + p["r"] * F.ln(p["p"]) + x * F.ln(1 - p["p"])))


register(negative_binomial(5.0))


def _weight(df: DataFrame, weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def fit(df: DataFrame, family: str | Family, column: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Parameters of a family, one row per group, nulls and NaN left out. Closed forms stay lazy."""
    fam = FAMILIES[family] if isinstance(family, str) else family
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).withColumn("_x", x)
    if fam.name == "laplace":
        return fit_laplace(rows, "_x", by or [], weight)
    sums = fam.stats(F.col("_x"), _weight(df, weight))
    table = rows.groupBy(*(by or [])).agg(*[c.alias(f"_{k}") for k, c in sums.items()])
    if fam.solve is not None:
        got = fam.solve({k: F.col(f"_{k}") for k in sums})
        return table.select(*(by or []), *[got[k].cast("double").alias(k) for k in fam.params])
    solve, names, keys = fam.solve_on_driver, list(sums), by or []

    def per_group(batches):  # one row per group: the solver runs where the row is
        for pdf in batches:
            out = [solve({k: float(v) for k, v in zip(names, row, strict=True)}) for row in pdf[[f"_{k}" for k in names]].itertuples(index=False)]
            for k in fam.params:
                pdf[k] = [o[k] for o in out]
            yield pdf[[*keys, *fam.params]]

    schema = table.select(*keys).schema if keys else None
    from pyspark.sql import types as T

    fields = list(schema.fields) if schema else []
    return table.mapInPandas(per_group, T.StructType([*fields, *[T.StructField(k, T.DoubleType()) for k in fam.params]]))


def fit_laplace(rows: DataFrame, column: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Location: the median; scale: the mean absolute deviation from it."""
    med = rows.groupBy(*by).agg(F.median(column).alias("loc"))
    both = rows.join(F.broadcast(med), by) if by else rows.join(F.broadcast(med))
    w = _weight(rows, weight)
    return both.groupBy(*by, "loc").agg((F.sum(w * F.abs(F.col(column) - F.col("loc"))) / F.sum(w)).alias("b")).select(*by, "loc", "b")


def fit_categorical(df: DataFrame, column: str, by: list[str] | None = None, weight: str | None = None, pseudo: float = 0.0) -> DataFrame:
    """(by, level, n, p): level probabilities; `pseudo` is spread evenly over the levels seen."""
    keys = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("level")).agg(F.sum(_weight(df, weight)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    both = counts.join(totals, keys) if keys else counts.crossJoin(F.broadcast(totals))
    return both.select(*keys, "level", "n", ((F.col("n") + pseudo / F.col("_k")) / (F.col("_t") + pseudo)).alias("p"))


def score(df: DataFrame, family: str | Family, column: str, params: dict[str, float] | None = None, name: str = "ll") -> DataFrame:
    """Add a row's log-density. Parameters are given, or stand in columns of the family's names."""
    fam = FAMILIES[family] if isinstance(family, str) else family
    p = {k: F.lit(float(params[k])) for k in fam.params} if params else {k: F.col(k) for k in fam.params}
    return df.withColumn(name, fam.logpdf(F.col(column).cast("double"), p))
