"""Fits and scores of families over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import families as fam
from tessel.operators import families_shape as shape
from tessel.plans.base import query, rounded, table

_M = "avg(x)"
_V = "(avg(x * x) - avg(x) * avg(x))"
_SK = f"((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / pow({_V}, 1.5))"
_TAU = f"(pow({_SK} / 2, 1.0 / 3) * sqrt({_V}))"
_DELTA = f"(sign({_SK}) * sqrt(pi() / 2 * pow(abs({_SK}), 2.0 / 3) / (pow(abs({_SK}), 2.0 / 3) + pow((4 - pi()) / 2, 2.0 / 3))))"
_OMEGA = f"sqrt({_V} / (1 - 2 / pi() * {_DELTA} * {_DELTA}))"
_BB = f"(1 / (({_V} / (10 * avg(x) / 10 * (1 - avg(x) / 10)) - 1) / 9) - 1)"
#: name: (SQL of x over lineitem, SQL of each parameter).
_CLOSED = {
    "gaussian": ("l_quantity", {"mu": _M, "sigma2": _V}),
    "lognormal": ("l_extendedprice", {"mu": "avg(ln(x))", "sigma2": "(avg(ln(x) * ln(x)) - avg(ln(x)) * avg(ln(x)))"}),
    "exponential": ("l_quantity", {"beta": _M}),
    "poisson": ("l_quantity", {"lam": _M}),
    "geometric": ("l_linenumber", {"p": "1 / avg(x)"}),
    "bernoulli": ("CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END", {"p": _M}),
    "binomial": ("l_linenumber", {"p": "(sum(x) - min(x) * count(*)) / (count(*) * (max(x) - min(x)))", "n_trials": "max(x) - min(x)", "low": "min(x)"}),
    "pareto": ("l_quantity", {"xm": "min(x)", "alpha": "count(*) / (sum(ln(x)) - count(*) * ln(min(x)))"}),
    "uniform": ("l_quantity", {"low": "min(x)", "high": "max(x)"}),
    "rayleigh": ("l_quantity", {"sigma": "sqrt(avg(x * x) / 2)"}),
    "halfnormal": ("l_quantity", {"sigma": "sqrt(avg(x * x))"}),
    "inverse_gaussian": ("l_quantity", {"mu": _M, "lam": "1 / (avg(1 / x) - 1 / avg(x))"}),
    "logistic": ("l_quantity", {"loc": _M, "scale": f"sqrt(3 * {_V}) / pi()"}),
    "gumbel": ("l_quantity", {"loc": f"avg(x) - 0.5772156649015329 * sqrt({_V} * 6) / pi()", "scale": f"sqrt({_V} * 6) / pi()"}),
    "student_t": ("l_quantity", {"df": "5.0", "loc": _M, "scale": f"sqrt({_V} * 3 / 5)"}),
    "generalized_pareto": ("l_quantity", {"xi": f"0.5 * (1 - avg(x) * avg(x) / {_V})", "scale": f"avg(x) * (1 - 0.5 * (1 - avg(x) * avg(x) / {_V}))"}),
    "tweedie": ("l_quantity", {"mean": _M, "phi": f"{_V} / pow(avg(x), 1.5)"}),
    "nakagami": ("l_quantity", {"m": "pow(avg(x * x), 2) / (avg(x * x * x * x) - pow(avg(x * x), 2))", "omega": "avg(x * x)"}),
    "rician": ("l_quantity + 100", {"nu": "sqrt(greatest(avg(x * x) - (avg(x * x) - sqrt(greatest(2 * pow(avg(x * x), 2) - avg(x * x * x * x), 0))), 0))", "sigma": "sqrt((avg(x * x) - sqrt(greatest(2 * pow(avg(x * x), 2) - avg(x * x * x * x), 0))) / 2)"}),
    "skellam": ("l_linenumber - 3", {"mu1": f"(greatest({_V}, abs(avg(x))) + avg(x)) / 2", "mu2": f"(greatest({_V}, abs(avg(x))) - avg(x)) / 2"}),
    "negative_binomial": ("l_linenumber", {"r": "5.0", "p": "5.0 * count(*) / (5.0 * count(*) + sum(x))"}),
    "von_mises": ("2 * pi() * l_linenumber / 9", {"mu": "atan2(sum(sin(x)), sum(cos(x)))", "kappa": "CASE WHEN {R} < 0.53 THEN 2 * {R} + pow({R}, 3) + 5 * pow({R}, 5) / 6 WHEN {R} < 0.85 THEN -0.4 + 1.39 * {R} + 0.43 / (1 - {R}) ELSE 1 / (pow({R}, 3) - 4 * pow({R}, 2) + 3 * {R}) END"}),
    "wrapped_normal": ("2 * pi() * l_linenumber / 9", {"mu": "atan2(sum(sin(x)), sum(cos(x)))", "sigma2": "-2 * ln({R})"}),
    "wrapped_cauchy": ("2 * pi() * l_linenumber / 9", {"mu": "atan2(sum(sin(x)), sum(cos(x)))", "rho": "{R}"}),
    "exgaussian": ("l_quantity * l_quantity / 100", {"mu": f"avg(x) - {_TAU}", "sigma2": f"{_V} - {_TAU} * {_TAU}", "lam": f"1 / {_TAU}"}),
    "skew_normal": ("l_quantity * l_quantity / 100", {"loc": f"avg(x) - {_OMEGA} * sqrt(2 / pi()) * {_DELTA}", "scale": _OMEGA, "shape": f"{_DELTA} / sqrt(1 - {_DELTA} * {_DELTA})"}),
    "beta_binomial": ("round(l_discount * 100)", {"trials": "10.0", "a": f"avg(x) / 10 * {_BB}", "b": f"(1 - avg(x) / 10) * {_BB}"}),
    "point_mass": ("l_quantity", {"value": "0.0"}),
}
_R = "(sqrt(pow(sum(cos(x)), 2) + pow(sum(sin(x)), 2)) / count(*))"


def _closed(name: str, x: str, params: dict[str, str]) -> None:
    cols = ", ".join(f"round(CAST({e.replace('{R}', _R)} AS DOUBLE), 6) + 0.0 AS {k}" for k, e in params.items())
    sql = f"SELECT l_returnflag, {cols} FROM (SELECT l_returnflag, CAST({x} AS DOUBLE) AS x FROM lineitem) GROUP BY l_returnflag"

    @query(f"fit_{name}", sql)
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(x).alias("x"))
        return rounded(fam.fit(rows, name, "x", by=["l_returnflag"]))


for _name, (_x, _params) in _CLOSED.items():
    _closed(_name, _x, _params)


@query("fit_laplace", "WITH m AS (SELECT l_returnflag, median(l_quantity) AS loc FROM lineitem GROUP BY l_returnflag) SELECT l.l_returnflag, round(m.loc, 6) AS loc, round(avg(abs(l_quantity - m.loc)), 6) AS b FROM lineitem l JOIN m USING (l_returnflag) GROUP BY l.l_returnflag, m.loc")
def fit_laplace(spark, sf_dir):
    return rounded(fam.fit(table(spark, sf_dir, "lineitem"), "laplace", "l_quantity", by=["l_returnflag"]))


def _driver(name: str, x: str) -> None:
    @query(f"fit_{name}")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(x).alias("x"))
        return rounded(fam.fit(rows, name, "x", by=["l_returnflag"]))


for _name, _x in (("gamma", "l_quantity"), ("inverse_gamma", "l_quantity"), ("beta", "(l_discount * 100 + 1) / 13")):
    _driver(_name, _x)


def _bisected(name: str, x: str, lo: str, hi: str, below: str, params: dict[str, str], steps: int = 80) -> None:
    """A fit whose last parameter k solves an equation: `below` says that it lies above k. Sums are m1 .. m4, v, sk and ku."""
    cols = ", ".join(f"round({e}, 5) + 0.0 AS {k}" for k, e in params.items())
    below = below.replace("k_", "((lo + hi) / 2)")
    sql = f"""WITH RECURSIVE x AS (SELECT l_returnflag, CAST({x} AS DOUBLE) AS x FROM lineitem), m AS (SELECT l_returnflag, avg(x) AS m1, {_V} AS v, {_SK} AS sk, (avg(x * x * x * x) - 4 * avg(x) * avg(x * x * x) + 6 * pow(avg(x), 2) * avg(x * x) - 3 * pow(avg(x), 4)) / pow({_V}, 2) AS ku FROM x GROUP BY l_returnflag),
b AS (SELECT l_returnflag, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, 0 AS i FROM m UNION ALL SELECT l_returnflag, CASE WHEN {below} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {below} THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b JOIN m USING (l_returnflag) WHERE i < {steps}),
r AS (SELECT m.*, (lo + hi) / 2 AS k FROM b JOIN m USING (l_returnflag) WHERE i = {steps}) SELECT l_returnflag, {cols} FROM r"""

    @query(f"fit_{name}", sql)
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(x).alias("x"))
        return rounded(fam.fit(rows, name, "x", by=["l_returnflag"]), 5)


_bisected("weibull", "l_quantity", "0.05", "100", "lgamma(1 + 2 / k_) - 2 * lgamma(1 + 1 / k_) > ln(1 + v / (m1 * m1))", {"shape": "k", "scale": "m1 / exp(lgamma(1 + 1 / k))"})
_bisected("log_series", "l_linenumber", "1e-12", "1 - 1e-12", "-k_ / ((1 - k_) * ln(1 - k_)) < m1", {"p": "k"})
_bisected("generalized_gaussian", "l_quantity", "0.25", "50", "exp(lgamma(5 / k_) + lgamma(1 / k_) - 2 * lgamma(3 / k_)) > ku", {"mu": "m1", "alpha": "sqrt(v * exp(lgamma(1 / k) - lgamma(3 / k)))", "beta": "k"})
_bisected(
    "generalized_extreme_value",
    "l_quantity * l_quantity / 100",
    "-1.0",
    "1.0 / 3 - 1e-4",
    "sign(k_) * (exp(lgamma(1 - 3 * k_)) - 3 * exp(lgamma(1 - 2 * k_)) * exp(lgamma(1 - k_)) + 2 * pow(exp(lgamma(1 - k_)), 3)) / pow(exp(lgamma(1 - 2 * k_)) - pow(exp(lgamma(1 - k_)), 2), 1.5) < sk",
    {
        "loc": "m1 - sqrt(v) * abs(k) / sqrt(exp(lgamma(1 - 2 * k)) - pow(exp(lgamma(1 - k)), 2)) * (exp(lgamma(1 - k)) - 1) / k",
        "scale": "sqrt(v) * abs(k) / sqrt(exp(lgamma(1 - 2 * k)) - pow(exp(lgamma(1 - k)), 2))",
        "shape": "k",
    },
)


@query("fit_uniform_spike", """WITH c AS (SELECT l_returnflag, CAST(l_linenumber AS DOUBLE) AS x, count(*) AS c FROM lineitem GROUP BY 1, 2), t AS (SELECT l_returnflag, sum(c) AS n, min(x) AS low, max(x) - min(x) + 1 AS levels FROM c GROUP BY 1),
l AS (SELECT c.l_returnflag, x, c / n AS p, low, levels, CASE WHEN c = n THEN 0 ELSE (n - c) * (ln((n - c) / n) - ln(levels - 1)) END + c * ln(c / n) AS ll FROM c JOIN t USING (l_returnflag)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY ll DESC, x) AS k FROM l) SELECT l_returnflag, x AS spike, round(p, 6) AS p, low, levels FROM r WHERE k = 1""")
def fit_uniform_spike(spark, sf_dir):
    return rounded(shape.fit_uniform_spike(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag"]))


@query("fit_categorical", "SELECT l_linestatus, l_returnflag AS level, CAST(count(*) AS DOUBLE) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS p FROM lineitem GROUP BY l_linestatus, l_returnflag")
def fit_categorical(spark, sf_dir):
    return rounded(fam.fit_categorical(table(spark, sf_dir, "lineitem"), "l_returnflag", by=["l_linestatus"]))


@query("fit_integer_categorical", "SELECT l_linenumber AS level, CAST(count(*) AS DOUBLE) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM lineitem), 6) AS p FROM lineitem GROUP BY l_linenumber")
def fit_integer_categorical(spark, sf_dir):
    return rounded(fam.fit_categorical(table(spark, sf_dir, "lineitem"), "l_linenumber"))


@query("fit_weighted_gaussian", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mu, round((sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) - pow(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2)) / 1e6, 4) AS sigma2_m FROM lineitem GROUP BY l_returnflag")
def fit_weighted_gaussian(spark, sf_dir):
    got = fam.fit(table(spark, sf_dir, "lineitem"), "gaussian", "l_extendedprice", by=["l_returnflag"], weight="l_quantity")
    return got.select("l_returnflag", F.round("mu", 4).alias("mu"), F.round(F.col("sigma2") / 1e6, 4).alias("sigma2_m"))


def _series(order: str, half: str) -> str:
    """SQL of ln I(order, 2 half), by its power series."""
    return f"ln(list_sum(list_transform(range(0, 150), lambda m: exp((2 * m + {order}) * ln({half}) - lgamma(m + 1) - lgamma(m + {order} + 1)))))"


#: name: (SQL of x, parameters, SQL of the log-density).
_SCORES = {
    "von_mises": ("2 * pi() * l_linenumber / 9", {"mu": 1.0, "kappa": 1.5}, f"1.5 * cos(x - 1) - ln(2 * pi()) - {_series('0', '0.75')}"),
    "rician": ("l_quantity + 100", {"nu": 100.0, "sigma": 20.0}, f"ln(x) - 2 * ln(20) - (x * x + 10000) / 800 + {_series('0', '(x / 8)')}"),
    "skellam": ("l_linenumber - 3", {"mu1": 2.0, "mu2": 1.5}, f"x / 2 * ln(2 / 1.5) - 3.5 + {_series('abs(x)', 'sqrt(3)')}"),
    "gaussian": ("l_quantity", {"mu": 25.0, "sigma2": 200.0}, "-0.5 * ln(2 * pi() * 200) - pow(x - 25, 2) / 400"),
    "lognormal": ("l_extendedprice", {"mu": 10.0, "sigma2": 0.5}, "-0.5 * ln(2 * pi() * 0.5) - pow(ln(x) - 10, 2) / 1.0 - ln(x)"),
    "exponential": ("l_quantity", {"beta": 25.0}, "-ln(25) - x / 25"),
    "poisson": ("l_quantity", {"lam": 25.0}, "x * ln(25) - 25 - lgamma(x + 1)"),
    "geometric": ("l_linenumber", {"p": 0.3}, "ln(0.3) + (x - 1) * ln(0.7)"),
    "bernoulli": ("CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END", {"p": 0.4}, "CASE WHEN x = 1 THEN ln(0.4) ELSE ln(0.6) END"),
    "binomial": ("l_linenumber", {"p": 0.4, "n_trials": 7.0, "low": 0.0}, "lgamma(8) - lgamma(x + 1) - lgamma(8 - x) + x * ln(0.4) + (7 - x) * ln(0.6)"),
    "pareto": ("l_quantity", {"xm": 1.0, "alpha": 0.5}, "ln(0.5) - 1.5 * ln(x)"),
    "uniform": ("l_quantity", {"low": 0.0, "high": 50.0}, "-ln(50)"),
    "rayleigh": ("l_quantity", {"sigma": 20.0}, "ln(x) - 2 * ln(20) - x * x / 800"),
    "halfnormal": ("l_quantity", {"sigma": 30.0}, "0.5 * ln(2 / pi()) - ln(30) - x * x / 1800"),
    "inverse_gaussian": ("l_quantity", {"mu": 25.0, "lam": 10.0}, "0.5 * (ln(10) - ln(2 * pi()) - 3 * ln(x)) - 10 * pow(x - 25, 2) / (2 * 625 * x)"),
    "logistic": ("l_quantity", {"loc": 25.0, "scale": 8.0}, "-(x - 25) / 8 - ln(8) - 2 * ln(1 + exp(-(x - 25) / 8))"),
    "gumbel": ("l_quantity", {"loc": 20.0, "scale": 11.0}, "-ln(11) - (x - 20) / 11 - exp(-(x - 20) / 11)"),
    "laplace": ("l_quantity", {"loc": 25.0, "b": 12.0}, "-ln(24) - abs(x - 25) / 12"),
    "gamma": ("l_quantity", {"k": 2.0, "theta": 12.0}, "ln(x) - x / 12 - lgamma(2) - 2 * ln(12)"),
    "inverse_gamma": ("l_quantity", {"alpha": 2.0, "beta": 12.0}, "2 * ln(12) - lgamma(2) - 3 * ln(x) - 12 / x"),
    "beta": ("(l_discount * 100 + 1) / 13", {"a": 2.0, "b": 3.0}, "lgamma(5) - lgamma(2) - lgamma(3) + ln(x) + 2 * ln(1 - x)"),
    "weibull": ("l_quantity", {"shape": 1.5, "scale": 28.0}, "ln(1.5 / 28) + 0.5 * ln(x / 28) - pow(x / 28, 1.5)"),
    "student_t": ("l_quantity", {"df": 5.0, "loc": 25.0, "scale": 10.0}, "lgamma(3) - lgamma(2.5) - 0.5 * ln(5 * pi()) - ln(10) - 3 * ln(1 + pow((x - 25) / 10, 2) / 5)"),
    "generalized_pareto": ("l_quantity", {"xi": 0.2, "scale": 20.0}, "-ln(20) - 6 * ln(1 + 0.2 * x / 20)"),
    "nakagami": ("l_quantity", {"m": 0.8, "omega": 800.0}, "ln(2) + 0.8 * ln(0.8 / 800) - lgamma(0.8) + 0.6 * ln(x) - 0.8 * x * x / 800"),
    "negative_binomial": ("l_linenumber", {"r": 5.0, "p": 0.6}, "lgamma(x + 5) - lgamma(5) - lgamma(x + 1) + 5 * ln(0.6) + x * ln(0.4)"),
    "wrapped_cauchy": ("2 * pi() * l_linenumber / 9", {"mu": 1.0, "rho": 0.3}, "ln(0.91) - ln(2 * pi()) - ln(1.09 - 0.6 * cos(x - 1))"),
    "wrapped_normal": ("2 * pi() * l_linenumber / 9", {"mu": 1.0, "sigma2": 0.5}, "ln(list_sum(list_transform(range(-3, 4), lambda j: exp(-pow((x - 1 + pi()) - 2 * pi() * floor((x - 1 + pi()) / (2 * pi())) - pi() + 2 * pi() * j, 2))))) - 0.5 * ln(2 * pi() * 0.5)"),
    "generalized_extreme_value": ("l_quantity", {"loc": 18.0, "scale": 12.0, "shape": -0.1}, "-ln(12) - 0.9 * ln(1 - 0.1 * (x - 18) / 12) / -0.1 - exp(-ln(1 - 0.1 * (x - 18) / 12) / -0.1)"),
    "generalized_gaussian": ("l_quantity", {"mu": 25.0, "alpha": 20.0, "beta": 3.0}, "ln(3) - ln(2) - ln(20) - lgamma(1 / 3.0) - pow(abs(x - 25) / 20, 3)"),
    "log_series": ("l_linenumber", {"p": 0.7}, "x * ln(0.7) - ln(x) - ln(-ln(1 - 0.7))"),
    "beta_binomial": ("round(l_discount * 100)", {"trials": 10.0, "a": 2.0, "b": 3.0}, "lgamma(11) - lgamma(x + 1) - lgamma(11 - x) + lgamma(x + 2) + lgamma(13 - x) - lgamma(15) - lgamma(2) - lgamma(3) + lgamma(5)"),
    "uniform_spike": ("l_linenumber", {"spike": 3.0, "p": 0.3, "low": 1.0, "levels": 7.0}, "CASE WHEN x = 3 THEN ln(0.3) ELSE ln(0.7) - ln(6) END"),
    "tweedie": ("l_quantity", {"mean": 25.0, "phi": 1.5}, "-0.5 * (ln(2 * pi()) + ln(1.5) + 1.5 * ln(x)) - 2 * (pow(x, 0.5) / (-0.5 * 0.5) + x * pow(25, -0.5) / 0.5 + pow(25, 0.5) / 0.5) / 3"),
}


def _scored(name: str, x: str, params: dict[str, float], density: str) -> None:
    sql = f"SELECT l_returnflag, count(*) AS n, round(sum(ll) / count(*), 6) AS mean_ll, round(min(ll), 6) AS least_ll FROM (SELECT l_returnflag, {density} AS ll FROM (SELECT l_returnflag, CAST({x} AS DOUBLE) AS x FROM lineitem)) GROUP BY l_returnflag"

    @query(f"score_{name}", sql)
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(x).alias("x"))
        return rounded(fam.score(rows, name, "x", params).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("ll").alias("mean_ll"), F.min("ll").alias("least_ll")))


for _name, (_x, _p, _d) in _SCORES.items():
    _scored(_name, _x, _p, _d)
