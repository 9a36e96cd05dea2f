"""Operators that SQL can't express, against numpy, enumeration or numerical integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions.special import normal_log_cdf_column
from tessel.operators import corpus, families, families_shape, multivariate, profile, rankings, regression
from tessel.operators import survival_regression as sr
from tessel.operators import tests as t


def table(spark, columns, schema, parts=5):
    return spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else int(v) if isinstance(v, np.integer) else v for v in r) for r in zip(*columns, strict=True)], schema).repartition(parts)


def test_normal_log_cdf(spark):
    xs = [-30.0, -12.5, -6.1, -6.0, -5.9, -3.2, -3.0, -1.0, -1e-9, 0.0, 0.5, 2.99, 3.01, 6.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_log_cdf_column(F.col("x")).alias("y")).collect()
    for r in got:
        want = math.log(0.5 * math.erfc(-r.x / math.sqrt(2)))
        assert r.y == pytest.approx(want, rel=1e-9, abs=1e-13), r.x


@pytest.mark.parametrize(("name", "params", "lo", "hi"), [
    ("exgaussian", {"mu": 1.0, "sigma2": 0.5, "lam": 0.7}, -8, 40),
    ("skew_normal", {"loc": -1.0, "scale": 2.0, "shape": -3.0}, -20, 15),
    ("generalized_extreme_value", {"loc": 0.5, "scale": 1.5, "shape": 0.2}, -6.9, 300),
    ("generalized_extreme_value", {"loc": 0.5, "scale": 1.5, "shape": 0.0}, -10, 50),
    ("generalized_gaussian", {"mu": 0.3, "alpha": 1.2, "beta": 1.3}, -30, 30),
])
def test_densities_integrate_to_one(spark, name, params, lo, hi):
    n = 20_000
    grid = spark.range(n).select((F.lit(float(lo)) + (F.col("id") + 0.5) * ((hi - lo) / n)).alias("x"))
    total = families.score(grid, name, "x", params).agg(F.sum(F.exp("ll")) * ((hi - lo) / n)).head()[0]
    assert total == pytest.approx(1, abs=2e-3)


@pytest.mark.parametrize(("name", "params"), [("log_series", {"p": 0.6}), ("beta_binomial", {"trials": 10.0, "a": 0.7, "b": 2.5}), ("uniform_spike", {"spike": 3.0, "p": 0.4, "low": 1.0, "levels": 9.0}), ("point_mass", {"value": 4.0})])
def test_masses_add_up_to_one(spark, name, params):
    got = families.score(spark.range(-3, 200).select(F.col("id").cast("double").alias("x")), name, "x", params)
    assert got.agg(F.sum(F.exp("ll"))).head()[0] == pytest.approx(1, abs=1e-9)


def test_shape_fits_recover_their_own_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(2, 1, 40_000) + rng.exponential(1.5, 40_000)
    rows = table(spark, [x], "x double")
    p = families.fit(rows, "exgaussian", "x").head()
    assert p.mu + 1 / p.lam == pytest.approx(x.mean()) and p.sigma2 + 1 / p.lam**2 == pytest.approx(x.var(), rel=1e-6) and p.lam == pytest.approx(1 / 1.5, rel=0.1)
    p = families.fit(rows, "generalized_extreme_value", "x").head()
    g1, g2 = math.gamma(1 - p.shape), math.gamma(1 - 2 * p.shape)
    assert p.loc + p.scale * (g1 - 1) / p.shape == pytest.approx(x.mean()) and p.scale**2 * (g2 - g1 * g1) / p.shape**2 == pytest.approx(x.var())
    one = spark.createDataFrame([(3,)] * 7, "k int")
    assert families_shape.fit_uniform_spike(one, "k").head().asDict() == {"spike": 3.0, "p": 1.0, "low": 3.0, "levels": 1.0}


def by_newton(x, y, mean, weight, steps=60):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        m = mean(x @ b)
        b += np.linalg.solve((x * weight(m)[:, None]).T @ x, x.T @ (y - m))
    return b


def test_regressions_equal_dense_algebra(spark):
    rng = np.random.default_rng(1)
    n = 900
    a, b, g = rng.normal(size=n), rng.uniform(size=n), rng.integers(0, 30, n)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.5 + a - b)))).astype(int)
    k = rng.poisson(np.exp(0.3 + 0.5 * a))
    rows = table(spark, [a, b, g, y, k], "a double, b double, g long, y long, k long").cache()
    x = np.stack([np.ones(n), a, b], axis=1)
    assert np.allclose(regression.glm(rows, ["a", "b"], "y"), by_newton(x, y, lambda z: 1 / (1 + np.exp(-z)), lambda m: m * (1 - m)), atol=1e-7)
    assert np.allclose(regression.glm(rows, ["a", "b"], "k", "poisson"), by_newton(x, k, np.exp, lambda m: m), atol=1e-7)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ k
    e = k - x @ beta
    got, se = regression.robust_errors(rows, ["a", "b"], "k")
    meat = (x * (e * e)[:, None]).T @ x
    assert np.allclose(got, beta) and np.allclose(se, np.sqrt(np.diag(inverse @ meat @ inverse) * n / (n - 3)))
    _, se = regression.robust_errors(rows, ["a", "b"], "k", "g")
    sums = np.stack([(x * e[:, None])[g == c].sum(axis=0) for c in np.unique(g)])
    m = len(sums)
    assert np.allclose(se, np.sqrt(np.diag(inverse @ sums.T @ sums @ inverse) * m / (m - 1) * (n - 1) / (n - 3)))


def cox_by_hand(x, t_, e, s, beta, ties):
    grad, hess, ll = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2), 0.0
    w = np.exp(x @ beta)
    for stratum in np.unique(s):
        for at in np.unique(t_[(e == 1) & (s == stratum)]):
            risk, tied = (t_ >= at) & (s == stratum), (t_ == at) & (e == 1) & (s == stratum)
            d = tied.sum()
            grad += x[tied].sum(axis=0)
            ll += (x[tied] @ beta).sum() - d * np.log(w[risk].sum())
            for j in range(d):
                off = w * tied * (j / d if ties == "efron" else 0)
                own = w * risk - off
                m = own @ x / own.sum()
                grad -= m
                hess -= (x * own[:, None]).T @ x / own.sum() - np.outer(m, m)
    return grad, hess, ll


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_solves_the_score_equations(spark, ties):
    rng = np.random.default_rng(2)
    n = 400
    x = np.stack([rng.normal(size=n), rng.integers(0, 2, n)], axis=1)
    t_ = np.ceil(rng.exponential(6 * np.exp(-0.7 * x[:, 0])))
    e, s = rng.integers(0, 4, n).clip(0, 1), rng.integers(0, 2, n)
    rows = table(spark, [x[:, 0], x[:, 1], t_, e, s], "a double, b double, t double, e long, s long")
    beta, se, ll, steps = sr.cox_ph(rows, "t", "e", ["a", "b"], "s", ties)
    grad, hess, want = cox_by_hand(x, t_, e, s, beta, ties)
    assert steps < 12 and np.abs(grad).max() < 1e-6 and np.allclose(se, np.sqrt(np.diag(np.linalg.inv(-hess))), rtol=1e-6) and ll == pytest.approx(want, rel=1e-9)
    assert beta[0] == pytest.approx(0.7, abs=0.2)


def test_censored_weibull_and_baseline_hazard(spark):
    rng = np.random.default_rng(3)
    n = 4000
    life, cut = 2 * rng.weibull(1.5, n), 2.5 * rng.weibull(1.2, n)
    t_, e = np.minimum(life, cut), (life <= cut).astype(int)
    rows = table(spark, [t_, e], "t double, e long")
    k, scale = sr.fit_censored_weibull(rows, "t", "e")
    assert k == pytest.approx(1.5, abs=0.06) and scale == pytest.approx(2, abs=0.08)
    z = t_**k
    assert 1 / k + np.log(t_[e == 1]).mean() == pytest.approx((z * np.log(t_)).sum() / z.sum(), rel=1e-8)
    got = sr.baseline_hazard(rows.limit(200), "t", "e", [], np.zeros(0)).toPandas().sort_values("t")
    assert (np.diff(got.hazard) > 0).all()


def test_mallows_and_worths(spark):
    orders = [[1, 2, 0, 3], [1, 0, 3, 2], [1, 3, 2, 0]]
    rows = spark.createDataFrame([(v, i, p + 1) for v, o in enumerate(orders) for p, i in enumerate(o)], "v int, item int, pos int")
    before = np.zeros((4, 4))
    for o in orders:
        for p, i in enumerate(o):
            for j in o[p + 1 :]:
                before[i, j] += 1
    assert {(r.a, r.b): r.n for r in rankings.precedence(rows, "v", "item", "pos").collect()} == {(i, j): before[i, j] for i in range(4) for j in range(4) if before[i, j]}
    centre = rankings.mallows_centre(rows, "v", "item", "pos").orderBy("place").collect()
    place = [r.item for r in centre]
    mean = sum(before[place[j], place[i]] for i in range(4) for j in range(i + 1, 4)) / 3
    assert centre[0].item == 1 and centre[0].mean_distance == pytest.approx(mean)
    theta = rankings.mallows_theta(mean, 4)
    assert rankings.mallows_expected_distance(theta, 4) == pytest.approx(mean) and rankings.mallows_theta(3.5, 4) == 0.0
    from itertools import permutations

    every = spark.createDataFrame([(v, i, p + 1) for v, o in enumerate(permutations(range(4))) for p, i in enumerate(o)], "v int, item int, pos int")
    scored = rankings.mallows_score(every, rankings.mallows_centre(rows, "v", "item", "pos"), "v", "item", "pos", 0.8, 4)
    assert scored.agg(F.sum(F.exp("ll"))).head()[0] == pytest.approx(1)
    worths = spark.createDataFrame([(0, 0.1), (1, 0.4), (2, 0.3), (3, 0.2)], "item int, w double")
    assert rankings.plackett_luce_score(every, worths, "v", "item", "pos").agg(F.sum(F.exp("ll"))).head()[0] == pytest.approx(1)


def test_bradley_terry_balances_wins(spark):
    wins = spark.createDataFrame([(0, 1, 8), (1, 0, 4), (1, 2, 6), (2, 1, 3), (0, 2, 9), (2, 0, 2)], "a int, b int, n long")
    w = {r.item: r.w for r in rankings.bradley_terry(wins, 60).collect()}
    n = {(r.a, r.b): r.n for r in wins.collect()}
    for i in range(3):
        expected = sum((n[i, j] + n[j, i]) * w[i] / (w[i] + w[j]) for j in range(3) if j != i)
        assert expected == pytest.approx(sum(n[i, j] for j in range(3) if j != i), rel=1e-4)


@pytest.mark.parametrize(("logpdf", "cdf"), [
    (lambda u, v: multivariate.clayton_logpdf(u, v, 2.0), lambda u, v: (u**-2 + v**-2 - 1) ** -0.5),
    (lambda u, v: multivariate.frank_logpdf(u, v, 4.0), lambda u, v: -np.log1p(np.expm1(-4 * u) * np.expm1(-4 * v) / np.expm1(-4)) / 4),
    (lambda u, v: multivariate.frank_logpdf(u, v, -3.0), lambda u, v: np.log1p(np.expm1(3 * u) * np.expm1(3 * v) / np.expm1(3)) / 3),
    (lambda u, v: multivariate.gumbel_logpdf(u, v, 1.7), lambda u, v: np.exp(-(((-np.log(u)) ** 1.7 + (-np.log(v)) ** 1.7) ** (1 / 1.7)))),
])
def test_copula_densities_are_mixed_differences(spark, logpdf, cdf):
    if logpdf is None:
        return
    pts, h = [(0.2, 0.3), (0.5, 0.9), (0.8, 0.7), (0.35, 0.6)], 1e-4
    got = spark.createDataFrame(pts, "u double, v double").select("u", "v", F.exp(logpdf(F.col("u"), F.col("v"))).alias("d")).collect()
    for r in got:
        want = (cdf(r.u + h, r.v + h) - cdf(r.u - h, r.v + h) - cdf(r.u + h, r.v - h) + cdf(r.u - h, r.v - h)) / (4 * h * h)
        assert r.d == pytest.approx(want, rel=1e-4)


def test_log_ratios_go_back_and_keep_distances(spark):
    rows = spark.createDataFrame([(0.2, 0.3, 0.5), (0.6, 0.1, 0.3)], "a double, b double, c double")
    coordinates = rows.select(*[c.alias(f"z{i}") for i, c in enumerate(multivariate.log_ratios([F.col(c) for c in "abc"]))])
    back = coordinates.select(*multivariate.from_log_ratios([F.col("z0"), F.col("z1")])).collect()
    assert np.allclose(sorted(map(tuple, back)), [(0.2, 0.3, 0.5), (0.6, 0.1, 0.3)])
    (x, y), raw = coordinates.collect(), np.log([(0.2, 0.3, 0.5), (0.6, 0.1, 0.3)])
    clr = raw - raw.mean(axis=1, keepdims=True)
    assert np.linalg.norm(np.array(x) - np.array(y)) == pytest.approx(np.linalg.norm(clr[0] - clr[1]))


def test_concentration_solves_the_mean_length():
    for dim in (2, 3, 10, 64):
        for kappa in (0.5, 3.0, 20.0, 150.0):
            # I(v, k) by its series in logarithms.
            log_i = lambda v: np.logaddexp.reduce([(2 * j + v) * math.log(kappa / 2) - math.lgamma(j + 1) - math.lgamma(j + v + 1) for j in range(600)])  # noqa: B023, E731
            ratio = math.exp(log_i(dim / 2) - log_i(dim / 2 - 1))
            assert multivariate.bessel_ratio(dim / 2, kappa) == pytest.approx(ratio, rel=1e-9)
            assert multivariate.concentration(ratio, dim, 8) == pytest.approx(kappa, rel=1e-6)


def test_orders_folds_and_samples(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.lit(2.5).alias("v"))
    one, two = (corpus.global_order(rows.repartition(p), "id", 3, 1, 4).orderBy("order_key").collect() for p in (3, 11))
    assert one == two and {r.reader for r in one} == {0, 1, 2, 3} and [r.id for r in one] != list(range(1000))
    assert [r.id for r in corpus.global_order(rows, "id", 3, 2, 4).orderBy("order_key").collect()] != [r.id for r in one]
    folds = regression.group_kfold(rows, "g", 3).collect()
    loads = [sum(r.n for r in folds if r.fold == f) for f in range(3)]
    assert len(folds) == 7 and sum(loads) == 1000 and max(loads) - min(loads) <= 143
    for train_end, start, end in regression.time_series_folds(103, 4, 5):
        assert train_end == start - 5 and start < end <= 103
    boot = regression.poisson_bootstrap(rows, "id", "v", 5).collect()
    again = regression.poisson_bootstrap(rows.repartition(9), "id", "v", 5).collect()
    assert sorted(map(tuple, boot)) == sorted(map(tuple, again)) and all(r.mean == pytest.approx(2.5) and abs(r.n - 1000) < 150 for r in boot)


def test_dependence_is_found(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, 600)
    b = np.where(rng.uniform(size=600) < 0.9, a, rng.integers(0, 3, 600))
    c = rng.integers(0, 3, 600)
    rows = table(spark, [a, b, c], "a long, b long, c long")
    edges = profile.dependency_forest(profile.pairwise_mi(rows, ["a", "b", "c"]))
    joint = np.histogram2d(a, b, bins=3)[0] / 600
    p, q = joint.sum(axis=1, keepdims=True), joint.sum(axis=0, keepdims=True)
    want = (joint * np.log2(np.where(joint > 0, joint, 1) / (p * q))).sum()
    assert [tuple(sorted(e[:2])) for e in edges] == [("a", "b")] and edges[0][2] == pytest.approx(want, abs=0.05)


def test_newton_families_solve_their_equations(spark):
    from tessel.functions.special import digamma

    rng = np.random.default_rng(5)
    x, u = rng.gamma(2.5, 1.7, 3000), rng.beta(2, 5, 3000)
    rows = table(spark, [x, u], "x double, u double").cache()
    p = families.fit(rows, "gamma", "x").head()
    assert p.k * p.theta == pytest.approx(x.mean()) and digamma(p.k) + math.log(p.theta) == pytest.approx(np.log(x).mean(), abs=1e-9)
    p = families.fit(rows, "inverse_gamma", "x").head()
    assert math.log(p.beta) - digamma(p.alpha) == pytest.approx(np.log(x).mean(), abs=1e-9) and p.alpha / p.beta == pytest.approx((1 / x).mean())
    p = families.fit(rows, "beta", "u").head()
    assert digamma(p.a) - digamma(p.a + p.b) == pytest.approx(np.log(u).mean(), abs=1e-8) and digamma(p.b) - digamma(p.a + p.b) == pytest.approx(np.log(1 - u).mean(), abs=1e-8)


def test_p_value_of_ranks_is_the_normal_tail(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", float(i * 31 % 97)) for i in range(97)], "g string, v double")
    r = t.mann_whitney_u(rows, "g", "v", "a", "b").head()
    assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-6)


def test_log_bessel_equals_its_integral(spark):
    from tessel.functions.special import log_bessel

    t = np.linspace(0, np.pi, 200_001)
    cases = [(n, z) for n in (0, 1, 5, 40) for z in (0.01, 1.0, 30.0, 599.0, 601.0, 5000.0)]
    got = {(r.n, r.z): r.v for r in spark.createDataFrame(cases, "n int, z double").select("n", "z", log_bessel(F.col("n"), F.col("z")).alias("v")).collect()}
    for n, z in cases:
        if n > z:
            m = range(60)
            want = n * np.log(z / 2) + np.log(sum(math.exp(2 * k * math.log(z / 2) - math.lgamma(k + 1) - math.lgamma(k + n + 1) + math.lgamma(n + 1)) for k in m)) - math.lgamma(n + 1)
            assert abs(got[n, z] - want) < 1e-9 * max(1, abs(want))
            continue
        want = z + np.log(np.trapezoid(np.exp(z * (np.cos(t) - 1)) * np.cos(n * t), t) / np.pi)
        assert abs(got[n, z] - want) < 1e-6
    zero = spark.range(1).select(log_bessel(F.lit(0), F.lit(0.0)).alias("a"), log_bessel(F.lit(2), F.lit(0.0)).alias("b")).head()
    assert abs(zero.a) < 1e-12 and zero.b == -math.inf


def test_large_tied_sets_are_dealt_out_and_breslow_needs_no_row_an_event(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 4).alias("t"), (F.col("id") % 3 != 0).cast("int").alias("e"), ((F.col("id") * 37) % 11).cast("double").alias("a"))
    want = sr.cox_ph(rows, "t", "e", ["a"])
    monkeypatch.setattr(sr, "TIED", 7)
    got = sr.cox_ph(rows, "t", "e", ["a"])
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and np.isclose(got[2], want[2])


def test_rows_of_a_key_are_not_gathered_to_be_scored(spark):
    from pyspark.sql import functions as F

    from tessel.operators import combinators as cb

    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    record = [cb.Leaf("gaussian", "x")]
    # As where Spark takes the model for large, by its estimate from the rows.
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cb.score_conditional(rows, cb.fit_conditional(rows, "k", record), "k", record)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert got.count() == 1000


def test_log_bessel_takes_no_row_through_a_list_of_terms(spark):
    """Against the series in exact enough sums, on both sides of where the expansion begins; a plain order as a column of it."""
    import math

    from tessel.functions.special import log_bessel

    def series(n, z):
        terms = [(2 * m + n) * math.log(z / 2) - math.lgamma(m + 1) - math.lgamma(m + n + 1) for m in range(1500)]
        return max(terms) + math.log(math.fsum(math.exp(t - max(terms)) for t in terms))

    cases = [(n, z) for n in (0, 1, 2, 7, 40, 300) for z in (1e-3, 0.5, 6.0, 23.9, 24.0, 37.5, 90.0, 700.0)]
    rows = spark.createDataFrame(cases, "n int, z double")
    got = {(r.n, r.z): r for r in rows.select("n", "z", log_bessel(F.col("n"), F.col("z")).alias("v"), *[log_bessel(n, F.col("z")).alias(f"v{n}") for n in (0, 1, 7)]).collect()}
    for n, z in cases:
        assert got[n, z].v == pytest.approx(series(n, z), rel=1e-10, abs=1e-10)
        if n in (0, 1, 7):
            assert got[n, z][f"v{n}"] == pytest.approx(series(n, z), rel=1e-10, abs=1e-10)
    assert "aggregate" not in rows.select(log_bessel(F.col("n"), F.col("z")))._jdf.queryExecution().optimizedPlan().toString()
