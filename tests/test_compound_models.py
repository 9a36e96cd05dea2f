"""Compound families and comparisons with ties: likelihoods rise, and small cases by hand."""

import math

import numpy as np
import pytest

from tessel.operators import combinators as cb
from tessel.operators import compound as cm


def test_dirichlet_multinomial_scores_and_fit(spark):
    rng = np.random.default_rng(0)
    true = np.array([0.8, 2.0, 4.0])
    bags = np.array([rng.multinomial(20, rng.dirichlet(true)) for _ in range(400)])
    rows = [(i, f"l{j}", int(c)) for i, b in enumerate(bags) for j, c in enumerate(b)] + [(None, "l0", 3), (1, None, 2), (2, "l0", None)]
    df = spark.createDataFrame(rows, "k int, level string, c int")
    alpha = cm.fit_dirichlet_multinomial(df, "k", "level", "c", 60)
    got = {r.level: r.alpha for r in alpha.collect()}
    assert np.allclose([got[f"l{j}"] for j in range(3)], true, rtol=0.2)
    a = np.array([got[f"l{j}"] for j in range(3)])
    lg = np.vectorize(math.lgamma)
    score = {r.k: r.ll for r in cm.score_dirichlet_multinomial(df, "k", "level", "c", alpha).collect()}
    for i, b in enumerate(bags[:20]):
        assert np.isclose(score[i], lg(21.0) + lg(a.sum()) - lg(20 + a.sum()) + (lg(b + a) - lg(a) - lg(b + 1.0)).sum(), atol=1e-6)
    odd = spark.createDataFrame([(1, "zz", 1)], "k int, level string, c int")
    assert cm.score_dirichlet_multinomial(odd, "k", "level", "c", alpha).head().ll == -math.inf


def test_student_t_fit_raises_the_likelihood_and_withstands_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 2)) @ np.array([[2.0, 0.0], [0.7, 0.5]]) + [1e6, -3]
    x[:25] += 500
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0)], "a double, b double")
    ll = lambda m, s: df.where("a IS NOT NULL").select(cm.student_t_logpdf(["a", "b"], 4.0, m, s).alias("l")).selectExpr("sum(l) AS l").head().l
    values = [ll(*cm.fit_student_t(df, ["a", "b"], 4.0, k)) for k in (0, 3, 25)]
    assert values[0] < values[1] < values[2]
    mean, shape = cm.fit_student_t(df, ["a", "b"], 4.0, 25)
    assert np.allclose(mean, [1e6, -3], atol=0.5) and shape[0, 0] < 10
    one = df.where("a IS NOT NULL").select("a", "b", cm.student_t_logpdf(["a", "b"], 4.0, mean, shape).alias("l")).head()
    d = np.array([one.a, one.b]) - mean
    want = math.lgamma(3) - math.lgamma(2) - math.log(4 * math.pi) - 0.5 * np.linalg.slogdet(shape)[1] - 3 * math.log1p(d @ np.linalg.solve(shape, d) / 4)
    assert np.isclose(one.l, want)


def test_semi_supervised_mixture_keeps_to_its_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal(0, 1)), [1.0, 0.0]) for _ in range(30)] + [(float(rng.normal(4, 1)), [0.0, 1.0]) for _ in range(10)] + [(float(rng.normal(4 * (i % 4 == 0), 1)), None) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, prior array<double>").cache()
    model = cb.Mixture([cb.Leaf("gaussian", "x")], [0.5, 0.5], [{"0_mu": 1.0, "0_sigma2": 4.0}, {"0_mu": 2.0, "0_sigma2": 4.0}])
    trace = []
    for _ in range(12):
        model, ll = cm.semi_supervised_step(df, model, "prior")
        trace.append(ll)
    assert all(b >= a - 1e-7 for a, b in zip(trace, trace[1:], strict=False))
    assert abs(model.params[0]["0_mu"]) < 0.3 and abs(model.params[1]["0_mu"] - 4) < 0.8 and abs(model.weights[1] - 0.25) < 0.12


@pytest.mark.parametrize("kind", ["davidson", "rao_kupper"])
def test_ties_raise_the_likelihood_to_its_top(spark, kind):
    rng, worth, nu = np.random.default_rng(3), np.array([0.4, 0.3, 0.2, 0.1]), 0.8 if kind == "davidson" else 1.6
    rows = []
    for i in range(4):
        for j in range(4):
            for _ in range(60 if i != j else 0):
                a, b = worth[i], worth[j]
                p = np.array([a, b, nu * math.sqrt(a * b)]) if kind == "davidson" else np.array([a / (a + nu * b), b / (b + nu * a), (nu * nu - 1) * a * b / ((a + nu * b) * (b + nu * a))])
                rows.append((f"i{i}", f"i{j}", [1, -1, 0][int(rng.choice(3, p=p / p.sum()))]))
    met = cm.comparisons(spark.createDataFrame([*rows, ("i0", "i0", 1)], "a string, b string, o int"), "a", "b", "o").cache()
    assert met.selectExpr("sum(won + lost + tied) AS n").head().n == len(rows)
    values = []
    for steps in (1, 4, 40):
        w, tie = cm.fit_with_ties(met, kind, steps)
        values.append(cm.tie_loglik(met, w, kind, tie))
    assert values[0] < values[1] <= values[2] + 1e-9
    got = {r.item: r.w for r in w.collect()}
    assert np.isclose(sum(got.values()), 1) and np.allclose([got[f"i{k}"] for k in range(4)], worth, atol=0.08) and abs(tie - nu) < 0.25
    # No small change of a worth or of the tie parameter does better.
    for item in got:
        near = spark.createDataFrame([(k, v * (1.02 if k == item else 1.0)) for k, v in got.items()], "item string, w double")
        assert cm.tie_loglik(met, near, kind, tie) < values[2] + 1e-6
    assert cm.tie_loglik(met, w, kind, tie * 1.03) < values[2]
