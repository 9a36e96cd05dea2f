"""Recursions along sequences against enumeration, dense algebra and double sums, however the sequences are cut."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import chunks as ck
from tessel.operators import hawkes as hk
from tessel.operators import hidden_markov as hm
from tessel.operators import state_space as ss

CUTS = [512, 2]
INIT, MOVES = np.array([0.3, 0.5, 0.2]), np.array([[0.8, 0.15, 0.05], [0.35, 0.6, 0.05], [0.0, 0.1, 0.9]])
SYMBOLS = hm.CategoricalEmission({"a": [0.5, 0.1, 0.3], "b": [0.3, 0.3, 0.3], "c": [0.2, 0.6, 0.4]})
WORDS = ["abcab", "ccb", "a", "bacca", "abcabca"]


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [(k, t, s) for k, word in enumerate(WORDS) for t, s in enumerate(word)]
    rows += [(7, 0, "z"), (7, 1, "a"), (8, 0, "a"), (8, 1, "b"), (8, 2, "z"), (8, 3, "a"), (9, 0, None), (9, 1, "a"), (None, 0, "b")]
    return spark.createDataFrame(rows[::-1], "k int, t int, s string")


def paths(word):
    for z in product(range(3), repeat=len(word)):
        p = INIT[z[0]] * SYMBOLS.table[word[0]][z[0]]
        for t in range(1, len(word)):
            p *= MOVES[z[t - 1], z[t]] * SYMBOLS.table[word[t]][z[t]]
        yield p, z


@pytest.mark.parametrize("most", CUTS)
def test_forward_path_and_posterior_equal_enumeration(symbols, most):
    args = (symbols, "k", ["t"], "s", SYMBOLS, INIT, MOVES, most)
    ll = {r.k: (r.n, r.ll) for r in hm.forward(*args).collect()}
    assert ll[7] == (2, -np.inf) and ll[8] == (4, -np.inf)
    assert np.isclose(ll[9][1], np.log(INIT @ MOVES @ SYMBOLS.table["a"])) and np.isclose(ll[None][1], np.log(INIT @ SYMBOLS.table["b"]))
    best, gamma = {}, {}
    for r in hm.viterbi(*args).orderBy("k", "t").collect():
        best.setdefault(r.k, []).append(r.state)
    for r in hm.smooth(*args).orderBy("k", "t").collect():
        gamma.setdefault(r.k, []).append(r.gamma)
    assert best[7] == [None] * 2 and best[8] == [None] * 4 and not np.any(gamma[7]) and not np.any(gamma[8])
    for k, word in enumerate(WORDS):
        every = list(paths(word))
        total = sum(p for p, _ in every)
        assert np.isclose(ll[k][1], np.log(total))
        assert np.isclose(dict((z, p) for p, z in every)[tuple(best[k])], max(every)[0])
        want = [[sum(p for p, z in every if z[t] == i) / total for i in range(3)] for t in range(len(word))]
        assert np.allclose(gamma[k], want)


def test_baum_welch_climbs_however_it_is_cut_and_leaves_impossible_sequences_out(symbols):
    found = [hm.baum_welch(symbols, "k", ["t"], "s", SYMBOLS, INIT, MOVES, 5, most) for most in CUTS]
    emission, init, moves, trace = found[0]
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] > trace[0]
    assert np.isclose(init.sum(), 1) and np.allclose(moves.sum(axis=1), 1) and np.allclose(np.sum(list(emission.table.values()), axis=0), 1)
    for a, b in zip((init, moves, trace, list(emission.table.values())), (*found[1][1:], list(found[1][0].table.values())), strict=True):
        assert np.allclose(a, b)
    clean = hm.baum_welch(symbols.where("k IS NULL OR k NOT IN (7, 8)"), "k", ["t"], "s", SYMBOLS, INIT, MOVES, 5)
    assert np.allclose(clean[2], moves) and np.allclose(clean[3], trace)


def test_first_step_counts_equal_enumeration(spark):
    """One step of EM: starts, moves and symbols expected over all paths."""
    rows = spark.createDataFrame([(k, t, s) for k, word in enumerate(WORDS) for t, s in enumerate(word)], "k int, t int, s string")
    emission, init, moves, _ = hm.baum_welch(rows, "k", ["t"], "s", SYMBOLS, INIT, MOVES, 1, 2)
    start, move, sign = np.zeros(3), np.zeros((3, 3)), {s: np.zeros(3) for s in "abc"}
    for word in WORDS:
        every = list(paths(word))
        total = sum(p for p, _ in every)
        for p, z in every:
            start[z[0]] += p / total
            for t, s in enumerate(word):
                sign[s][z[t]] += p / total
                if t:
                    move[z[t - 1], z[t]] += p / total
    assert np.allclose(init, start / start.sum()) and np.allclose(moves, move / move.sum(axis=1, keepdims=True))
    whole = sum(sign.values())
    assert all(np.allclose(emission.table[s], sign[s] / whole) for s in "abc")


def test_states_of_different_families(spark):
    rng = np.random.default_rng(5)
    x = [np.concatenate([rng.poisson(3, 30), rng.poisson(3, 20) + 20.0, [np.nan]]) for _ in range(4)]
    rows = spark.createDataFrame([(k, t, None if np.isnan(v) else float(v)) for k, s in enumerate(x) for t, v in enumerate(s)], "k int, t int, x double")
    start = hm.FamilyEmission(["poisson", "gaussian", "gamma"], [{"lam": 4.0}, {"mu": 20.0, "sigma2": 30.0}, {"k": 2.0, "theta": 8.0}])
    emission, _, _, trace = hm.baum_welch(rows, "k", ["t"], "x", start, INIT, MOVES, 6, 16)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:], strict=False))
    assert abs(emission.params[0]["lam"] - 3) < 0.5 and abs(emission.params[1]["mu"] - 23) < 1.5


def test_far_apart_states_do_not_underflow(spark):
    """A long run that one state can hardly emit keeps that state's likelihood: the other is never entered."""
    rows = spark.createDataFrame([(0, t, 0.0) for t in range(600)] + [(0, 600, 500.0)], "k int, t int, x double")
    stay = np.array([[1.0, 0.0], [0.0, 1.0]])
    emission = hm.FamilyEmission(["gaussian", "gaussian"], [{"mu": 0.0, "sigma2": 1.0}, {"mu": 40.0, "sigma2": 1.0}])
    got = hm.forward(rows, "k", ["t"], "x", emission, np.array([0.0, 1.0]), stay, 50).head().ll
    assert np.isclose(got, -0.5 * (600 * 40.0**2 + 460.0**2 + 601 * np.log(2 * np.pi)))


def test_joined_scores_and_odd_tables(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "q"), (2, 0, None), (2, 1, "b")], "k int, t int, s string")
    table = spark.createDataFrame([(s, p) for s, p in SYMBOLS.table.items()], "symbol string, p array<double>")
    got = {r.k: r.ll for r in hm.forward(hm.scores_by_join(rows, "s", table), "k", ["t"], "scores", None, INIT, MOVES).collect()}
    assert got[1] == -np.inf and np.isclose(got[2], np.log(INIT @ MOVES @ SYMBOLS.table["b"]))
    none = rows.where("k > 5")
    assert hm.forward(none, "k", ["t"], "s", SYMBOLS, INIT, MOVES).count() == hm.viterbi(none, "k", ["t"], "s", SYMBOLS, INIT, MOVES).count() == 0


def test_one_sequence_is_cut_over_many_tasks(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("x"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = ck.chunked(rows, "k", ["t"], ["x"], 100)
        assert chunks.select(F.expr("chunk div 4294967296")).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert chunks.agg(F.max("n")).head()[0] == 100 and chunks.agg(F.sum("n")).head()[0] == 40_000
    whole = [x for r in chunks.orderBy("chunk").collect() for x in r.x]
    assert whole == [float(i % 7) for i in range(40_000)]
    before = {r.chunk: r.before for r in ck.sizes_before(chunks).collect()}
    at = 0
    for r in chunks.orderBy("chunk").collect():
        assert before[r.chunk] == at
        at += r.n


def dense(model, n):
    """Means and covariances of all states of n steps laid end to end, and the matrix that sees them."""
    k = model.size
    mean, cov = np.zeros(n * k), np.zeros((n * k, n * k))
    m, p = model.mean, model.spread
    for t in range(n):
        mean[t * k : t * k + k] = m
        cov[t * k : t * k + k, t * k : t * k + k] = p
        for u in range(t):
            c = model.move @ cov[(t - 1) * k : t * k, u * k : u * k + k]
            cov[t * k : t * k + k, u * k : u * k + k] = c
            cov[u * k : u * k + k, t * k : t * k + k] = c.T
        m, p = model.move @ m, model.move @ p @ model.move.T + model.noise
    see = np.zeros((n, n * k))
    for t in range(n):
        see[t, t * k : t * k + k] = model.see
    return mean, cov, see


MODELS = {"level": ss.local_level(0.7, 1.3, 1.0, 2.0), "autoregression": ss.autoregression(0.6, 0.5, 0.9, -1.0, 3.0), "structure": ss.structural(0.3, 0.1, 0.8, [1.0, 0.2], 2.0, season=4, q_season=0.05)}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("most", [512, 3])
def test_filter_and_smoother_equal_dense_algebra(spark, name, most):
    model, rng = MODELS[name], np.random.default_rng(7)
    series = {k: rng.normal(size=n) * 2 for k, n in ((1, 11), (2, 1), (3, 7))}
    series[3][[0, 4, 6]] = np.nan
    rows = spark.createDataFrame([(k, t, None if np.isnan(v) else float(v)) for k, y in series.items() for t, v in enumerate(y)], "k int, t int, v double")
    got = {r.k: r for r in ss.kalman_filter(rows, "k", ["t"], "v", model, most).collect()}
    smooth = {}
    for r in ss.kalman_smoother(rows, "k", ["t"], "v", model, most).orderBy("k", "t").collect():
        smooth.setdefault(r.k, []).append((r.mean, r.spread))
    size = model.size
    for k, y in series.items():
        mean, cov, see = dense(model, len(y))
        on = np.isfinite(y)
        h = see[on]
        s = h @ cov @ h.T + model.error * np.eye(on.sum())
        d = y[on] - h @ mean
        assert np.isclose(got[k].ll, -0.5 * (d @ np.linalg.solve(s, d) + np.linalg.slogdet(s)[1] + on.sum() * np.log(2 * np.pi)))
        gain = np.linalg.solve(s, h @ cov).T
        x, v = mean + gain @ d, cov - gain @ h @ cov
        assert got[k].n == len(y) and np.allclose(got[k].mean, x[-size:])
        for t, (m, p) in enumerate(smooth[k]):
            here = slice(t * size, t * size + size)
            assert np.allclose(m, x[here]) and np.allclose(np.reshape(p, (size, size)), v[here, here])


def test_forecast_goes_on_from_the_last_state(spark):
    model = ss.structural(0.0, 0.0, 1e-6, [0.0, 1.0], 1e3, season=2)
    rows = spark.createDataFrame([(1, t, 3.0 * t + (1.0 if t % 2 else -1.0)) for t in range(20)], "k int, t int, v double")
    got = ss.forecast(ss.kalman_filter(rows, "k", ["t"], "v", model, 6), model, 3).head().forecast
    assert np.allclose(got, [3 * t + (1 if t % 2 else -1) for t in (20, 21, 22)], atol=1e-2)


def test_autoregression_fit_climbs_and_finds_the_model(spark):
    rng, rows = np.random.default_rng(8), []
    for k in range(12):
        x = 0.0
        for t in range(200):
            x = 0.8 * x + rng.normal()
            rows.append((k, t, float(x + 0.5 * rng.normal())))
    df = spark.createDataFrame(rows, "k int, t int, v double").cache()
    start = (0.3, 0.6, 0.0, 1.0)
    phi, q, r, _, trace = ss.fit_autoregression(df, "k", ["t"], "v", steps=12, start=start)
    assert all(b >= a - 1e-7 for a, b in zip(trace, trace[1:], strict=False))
    assert abs(phi - 0.8) < 0.08 and abs(q - 1) < 0.4 and r < 0.8
    cut = ss.fit_autoregression(df, "k", ["t"], "v", steps=2, start=start, most=7)
    assert np.allclose(cut[4], trace[:2])


def double_sum(t, c, model, window, kernel=None):
    kernel = kernel or (lambda u: np.exp(-np.outer(u, model.decays)) @ model.weights)
    rate = [model.mu[c[i]] + sum(model.alpha[c[i], c[j]] * kernel(np.array([t[i] - t[j]]))[0] for j in range(i)) for i in range(len(t))]
    grid = np.linspace(0, 1, 20001)
    paid = sum(model.alpha[:, c[j]].sum() * np.trapezoid(kernel(grid**4 * (window - t[j])), grid**4 * (window - t[j])) for j in range(len(t)))
    return np.log(rate).sum() - model.mu.sum() * window - paid


@pytest.mark.parametrize("most", [512, 3])
def test_hawkes_equals_the_double_sum(spark, most):
    rng = np.random.default_rng(3)
    events = {k: (np.sort(rng.uniform(0, 10, n)), rng.integers(0, 2, n)) for k, n in enumerate((1, 5, 23))}
    rows = spark.createDataFrame([(k, float(x), int(c)) for k, (t, s) in events.items() for x, c in zip(t, s, strict=True)] + [(9, 11.0, 0)], "k int, t double, c int")
    models = [hk.exponential([0.5, 0.8], [[0.4, 0.1], [0.0, 0.3]], 1.5), hk.power_law([0.5, 0.8], [[0.4, 0.1], [0.0, 0.3]], 0.2, 1.6, 10.0)]
    for model, kernel in zip(models, (None, lambda u: (u + 0.2) ** -1.6), strict=True):
        got = {r.k: r.ll for r in hk.loglik(rows, "k", "t", model, 10.0, "c", most).collect()}
        assert got[9] == -np.inf
        for k, (t, c) in events.items():
            assert np.isclose(got[k], double_sum(t, c, model, 10.0, kernel), rtol=1e-6)
    one = {r.k: r.ll for r in hk.loglik(rows, "k", "t", hk.exponential(0.5, 0.4, 1.5), 10.0, None, most).collect()}
    assert all(np.isclose(one[k], double_sum(t, np.zeros(len(t), int), hk.exponential(0.5, 0.4, 1.5), 10.0), rtol=1e-6) for k, (t, _) in events.items())


def test_power_law_terms():
    for c, power in ((0.1, 1.5), (1.0, 3.0)):
        decays, weights, error = hk.power_law_terms(c, power, 50.0)
        t = np.linspace(0, 50, 5000)
        assert error < 1e-8 and np.abs(np.exp(-np.outer(t, decays)) @ weights * (t + c) ** power - 1).max() < 1e-7


def test_hawkes_fits_raise_the_likelihood(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, float(x + d), int(d > 0)) for k in range(6) for x in rng.uniform(0, 18, 12) for d in (0.0, 0.3)], "k int, t double, c int").cache()
    total = lambda model, kind=None: hk.loglik(rows, "k", "t", model, 20.0, kind).selectExpr("sum(ll) AS s").head().s
    assert total(hk.exponential(*hk.fit_by_branching(rows, "k", "t", 20.0, 8))) > total(hk.exponential(0.1, 0.1, 1.0))
    start = hk.exponential([0.3, 0.3], [[0.2, 0.2], [0.2, 0.2]], 2.0)
    model, trace = hk.fit(rows, "k", "t", start, 20.0, 8, "c", 4)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:], strict=False))
    assert total(model, "c") > trace[0] + 10 and model.alpha[1, 0] > 3 * model.alpha[0, 1]
