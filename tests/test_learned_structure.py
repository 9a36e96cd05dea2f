"""Forests against brute force, Dirichlet-process mixtures against numpy, principal components against dense algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions.special import digamma
from tessel.operators import dirichlet_process as dp
from tessel.operators import forest as fo
from tessel.operators import subspace as su


def entropy(y):
    _, n = np.unique(y, return_counts=True)
    return float(-(n / n.sum() * np.log(n / n.sum())).sum()) if len(y) else 0.0


def best(x, y):
    """(gain, feature, bin) of the best split by hand."""
    out = (0.0, None, None)
    for f in range(x.shape[1]):
        for b in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= b
            gain = entropy(y) - left.mean() * entropy(y[left]) - (~left).mean() * entropy(y[~left])
            if gain > out[0] + 1e-12:
                out = (gain, f, int(b))
    return out


def test_entropy_split_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x, g = rng.integers(0, 6, (300, 3)), rng.integers(0, 3, 300)
    y = np.where(x[:, 1] > 2 + g, "p", "q")
    y[rng.random(300) < 0.2] = "r"
    df = spark.createDataFrame([(int(k), *map(int, r), str(c)) for k, r, c in zip(g, x, y, strict=True)] + [(0, None, 1, 1, "p"), (1, 1, 1, 1, None), (9, 1, 1, 1, "p")], "g int, a int, b int, c int, y string")
    got = {r.g: r for r in fo.entropy_split(df.where("a IS NOT NULL OR g = 9"), [F.col("a"), F.col("b"), F.col("c")], "y", ["g"]).collect()}
    assert set(got) == {0, 1, 2}
    for k in range(3):
        gain, f, b = best(x[g == k], y[g == k])
        assert (got[k].feature, got[k].bin) == (f, b) and np.isclose(got[k].gain, gain)


def test_one_tree_equals_brute_force_and_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, 3)).round(2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), f"c{v}") for i, (r, v) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, c double, y string").repartition(3)
    tree = fo.fit(df, "k", ["a", "b", "c"], "y", trees=1, depth=3, bins=16, bagged=False)
    bins = np.stack([(x[:, [i]] > np.array(tree.edges[i])).sum(axis=1) for i in range(3)], axis=1)

    def check(node, rows, depth):
        gain, f, b = best(bins[rows], y[rows]) if depth < 3 else (0, None, None)
        if gain <= 1e-6:
            assert np.allclose(tree.leaves[0][node], [(y[rows] == c).mean() for c in (0, 1)])
            return
        assert tree.splits[0][node] == (f, b)
        left = bins[:, f] <= b
        check(2 * node, rows & left, depth + 1)
        check(2 * node + 1, rows & ~left, depth + 1)

    check(1, np.ones(800, bool), 0)
    forest = fo.fit(df, "k", ["a", "b", "c"], "y", trees=8, depth=5, per_node=2)
    again = fo.fit(df.repartition(5), "k", ["a", "b", "c"], "y", trees=8, depth=5, per_node=2)
    assert forest.splits == again.splits and len({tuple(sorted(s.items())) for s in forest.splits}) > 1
    said = fo.predict(df, forest).select("y", "shares").collect()
    assert np.mean([forest.classes[int(np.argmax(r.shares))] == r.y for r in said]) > 0.9
    assert all(np.isclose(sum(r.shares), 1) for r in said)
    empty = fo.fit(df.where("k < 0"), "k", ["a"], "y", trees=2, depth=2)
    assert empty.classes == []


def test_poisson_weights():
    w = fo.poisson_weights(np.random.default_rng(0).integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


LEAVES = [dp.NormalGamma("x", (0.0, 0.2, 2.0, 3.0)), dp.GammaRate("n", (1.5, 0.5)), dp.DirichletLevels("c", ("p", "q", "r"), 0.7), dp.GammaRate("e", (2.0, 1.0), poisson=False)]


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(5)
    z = rng.integers(0, 2, 300)
    rows = [(float(rng.normal(6 * k, 1)), int(rng.poisson(2 + 8 * k)), "pqr"[int(rng.integers(0, 3)) if rng.random() < 0.3 else int(k)], float(rng.exponential(1 + k))) for k in z]
    rows += [(None, 3, "p", 1.0), (1.0, None, None, None)]
    return rows, spark.createDataFrame(rows, "x double, n int, c string, e double").cache()


def begin():
    seen = [[{"s1": 10.0 * m, "s2": 10.0 * (m * m + 2)}, {"s1": 40.0}, {"l0": 4.0, "l1": 3.0, "l2": 3.0}, {"s1": 10.0}] for m in (0.0, 3.0, 6.0)]
    return dp.start(LEAVES, 1.3, seen, [10.0] * 3)


def test_update_equals_numpy_row_by_row(records):
    rows, df = records
    model = begin()
    counts, sums, z = np.zeros(3), [[0.0] * 8 for _ in range(3)], 0.0
    for x, n, c, e in rows:
        terms = []
        for log, (qx, qn, qc, qe) in zip(model.expected_weights(), model.posteriors, strict=True):
            t = log
            if x is not None:
                m, k, a, b = qx
                t += 0.5 * (digamma(a) - math.log(b) - math.log(2 * math.pi)) - 0.5 * (1 / k + a / b * (x - m) ** 2)
            if n is not None:
                t += n * (digamma(qn[0]) - math.log(qn[1])) - qn[0] / qn[1] - math.lgamma(n + 1)
            if c is not None:
                t += digamma(qc["pqr".index(c)]) - digamma(sum(qc))
            if e is not None:
                t += digamma(qe[0]) - math.log(qe[1]) - e * qe[0] / qe[1]
            terms.append(t)
        top = max(terms)
        lse = top + math.log(sum(math.exp(t - top) for t in terms))
        z += lse
        for i, t in enumerate(terms):
            r = math.exp(t - lse)
            counts[i] += r
            for j, v in enumerate((x is not None, x or 0, (x or 0) ** 2, n is not None, n or 0, c is not None, e is not None, e or 0)):
                sums[i][j] += r * v
    new, bound = dp.step(df, model)
    assert np.isclose(bound, z - model.divergence(), atol=1e-6)
    for i in range(3):
        nx, s1, s2, nn, sn, _, ne, se = sums[i]
        assert np.allclose(new.posteriors[i][0], LEAVES[0].update(nx, {"s1": s1, "s2": s2})) and np.allclose(new.posteriors[i][1], (1.5 + sn, 0.5 + nn)) and np.allclose(new.posteriors[i][3], (2 + ne, 1 + se))
    assert np.allclose(new.sticks, [(1 + counts[0], 1.3 + counts[1] + counts[2]), (1 + counts[1], 1.3 + counts[2])])


def test_bound_rises_and_classes_are_found(records):
    model, trace = dp.fit(records[1], begin(), 25)
    assert all(b >= a - 1e-7 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] > trace[0] + 10
    assert np.isclose(sum(model.weights()), 1) and sorted(model.weights())[-2] > 0.3
    got = dp.classify(records[1], model).where("x IS NOT NULL AND n IS NOT NULL").groupBy("component").agg(F.avg("x").alias("m"), F.count("*").alias("n")).where("n > 60").collect()
    assert sorted(round(r.m / 6) for r in got) == [0, 1]


def test_divergences_by_numbers():
    """Of a posterior from its prior, against integrals on a grid."""
    t = np.linspace(1e-5, 60, 400_000)
    gamma = lambda a, b: a * np.log(b) - math.lgamma(a) + (a - 1) * np.log(t) - b * t
    p, q = gamma(1.5, 0.5), gamma(4.0, 1.2)
    assert abs(np.trapezoid(np.exp(q) * (q - p), t) - LEAVES[1].divergence((4.0, 1.2))) < 1e-4
    assert abs(LEAVES[0].divergence(LEAVES[0].prior)) < 1e-12 and LEAVES[0].divergence((1.0, 2.0, 3.0, 1.0)) > 0
    assert abs(LEAVES[2].divergence((0.7, 0.7, 0.7))) < 1e-12 and LEAVES[2].divergence((3.0, 1.0, 1.0)) > 0


def test_principal_components_equal_dense_algebra(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 6)) * [5, 3, 2, 0.5, 0.5, 0.5] @ np.linalg.qr(rng.standard_normal((6, 6)))[0] + 7
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(-1, None), (-2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (-3, [float("nan")] * 6), (-4, [1.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(3)
    model = su.fit(df, "v", 2, extra=1)
    cov = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert model.n == 400 and np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.values, values[:2]) and np.isclose(model.noise, values[2:].mean())
    assert np.allclose(np.abs(model.axes.T @ axes[:, :2]), np.eye(2), atol=1e-6)
    c = axes[:, :2] @ np.diag(values[:2] - model.noise) @ axes[:, :2].T + model.noise * np.eye(6)
    got = {r.i: r.ll for r in su.sound(df, "v").select("i", su.logpdf(model, F.col("_v")).alias("ll")).collect()}
    for i in range(0, 400, 37):
        d = x[i] - x.mean(axis=0)
        assert np.isclose(got[i], -0.5 * (6 * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + d @ np.linalg.solve(c, d)))


def test_weights_are_written_once_and_histograms_equal_counts(spark, monkeypatch):
    """A level counts each row with its bag's weight, in the open nodes only; no level works the weights out again."""
    rows = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 7).cast("int").alias("b0"), (F.xxhash64("id") % 5 + 4).cast("int").alias("b1"))
    values = [F.col(b).cast("double").alias(x) for b, x in (("b0", "x0"), ("b1", "x1"))]
    table = fo._coded(rows.select("y", F.xxhash64(F.lit(0), "id").alias("h0"), F.xxhash64(F.lit(1), "id").alias("h1"), *values), 2, [[v + 0.5 for v in range(8)]] * 2)
    assert table.columns == ["y", "w0", "w1", "b0", "b1"]
    got = {(r.tree, r.node, r.feature, r.bin): (r.c0, r.c1, r.c2) for r in fo._histogram(table, [{1: (0, 3), 2: (1, 4)}, {}], {(0, 3), (0, 5), (1, 1)}, 2, 9, 3, True).collect()}
    want = {}
    for r in rows.withColumns({"h0": F.xxhash64(F.lit(0), "id"), "h1": F.xxhash64(F.lit(1), "id")}).collect():
        for tree, node in ((0, 3 if r.b0 > 3 else 5 if r.b1 > 4 else 4), (1, 1)):
            w = int(fo.poisson_weights(np.array([r[f"h{tree}"]]))[0])
            if w and node != 4:
                for feature, b in enumerate((r.b0, r.b1)):
                    want.setdefault((tree, node, feature, b), [0, 0, 0])[r.y] += w
    assert got == {k: tuple(v) for k, v in want.items()}


def test_bins_count_the_edges_below(spark):
    nan, inf = float("nan"), float("inf")
    values = spark.createDataFrame([(v,) for v in (None, -inf, -0.0, 0.0, 1.0, 1.5, 2.0, inf, nan)], "x double")
    got = fo._bins(np.array([r[0] for r in values.select(fo._value(F.col("x"))).collect()]), [0.0, 1.0, 2.0])
    assert got.tolist() == [0, 0, 0, 0, 1, 2, 2, 3, 3]
    want = values.select(sum((F.coalesce(F.col("x") > e, F.lit(False)).cast("int") for e in (0.0, 1.0, 2.0)), F.lit(0))).collect()
    assert got.tolist() == [r[0] for r in want]
