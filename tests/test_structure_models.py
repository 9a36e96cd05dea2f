"""Chow-Liu trees against enumeration, Kendall counts against all pairs, vines against their densities."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import kendall
from tessel.operators import tree_models as tm
from tessel.operators import vines as vn

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    """A chain a - b - c with d hanging on b, each a noisy copy."""
    rng, out = np.random.default_rng(1), []
    for k in range(600):
        b = int(rng.integers(0, 3))
        noisy = lambda v, p: v if rng.random() > p else int(rng.integers(0, 3))
        out.append((k, f"a{noisy(b, 0.3)}", b, f"c{noisy(b, 0.2)}", f"d{noisy(b, 0.5) % 2}"))
    return out, spark.createDataFrame(out, "k int, a string, b int, c string, d string")


def joint(rows, tree):
    """The model's probability of every combination of levels, from the rows by hand."""
    levels = [sorted({str(r[i + 1]) for r in rows}) for i in range(4)]
    at = {c: i + 1 for i, c in enumerate(COLUMNS)}
    count = lambda **held: sum(all(str(r[at[c]]) == v for c, v in held.items()) for r in rows)
    out = {}
    for combo in product(*levels):
        held = dict(zip(COLUMNS, combo, strict=True))
        p = 1.0
        for c in tree.order:
            up = tree.parent[c]
            p *= count(**{c: held[c]}) / len(rows) if up is None else count(**{c: held[c], up: held[up]}) / count(**{up: held[up]})
        out[combo] = p
    return out


def test_tree_scores_and_missing_values_equal_enumeration(spark, rows):
    plain, df = rows
    tree, weights = tm.fit(df, COLUMNS)
    assert {frozenset((c, p)) for c, p in tree.parent.items() if p} == {frozenset("ab"), frozenset("bc"), frozenset("bd")}
    table = joint(plain, tree)
    assert np.isclose(sum(table.values()), 1)
    asked = [(0, "a0", 1, "c1", "d0"), (1, None, 1, None, "d1"), (2, None, None, None, None), (3, "a2", None, "c0", None), (4, "a9", 1, None, "d0"), (5, None, None, "c2", "d1")]
    got = {r.k: r.ll for r in tm.score(spark.createDataFrame(asked, "k int, a string, b int, c string, d string"), tree, "k").collect()}
    for k, *held in asked:
        p = sum(v for combo, v in table.items() if all(h is None or str(h) == c for h, c in zip(held, combo, strict=True)))
        assert np.isclose(got[k], np.log(p)) if p > 0 else got[k] == -np.inf
    rooted, _ = tm.fit(df, COLUMNS, root="c")
    post = {}
    for r in tm.posterior(spark.createDataFrame(asked[:4], "k int, a string, b int, c string, d string"), COLUMNS, tree, rooted, "k").collect():
        post.setdefault(r.k, {})[r.level] = r.p
    for k, *held in asked[:4]:
        held[2] = None
        fits = {level: sum(v for combo, v in table.items() if combo[2] == level and all(h is None or str(h) == c for h, c in zip(held, combo, strict=True))) for level in ("c0", "c1", "c2")}
        assert all(np.isclose(post[k][level], p / sum(fits.values())) for level, p in fits.items())


def test_tree_pseudo_counts_and_nulls(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "p"), ("y", None)], "a string, b string")
    tree, _ = tm.fit(df, ["a", "b"], pseudo=1.0)
    got = {(r.child, r.parent_level, r.level): r.p for r in tree.table.collect()}
    assert np.isclose(got["a", None, "x"], 2.5 / 5) and np.isclose(got["b", "y", "p"], 1.5 / 2) and np.isclose(got["b", "x", "q"], 1.5 / 3)


def by_hand(x, y):
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    upper = np.triu(np.ones((len(x), len(x)), bool), 1)
    s = sx * sy
    return int((s > 0)[upper].sum()), int((s < 0)[upper].sum()), int(((sx == 0) & (sy != 0))[upper].sum()), int(((sx != 0) & (sy == 0))[upper].sum())


@pytest.mark.parametrize("ranges", [None, 1, 3, 7])
def test_kendall_counts_equal_all_pairs(spark, ranges):
    rng = np.random.default_rng(ranges or 0)
    for x, y in ((rng.normal(size=300), rng.normal(size=300)), (rng.integers(0, 6, 400), rng.integers(0, 5, 400)), (np.zeros(50), rng.normal(size=50)), (np.repeat([1, 2], 100), np.arange(200) % 7)):
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0)], "x double, y double")
        r = kendall.counts(df, "x", "y", ranges).head()
        c, d, tx, ty = by_hand(np.asarray(x, float), np.asarray(y, float))
        assert (r.concordant, r.discordant, r.ties_x, r.ties_y) == (c, d, tx, ty)
        assert r.tau_b is None if not (c + d + tx) or not (c + d + ty) else np.isclose(r.tau_b, (c - d) / np.sqrt((c + d + tx) * (c + d + ty)))


def test_inversions_of_a_long_column():
    rng = np.random.default_rng(0)
    y = rng.permutation(200_000)
    tree, total = np.zeros(200_001, np.int64), 0
    for k, v in enumerate(y.tolist()):
        i, seen = v + 1, 0
        while i:
            seen += tree[i]
            i &= i - 1
        total += k - seen
        i = v + 1
        while i <= 200_000:
            tree[i] += 1
            i += i & -i
    assert kendall.inversions(y, np.ones(200_000, int)) == total
    assert kendall.inversions(np.array([3, 1, 1, 0]), np.array([10**10, 10**10, 2, 5])) == 10**20 + 2 * 10**10 + 5 * (2 * 10**10 + 2)
    empty = kendall.inversions(np.array([]), np.array([]))
    assert empty == 0


def test_kendall_of_an_empty_table(spark):
    r = kendall.counts(spark.createDataFrame([], "x double, y double"), "x", "y").head()
    assert (r.concordant, r.discordant, r.tau_b) == (0, 0, None)


@pytest.mark.parametrize("family,theta", [("gaussian", 0.6), ("clayton", 1.7), ("frank", -4.0), ("frank", 3.0), ("gumbel", 1.8)])
def test_h_functions_are_integrals_of_the_density(spark, family, theta):
    n, points = 4000, [(0.2, 0.3), (0.7, 0.4), (0.9, 0.95)]
    grid = spark.createDataFrame([(i, float(u * (k + 0.5) / n), v, u) for i, (u, v) in enumerate(points) for k in range(n)], "i int, t double, v double, u double")
    area = grid.groupBy("i").agg((F.avg(F.exp(vn.LOGPDF[family](F.col("t"), F.col("v"), theta))) * F.first("u")).alias("area"), F.first(vn.conditional(family, F.col("u"), F.col("v"), theta)).alias("h"))
    for r in area.collect():
        assert abs(r.area - r.h) < 2e-3


def test_parameters_invert_tau():
    found = vn.parameters(0.4)
    assert np.isclose(found["clayton"] / (found["clayton"] + 2), 0.4) and np.isclose(1 - 1 / found["gumbel"], 0.4) and np.isclose(2 / np.pi * np.arcsin(found["gaussian"]), 0.4)
    assert np.isclose(1 - 4 * (1 - vn.debye(found["frank"])) / found["frank"], 0.4) and set(vn.parameters(-0.3)) == {"gaussian", "frank"}
    assert np.isclose(found["frank"], 4.161, atol=1e-2)


def test_vines_of_normal_columns_have_the_normal_density(spark):
    """On a Gaussian chain every vine of Gaussian pairs comes near the Gaussian copula; scores of the vine are chained as fitted."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=1500)
    y = 0.8 * x + 0.6 * rng.normal(size=1500)
    z = 0.7 * y + np.sqrt(0.51) * rng.normal(size=1500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z, strict=True)], "x double, y double, z double")
    scored = vn.uniform_scores(df, ["x", "y", "z"]).cache()
    r = np.corrcoef([x, y, z])
    want = -0.5 * np.log(np.linalg.det(r))
    for kind in ("star", "path", "tree"):
        vine = vn.fit(df, ["x", "y", "z"], kind, ("gaussian",))
        assert [len(t) for t in vine.trees] == [2, 1] and {frozenset((e.a, e.b)) for e in vine.trees[0]} == {frozenset("xy"), frozenset("yz")}
        assert vine.trees[1][0].given == ("y",) and abs(vine.trees[1][0].tau) < 0.08
        assert abs(vn.score(scored, vine).agg(F.avg("ll")).head()[0] - want) < 0.05
    pair = vn.fit_pair(scored, "u_x", "u_y")
    assert max(pair["families"], key=lambda f: pair["families"][f][1]) == "gaussian" and abs(pair["families"]["gaussian"][0] - 0.8) < 0.05
