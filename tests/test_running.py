"""Running aggregates, ranks and quantiles over many distinct values and many ranges, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import evaluation, regression, survival
from tessel.operators import tests as t
from tessel.operators.running import quantiles, running

N = 400_000


@pytest.fixture(scope="module")
def many(spark):
    """Distinct values in mixed order with wide rows over 16 partitions; x is key * 7919 modulo a prime."""
    rows = spark.range(N, numPartitions=16).select("id", (F.pmod(F.col("id") * 7919, F.lit(1_000_003))).cast("double").alias("x"), F.repeat(F.lit("w"), 40).alias("wide"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield rows.withColumn("g", F.when(F.col("id") % 2 == 0, "a").otherwise("b")).withColumn("y", (F.col("x") > 500_000).cast("int"))
    spark.conf.set("spark.sql.shuffle.partitions", old)


def values():
    ids = np.arange(N)
    return ids, (ids * 7919 % 1_000_003).astype(float)


def test_folds_number_every_row_once(many):
    got = regression.kfold(many, ["x"], 7).select("id", "fold").toPandas().sort_values("id")
    _, x = values()
    rank = np.argsort(np.argsort(x))
    edges = np.cumsum([N // 7 + (i < N % 7) for i in range(7)])
    assert (got.fold.to_numpy() == np.searchsorted(edges, rank, side="right")).all()
    got = regression.stratified_kfold(many, "g", ["x"], 5).select("id", "g", "fold").toPandas().sort_values("id")
    for g, own in got.groupby("g"):
        ranks = np.argsort(np.argsort(x[own.id.to_numpy()]))
        assert (own.fold.to_numpy() == ranks % 5).all(), g


def test_rank_statistics_equal_numpy(many):
    ids, x = values()
    a, b = np.sort(x[ids % 2 == 0]), np.sort(x[ids % 2 == 1])
    both = np.sort(x)
    want = np.abs(np.searchsorted(a, both, side="right") / len(a) - np.searchsorted(b, both, side="right") / len(b)).max()
    assert t.ks_2samp(many, "g", "x", "a", "b").first().d == pytest.approx(want, abs=1e-12)
    assert evaluation.roc_auc(many, "x", "y").first().auc == pytest.approx(1.0, abs=1e-12)
    rank = np.argsort(np.argsort(x)) + 1.0
    u = rank[ids % 2 == 0].sum() - len(a) * (len(a) + 1) / 2
    assert t.mann_whitney_u(many, "g", "x", "a", "b").first().u1 == u
    assert t.jonckheere(many, "g", "x").first().j == len(a) * len(b) - u
    d = x - 300_000.5
    ranks = np.argsort(np.argsort(np.abs(d), kind="stable")) + 1.0
    order = np.abs(d)
    _, inverse, count = np.unique(order, return_inverse=True, return_counts=True)
    mid = (np.cumsum(count) - (count - 1) / 2)[inverse]
    assert ranks.sum() == mid.sum()
    got = t.wilcoxon(many.select((F.col("x") - 300_000.5).alias("d")), "d").first()
    assert (got.n, got.t) == (N, min(mid[d > 0].sum(), mid[d < 0].sum()))


def test_quantiles_and_conformal_equal_numpy(many, spark):
    _, x = values()
    got = quantiles(many, "x", [0.0, 0.1, 0.5, 0.77, 1.0]).first()
    assert got.n == N and got.q == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.77, 1.0]).tolist(), rel=1e-12)
    k = int(np.ceil((N + 1) * 0.9))
    assert evaluation.conformal_quantile(many, "x", 0.1).first()["quantile"] == np.sort(x)[k - 1]
    assert quantiles(many.where("false"), "x", [0.5]).first().q == [None]
    few = spark.createDataFrame([(1.0,), (2.0,)], "s double")
    assert evaluation.conformal_quantile(few, "s", 0.1).first()["quantile"] == float("inf")


def test_adjusted_p_equal_numpy(spark):
    n = 3000
    p = (np.arange(n) * 7919 % 3001 + 1) / 3002.0
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(n, None)], "id long, p double").repartition(16)
    got = t.adjust_p(rows, "id", "p").toPandas().set_index("id").sort_index()
    order = np.argsort(p)
    ranked, k = p[order], np.arange(1, n + 1)
    back = lambda v: np.minimum(1, v)[np.argsort(order)]
    low = lambda v: np.minimum.accumulate(v[::-1])[::-1]
    h = (1 / k).sum()
    want = {"bonferroni": n * ranked, "holm": np.maximum.accumulate((n - k + 1) * ranked), "hochberg": low((n - k + 1) * ranked), "bh": low(n / k * ranked), "by": low(h * n / k * ranked)}
    for name, v in want.items():
        assert np.allclose(got[name].to_numpy()[:n], back(v), rtol=1e-12), name
    assert got.loc[n].isna().all()


def test_kaplan_meier_equals_numpy(spark):
    n = 5000
    time, event = (np.arange(n) * 37 % 4999).astype(float), np.arange(n) % 3 > 0
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(time, event, strict=True)], "t double, e int").repartition(8)
    got = survival.kaplan_meier(rows, "t", "e").toPandas().sort_values("t")
    at = np.unique(time[event])
    risk = np.array([(time >= v).sum() for v in at])
    dead = np.array([((time == v) & event).sum() for v in at])
    assert got.t.to_numpy().tolist() == at.tolist() and (got.at_risk.to_numpy() == risk).all()
    assert np.allclose(got.survival.to_numpy(), np.cumprod(1 - dead / risk), rtol=1e-9, atol=1e-15)


def test_running_within_groups_both_ways(spark):
    rows = spark.createDataFrame([(k % 3 if k % 5 else None, float(k * 31 % 97), k) for k in range(97)], "g int, x double, v long").repartition(5)
    up = running(rows, ["x"], {"s": ("sum", F.col("v"), False), "m": ("max", F.col("v"), True), "n": ("min", F.col("v"), False)}, ["g"]).collect()
    down = {r.v: r.s for r in running(rows, ["x"], {"s": ("sum", F.col("v"), True)}, ["g"], descending=True).collect()}
    assert len(up) == 97
    for r in up:
        before = [q.v for q in up if q.g == r.g and q.x < r.x]
        after = [q.v for q in up if q.g == r.g and q.x >= r.x]
        assert (r.s, r.m, r.n, down[r.v]) == (sum(before), max([*before, r.v]), min(before, default=None), sum(after))
