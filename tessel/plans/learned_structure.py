"""Splits, forests, Dirichlet-process mixtures and principal components over the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessel.functions.special import digamma
from tessel.operators import dirichlet_process as dp
from tessel.operators import forest as fo
from tessel.operators import subspace as su
from tessel.plans.base import query, rounded, table

_H = "(CASE WHEN {0} > 0 THEN -{0} * ln({0} / {1}) ELSE 0 END)"


def _gain(a: str, f: str, r: str) -> str:
    return " + ".join(_H.format(c, f"({a} + {f} + {r})") for c in (a, f, r))


@query("entropy_split", f"""WITH x AS (SELECT l_linestatus, l_returnflag AS y, unnest([0, 1, 2]) AS feature, unnest([CAST(floor(l_quantity / 5) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(l_linenumber AS BIGINT)]) AS bin FROM lineitem),
c AS (SELECT l_linestatus, feature, bin, count(*) FILTER (y = 'A') AS a, count(*) FILTER (y = 'N') AS f, count(*) FILTER (y = 'R') AS r FROM x GROUP BY 1, 2, 3),
w AS (SELECT l_linestatus, feature, bin, CAST(sum(a) OVER u AS DOUBLE) AS la, CAST(sum(f) OVER u AS DOUBLE) AS lf, CAST(sum(r) OVER u AS DOUBLE) AS lr, CAST(sum(a) OVER v AS DOUBLE) AS ta, CAST(sum(f) OVER v AS DOUBLE) AS tf, CAST(sum(r) OVER v AS DOUBLE) AS tr FROM c WINDOW u AS (PARTITION BY l_linestatus, feature ORDER BY bin), v AS (PARTITION BY l_linestatus, feature)),
g AS (SELECT l_linestatus, feature, bin, ta + tf + tr AS n, ({_gain('ta', 'tf', 'tr')} - ({_gain('la', 'lf', 'lr')}) - ({_gain('(ta - la)', '(tf - lf)', '(tr - lr)')})) / (ta + tf + tr) AS gain FROM w WHERE la + lf + lr > 0 AND la + lf + lr < ta + tf + tr)
SELECT l_linestatus, CAST(feature AS INTEGER) AS feature, bin, round(gain, 8) AS gain, n FROM g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY gain DESC, feature, bin) = 1""")
def entropy_split(spark, sf_dir):
    """The split of quantity, discount or line number that tells most about the return flag, per status."""
    features = [F.floor(F.col("l_quantity") / 5), F.round(F.col("l_discount") * 100), F.col("l_linenumber")]
    return rounded(fo.entropy_split(table(spark, sf_dir, "lineitem"), features, "l_returnflag", ["l_linestatus"]), 8)


@query("random_forest")
def random_forest(spark, sf_dir):
    """A forest for the status of an order line: lines by what it says and what is so."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", "l_extendedprice", "l_discount", F.unix_date(F.col("l_shipdate").cast("date")).alias("day"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    forest = fo.fit(rows, "key", ["l_quantity", "l_extendedprice", "l_discount", "day"], "l_linestatus", trees=5, depth=4, per_node=3)
    said = fo.predict(rows, forest)
    best = F.element_at(F.array(*[F.lit(c) for c in forest.classes]), F.array_position("shares", F.array_max("shares")).cast("int"))
    return said.groupBy("l_linestatus", best.alias("said")).agg(F.count("*").alias("lines"))


# Two components at first: as if one had seen small quantities, the other large ones.
_LEAVES = [dp.NormalGamma("l_quantity", (25.0, 0.1, 1.0, 100.0)), dp.DirichletLevels("l_linestatus", ("F", "O"))]


def _dp_start() -> dp.Mixture:
    seen = [[{"s1": 100.0 * m, "s2": 100.0 * (m * m + 50)}, {"l0": 50.0, "l1": 50.0}] for m in (10.0, 30.0, 45.0)]
    return dp.start(_LEAVES, 1.0, seen, [100.0, 100.0, 100.0])


def _dp_sql() -> str:
    """One update: expected log-densities with the start's constants, then the sums of all components."""
    model, terms = _dp_start(), []
    for log, ((m, k, a, b), levels) in zip(model.expected_weights(), model.posteriors, strict=True):
        constant = log + 0.5 * (digamma(a) - math.log(b) - math.log(2 * math.pi) - 1 / k)
        f, o = (digamma(v) - digamma(sum(levels)) for v in levels)
        terms.append(f"{constant!r} - {a / (2 * b)!r} * pow(l_quantity - {m!r}, 2) + CASE l_linestatus WHEN 'F' THEN {f!r} ELSE {o!r} END")
    return f"""WITH t AS (SELECT l_quantity AS q, l_linestatus AS s, {', '.join(f'{t} AS t{i}' for i, t in enumerate(terms))} FROM lineitem), z AS (SELECT *, greatest(t0, t1, t2) + ln(exp(t0 - greatest(t0, t1, t2)) + exp(t1 - greatest(t0, t1, t2)) + exp(t2 - greatest(t0, t1, t2))) AS z FROM t),
r AS (SELECT q, s, unnest([0, 1, 2]) AS component, unnest([exp(t0 - z), exp(t1 - z), exp(t2 - z)]) AS r FROM z)
SELECT CAST(component AS INTEGER) AS component, round(sum(r), 4) AS n, round((2.5 + sum(r * q)) / (0.1 + sum(r)), 6) AS mean, round(1 + sum(r) / 2, 4) AS shape, round(1 + sum(r) FILTER (s = 'F'), 4) AS f FROM r GROUP BY 1"""


@query("dirichlet_process_step", _dp_sql())
def dirichlet_process_step(spark, sf_dir):
    """The posteriors of three components after one update."""
    model, _ = dp.step(table(spark, sf_dir, "lineitem"), _dp_start())
    rows = [(i, q[2] * 2 - 2, q[0], q[2], levels[0]) for i, (q, levels) in enumerate(model.posteriors)]
    return rounded(rounded(spark.createDataFrame(rows, "component int, n double, mean double, shape double, f double")).withColumns({c: F.round(c, 4) for c in ("n", "shape", "f")}))


@query("dirichlet_process_fit")
def dirichlet_process_fit(spark, sf_dir):
    """Ten updates: the bounds, and the components' expected weights."""
    model, trace = dp.fit(table(spark, sf_dir, "lineitem"), _dp_start(), 10)
    rows = [("bound", i, float(v)) for i, v in enumerate(trace)] + [("weight", i, float(w)) for i, w in enumerate(model.weights())]
    return rounded(spark.createDataFrame(rows, "name string, i int, v double"), 4)


@query("probabilistic_pca")
def probabilistic_pca(spark, sf_dir):
    """Four components of the embeddings: mean log-density by label, and the model's variances."""
    rows = su.sound(table(spark, sf_dir, "embeddings"), "embedding")
    model = su.fit(rows, "embedding", 4, rounds=40)
    got = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg(su.logpdf(model, F.col("_v"))).alias("mean_ll"))
    return rounded(got.withColumns({"noise": F.lit(model.noise), "largest": F.lit(float(model.values[0]))}), 4)
