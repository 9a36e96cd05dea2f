"""Models of the dependence of columns: a Chow-Liu tree of order lines, pair copulas and vines of users' events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import tree_models as tm
from tessel.operators import vines as vn
from tessel.plans.base import query, rounded, table

_COLUMNS = ["flag", "status", "line", "discount"]
_CELLS = "x AS (SELECT l_orderkey, l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS VARCHAR) AS line, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS discount FROM lineitem)"
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


def _mi_sql() -> str:
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM x" for a, b in _PAIRS]
    return f"WITH {_CELLS}, l AS ({' UNION ALL '.join(parts)}), j AS (SELECT a, b, x, y, count(*) AS k FROM l GROUP BY 1, 2, 3, 4), m AS (SELECT *, sum(k) OVER (PARTITION BY a, b) AS n, sum(k) OVER (PARTITION BY a, b, x) AS kx, sum(k) OVER (PARTITION BY a, b, y) AS ky FROM j), w AS (SELECT a, b, sum(k * ln(k::DOUBLE * n / (kx::DOUBLE * ky))) / any_value(n) AS mi FROM m GROUP BY 1, 2)"


# Of four columns three different edges that touch all of them are a tree.
_TREE = _mi_sql() + """, c AS (SELECT p.a || p.b AS e1, q.a || q.b AS e2, r.a || r.b AS e3, p.mi + q.mi + r.mi AS total FROM w p, w q, w r WHERE p.a || p.b < q.a || q.b AND q.a || q.b < r.a || r.b AND len(list_distinct([p.a, p.b, q.a, q.b, r.a, r.b])) = 4),
best AS (SELECT unnest([e1, e2, e3]) AS e FROM (SELECT * FROM c ORDER BY total DESC LIMIT 1)), t AS (SELECT w.* FROM w JOIN best ON e = a || b)"""


def _lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("line"), F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("discount"))


@query("chow_liu_tree", _TREE + " SELECT a, b, round(mi, 8) AS mi FROM t")
def chow_liu_tree(spark, sf_dir):
    tree, weights = tm.fit(_lines(spark, sf_dir), _COLUMNS)
    edges = {frozenset((c, p)) for c, p in tree.parent.items() if p}
    return rounded(spark.createDataFrame([(a, b, float(w)) for a, b, w in weights if frozenset((a, b)) in edges], "a string, b string, mi double"), 8)


_LEVEL = "CASE {c} WHEN 'flag' THEN flag WHEN 'status' THEN status WHEN 'line' THEN line ELSE discount END"


@query("chow_liu_score", _TREE + f""", one AS (SELECT c, v, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY c) AS p FROM ({' UNION ALL '.join(f"SELECT '{c}' AS c, {c} AS v FROM x" for c in _COLUMNS)}) GROUP BY 1, 2),
g AS (SELECT flag, status, line, discount, count(*) AS rows FROM x GROUP BY 1, 2, 3, 4),
s AS (SELECT flag, status, line, discount, rows, (SELECT sum(ln(p)) FROM one WHERE (c = 'flag' AND v = flag) OR (c = 'status' AND v = status) OR (c = 'line' AND v = line) OR (c = 'discount' AND v = discount)) AS l FROM g),
e AS (SELECT s.flag, s.status, s.line, s.discount, sum(ln(m.k::DOUBLE * m.n / (m.kx::DOUBLE * m.ky))) AS l FROM s, t, m WHERE m.a = t.a AND m.b = t.b AND m.x = {_LEVEL.format(c='t.a')} AND m.y = {_LEVEL.format(c='t.b')} GROUP BY 1, 2, 3, 4)
SELECT flag, status, line, discount, rows, round(s.l + e.l, 6) AS ll FROM s JOIN e USING (flag, status, line, discount)""")
def chow_liu_score(spark, sf_dir):
    """The log-density of every combination of levels there is."""
    rows = _lines(spark, sf_dir)
    tree, _ = tm.fit(rows, _COLUMNS)
    cells = rows.groupBy(*_COLUMNS).agg(F.count("*").alias("rows"))
    return rounded(tm.score_complete(cells, tree).select(*_COLUMNS, "rows", "ll"))


@query("chow_liu_missing", f"""WITH {_CELLS}, h AS (SELECT status, line, count(*) AS k FROM x GROUP BY 1, 2) SELECT status, round(ln(sum(k) * 1.0 / (SELECT count(*) FROM x)), 6) AS ll FROM h GROUP BY 1""")
def chow_liu_missing(spark, sf_dir):
    """Rows that hold a status alone: all other columns are summed out, which leaves the status's own share."""
    rows = _lines(spark, sf_dir)
    tree, _ = tm.fit(rows, _COLUMNS)
    held = rows.select("status").distinct().select(F.lit(None).cast("string").alias("flag"), "status", F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("discount"))
    return rounded(tm.score(held.withColumn("key", F.col("status")), tree, "key").select(F.col("key").alias("status"), "ll"))


_USERS = "u AS (SELECT user_id, avg(value) AS mean, max(value) AS most, count(*) * 1.0 AS n FROM events GROUP BY 1)"


def _users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.count("*").cast("double").alias("n"))


def _tau_sql(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / sqrt(sum(abs(sign(p.{a} - q.{a})))::DOUBLE * sum(abs(sign(p.{b} - q.{b})))) AS tau FROM u p JOIN u q ON p.user_id < q.user_id"


@query("archimedean_fits", f"WITH {_USERS}, t AS ({' UNION ALL '.join(_tau_sql(a, b) for a, b in (('mean', 'most'), ('mean', 'n'), ('most', 'n')))}) SELECT a, b, round(tau, 6) AS tau, CASE WHEN tau > 0 THEN round(2 * tau / (1 - tau), 6) END AS clayton, CASE WHEN tau > 0 THEN round(1 / (1 - tau), 6) END AS gumbel, round(sin(pi() * tau / 2), 6) AS gaussian FROM t")
def archimedean_fits(spark, sf_dir):
    """Copula parameters by inverting Kendall's tau; null where a family can't have it."""
    users, rows = _users(spark, sf_dir), []
    for a, b in (("mean", "most"), ("mean", "n"), ("most", "n")):
        tau = vn.kendall.counts(users, a, b).head().tau_b
        p = vn.parameters(tau)
        rows.append((a, b, float(tau), p.get("clayton"), p.get("gumbel"), p["gaussian"]))
    return rounded(spark.createDataFrame(rows, "a string, b string, tau double, clayton double, gumbel double, gaussian double"))


@query("vine_fit")
def vine_fit(spark, sf_dir):
    """The edges of a canonical, a drawable and a regular vine on users' figures, with the mean log-density of each vine."""
    users, columns, rows = _users(spark, sf_dir), ["mean", "most", "n"], []
    scored = vn.uniform_scores(users.select(*columns), columns)
    for kind in ("star", "path", "tree"):
        vine = vn.fit(users, columns, kind)
        ll = vn.score(scored, vine).agg(F.avg("ll")).head()[0]
        rows += [(kind, k + 1, e.a, e.b, ",".join(e.given), e.family, float(e.theta), float(e.tau), float(ll)) for k, tree in enumerate(vine.trees) for e in tree]
    return rounded(spark.createDataFrame(rows, "kind string, tree int, a string, b string, given string, family string, theta double, tau double, mean_ll double"), 5)
