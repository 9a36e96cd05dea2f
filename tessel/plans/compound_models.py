"""Bags with varying shares, heavy-tailed vectors, partly labelled mixtures and comparisons with ties over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import combinators as cb
from tessel.operators import compound as cm
from tessel.plans.base import query, rounded, table

_BAGS = "b AS (SELECT user_id, event_type AS level, count(*) AS c FROM events GROUP BY 1, 2), s AS (SELECT user_id, sum(c) AS n FROM b GROUP BY 1)"


def _dirichlet_multinomial_sql(steps: int) -> str:
    """The rise of the digamma function over c steps is a sum of c reciprocals."""
    parts = ["a0 AS (SELECT DISTINCT level, 1.0::DOUBLE AS alpha FROM b)", "u AS (SELECT level, unnest(range(c)) AS j FROM b)", "t AS (SELECT unnest(range(CAST(n AS BIGINT))) AS j FROM s)"]
    for i in range(1, steps + 1):
        parts.append(f"d{i} AS (SELECT sum(1 / (j + (SELECT sum(alpha) FROM a{i - 1}))) AS d FROM t), a{i} AS (SELECT level, any_value(alpha) * sum(1 / (j + alpha)) / (SELECT d FROM d{i}) AS alpha FROM u JOIN a{i - 1} USING (level) GROUP BY level)")
    return f"WITH {_BAGS}, " + ", ".join(parts)


def _event_bags(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("level")).agg(F.count("*").alias("c"))


@query("dirichlet_multinomial_fit", _dirichlet_multinomial_sql(3) + " SELECT level, round(alpha, 6) AS alpha FROM a3")
def dirichlet_multinomial_fit(spark, sf_dir):
    return rounded(cm.fit_dirichlet_multinomial(_event_bags(spark, sf_dir), "user_id", "level", "c", 3))


@query("dirichlet_multinomial_score", _dirichlet_multinomial_sql(1) + ", l AS (SELECT user_id, sum(lgamma(c + alpha) - lgamma(alpha) - lgamma(c + 1)) AS l FROM b JOIN a1 USING (level) GROUP BY 1) SELECT user_id, CAST(n AS BIGINT) AS n, round(l + lgamma(n + 1) + lgamma((SELECT sum(alpha) FROM a1)) - lgamma(n + (SELECT sum(alpha) FROM a1)), 5) AS ll FROM l JOIN s USING (user_id)")
def dirichlet_multinomial_score(spark, sf_dir):
    bags = _event_bags(spark, sf_dir)
    alpha = cm.fit_dirichlet_multinomial(bags, "user_id", "level", "c", 1)
    return rounded(cm.score_dirichlet_multinomial(bags, "user_id", "level", "c", alpha), 5)


def _student_sql(steps: int) -> str:
    parts = ["p0 AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM x)"]
    for i in range(1, steps + 1):
        parts.append(f"w{i} AS (SELECT x - mx AS dx, y - my AS dy, mx, my, 7.0 / (5.0 + (c * pow(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * c - b * b)) AS u FROM x, p{i - 1})")
        parts.append(f"p{i} AS (SELECT any_value(mx) + sum(u * dx) / sum(u) AS mx, any_value(my) + sum(u * dy) / sum(u) AS my, (sum(u * dx * dx) - pow(sum(u * dx), 2) / sum(u)) / count(*) AS a, (sum(u * dx * dy) - sum(u * dx) * sum(u * dy) / sum(u)) / count(*) AS b, (sum(u * dy * dy) - pow(sum(u * dy), 2) / sum(u)) / count(*) AS c FROM w{i})")
    return "WITH x AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), " + ", ".join(parts)


@query("multivariate_student_t", _student_sql(3) + " SELECT l_returnflag, round(any_value(mx), 5) AS mx, round(any_value(my), 5) AS my, round(any_value(a), 4) AS a, round(any_value(b), 4) AS b, round(any_value(c), 4) AS c, round(avg(lgamma(3.5) - lgamma(2.5) - ln(5 * pi()) - 0.5 * ln(a * c - b * b) - 3.5 * ln(1 + (c * pow(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * c - b * b) / 5)), 6) AS mean_ll FROM x, p3 GROUP BY 1")
def multivariate_student_t(spark, sf_dir):
    """Quantity and price with five degrees of freedom: location, shape, and the mean log-density by return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    mean, shape = cm.fit_student_t(rows, ["x", "y"], 5.0, 3)
    got = rows.groupBy("l_returnflag").agg(F.avg(cm.student_t_logpdf(["x", "y"], 5.0, mean, shape)).alias("mean_ll"))
    figures = {"mx": mean[0], "my": mean[1], "a": shape[0, 0], "b": shape[0, 1], "c": shape[1, 1]}
    digits = {"mx": 5, "my": 5, "a": 4, "b": 4, "c": 4}
    return got.select("l_returnflag", *[F.lit(round(float(v), digits[k])).alias(k) for k, v in figures.items()], F.round("mean_ll", 6).alias("mean_ll"))


_N = "-0.5 * ln(2 * pi() * {v}) - pow(q - {m}, 2) / (2 * {v})"


@query("semi_supervised_mixture", f"""WITH x AS (SELECT l_quantity AS q, CASE WHEN l_linenumber = 1 THEN 1.0 WHEN l_linenumber = 2 THEN 0.0 WHEN l_linenumber = 3 THEN 0.8 END AS p FROM lineitem),
t AS (SELECT q, p, {_N.format(m=15, v=90)} + CASE WHEN p IS NULL THEN ln(0.4) WHEN p > 0 THEN ln(p) ELSE -1e308 END AS t0, {_N.format(m=35, v=110)} + CASE WHEN p IS NULL THEN ln(0.6) WHEN p < 1 THEN ln(1 - p) ELSE -1e308 END AS t1 FROM x),
z AS (SELECT q, p, greatest(t0, t1) + ln(1 + exp(least(t0, t1) - greatest(t0, t1))) AS z, t0, t1 FROM t), r AS (SELECT q, p, z, exp(t0 - z) AS r0, exp(t1 - z) AS r1 FROM z)
SELECT round(sum(r0) FILTER (p IS NULL) / count(*) FILTER (p IS NULL), 6) AS w, round(sum(r0 * q) / sum(r0), 5) AS m0, round(sum(r0 * q * q) / sum(r0) - pow(sum(r0 * q) / sum(r0), 2), 4) AS v0, round(sum(r1 * q) / sum(r1), 5) AS m1, round(sum(r1 * q * q) / sum(r1) - pow(sum(r1 * q) / sum(r1), 2), 4) AS v1, round(sum(z), 2) AS ll FROM r""")
def semi_supervised_mixture(spark, sf_dir):
    """One step where first and second lines of an order know their component and third ones nearly do."""
    p = F.when(F.col("l_linenumber") == 1, 1.0).when(F.col("l_linenumber") == 2, 0.0).when(F.col("l_linenumber") == 3, 0.8)
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.when(p.isNotNull(), F.array(p, F.when(p == 1.0, 0.0).when(p == 0.0, 1.0).otherwise(1 - p))).alias("prior"))
    start = cb.Mixture([cb.Leaf("gaussian", "l_quantity")], [0.4, 0.6], [{"0_mu": 15.0, "0_sigma2": 90.0}, {"0_mu": 35.0, "0_sigma2": 110.0}])
    model, ll = cm.semi_supervised_step(rows, start, "prior")
    a, b = model.params
    return spark.createDataFrame([(round(model.weights[0], 6), round(a["0_mu"], 5), round(a["0_sigma2"], 4), round(b["0_mu"], 5), round(b["0_sigma2"], 4), round(ll, 2))], "w double, m0 double, v0 double, m1 double, v1 double, ll double")


# Kinds of lines meet within an order; the one with more pieces wins, and they tie within ten pieces.
_MET = "WITH x AS (SELECT l_orderkey AS o, l_returnflag || l_linestatus || CAST(l_linenumber % 3 AS VARCHAR) AS p, sum(l_quantity) AS t FROM lineitem GROUP BY 1, 2), m AS (SELECT a.p AS a, b.p AS b, count(*) FILTER (a.t - b.t > 10) AS won, count(*) FILTER (b.t - a.t > 10) AS lost, count(*) FILTER (abs(a.t - b.t) <= 10) AS tied FROM x a JOIN x b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2), g AS (SELECT a AS i, b AS j, won, lost, tied FROM m UNION ALL SELECT b, a, lost, won, tied FROM m), n0 AS (SELECT 1.0 / (SELECT count(DISTINCT i) FROM g) AS w)"


def _ties_sql(kind: str, steps: int) -> str:
    parts = [f"w0 AS (SELECT DISTINCT i AS item, (SELECT w FROM n0) AS w FROM g), v0 AS (SELECT {'1.0' if kind == 'davidson' else '1.5'}::DOUBLE AS v)"]
    for k in range(1, steps + 1):
        x = f"x{k} AS (SELECT g.*, won + lost + tied AS n, won + tied AS s, lost + tied AS r, p.w AS wi, q.w AS wj, v FROM g JOIN w{k - 1} p ON p.item = i JOIN w{k - 1} q ON q.item = j, v{k - 1})"
        if kind == "davidson":
            u = f"u{k} AS (SELECT i AS item, sum(won + tied / 2.0) / sum(n * (1 + v / 2 * sqrt(wj / wi)) / (wi + wj + v * sqrt(wi * wj))) AS u FROM x{k} GROUP BY 1), v{k} AS (SELECT (SELECT sum(tied) FROM m) / (sum(n * sqrt(wi * wj) / (wi + wj + v * sqrt(wi * wj))) / 2) AS v FROM x{k})"
        else:
            u = f"u{k} AS (SELECT i AS item, sum(s) / sum(s / (wi + v * wj) + v * r / (v * wi + wj)) AS u FROM x{k} GROUP BY 1), c{k} AS (SELECT (SELECT sum(tied) FROM m) / sum(s * wj / (wi + v * wj)) AS c FROM x{k}), v{k} AS (SELECT c + sqrt(1 + c * c) AS v FROM c{k})"
        parts += [x, u, f"w{k} AS (SELECT item, u / (SELECT sum(u) FROM u{k}) AS w FROM u{k})"]
    return _MET + ", " + ", ".join(parts) + f" SELECT item, round(w, 6) AS w, round(v, 6) AS tie FROM w{steps}, v{steps}"


def _met(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.expr("concat(l_returnflag, l_linestatus, CAST(l_linenumber % 3 AS STRING))").alias("p")).agg(F.sum("l_quantity").alias("t"))
    met = x.join(x.select("o", F.col("p").alias("q"), F.col("t").alias("u")), "o").where("p < q")
    gap = F.col("t") - F.col("u")
    return cm.comparisons(met.withColumn("outcome", F.when(gap > 10, 1).when(gap < -10, -1).otherwise(0)), "p", "q", "outcome")


def _ties(kind: str):
    @query(kind, _ties_sql(kind, 3))
    def run(spark, sf_dir):
        w, tie = cm.fit_with_ties(_met(spark, sf_dir), kind, 3)
        return rounded(w.withColumn("tie", F.lit(tie)))


_ties("davidson")
_ties("rao_kupper")
