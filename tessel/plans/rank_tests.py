"""Rank tests and p-value adjustment over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import tests as t
from tessel.plans.base import query, rounded, table

_RANKED = "WITH x AS (SELECT {g} AS g, {v} AS x FROM {t} {w}), r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY x) AS t FROM x)"


@query(
    "mann_whitney",
    _RANKED.format(g="o_orderstatus", v="round(o_totalprice / 100)", t="orders", w="WHERE o_orderstatus IN ('F', 'O')")
    + """, s AS (SELECT sum(CASE WHEN g = 'F' THEN rk END) AS r1, count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2, sum(t * t - 1.0) AS ties FROM r),
u AS (SELECT n1, n2, ties, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 + n2 AS n FROM s),
d AS (SELECT n1, n2, u1, u1 - n1 * n2 / 2.0 AS d, sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1.0)))) AS sd FROM u)
SELECT n1, n2, round(u1, 6) AS u1, round((d - 0.5 * sign(d)) / sd, 6) AS z, round(2 * u1 / (n1 * n2) - 1, 6) AS cliffs_delta FROM d""",
)
def mann_whitney(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.round(F.col("o_totalprice") / 100).alias("v"))
    return rounded(t.mann_whitney_u(rows, "o_orderstatus", "v", "F", "O").drop("p"))


@query("mann_whitney_p")
def mann_whitney_p(spark, sf_dir):
    return rounded(t.mann_whitney_u(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "F", "O"))


@query(
    "kruskal_wallis",
    _RANKED.format(g="o_orderpriority", v="round(o_totalprice / 100)", t="orders", w="")
    + """, p AS (SELECT g, sum(rk) AS r, count(*) AS n FROM r GROUP BY g), q AS (SELECT sum(r * r / n) AS s, sum(n) AS n, count(*) AS k FROM p), ti AS (SELECT sum(t * t - 1.0) AS ties FROM r),
h AS (SELECT k, CAST(n AS BIGINT) AS n, (12.0 / (n * (n + 1.0)) * s - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h FROM q, ti)
SELECT k, n, round(h, 6) AS h, round((h - k + 1) / (n - k), 6) AS epsilon2 FROM h""",
)
def kruskal_wallis(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.round(F.col("o_totalprice") / 100).alias("v"))
    return rounded(t.kruskal_wallis(rows, "o_orderpriority", "v"))


@query("ks_2samp", """WITH x AS (SELECT l_extendedprice AS x, l_returnflag AS g FROM lineitem WHERE l_returnflag IN ('A', 'R')), n AS (SELECT count(*) FILTER (g = 'A') AS n1, count(*) FILTER (g = 'R') AS n2 FROM x),
c AS (SELECT x, count(*) FILTER (g = 'A') AS c1, count(*) FILTER (g = 'R') AS c2 FROM x GROUP BY x), e AS (SELECT sum(c1) OVER (ORDER BY x) AS a, sum(c2) OVER (ORDER BY x) AS b FROM c)
SELECT round(max(abs(a / n1 - b / n2)), 6) AS d, n1, n2 FROM e, n GROUP BY n1, n2""")
def ks_2samp(spark, sf_dir):
    return rounded(t.ks_2samp(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R"))


@query("mood_median", """WITH m AS (SELECT median(o_totalprice) AS m FROM orders), p AS (SELECT o_orderpriority AS g, count(*) FILTER (o_totalprice > m) AS above, count(*) FILTER (o_totalprice <= m) AS below FROM orders, m GROUP BY 1), a AS (SELECT sum(above) AS ta, sum(below) AS tb FROM p),
c AS (SELECT above, below, (above + below) * ta / (ta + tb) AS ea, (above + below) * tb / (ta + tb) AS eb FROM p, a)
SELECT count(*) AS k, CAST(sum(above) AS BIGINT) AS above, CAST(sum(below) AS BIGINT) AS below, round(sum(pow(above - ea, 2) / ea + pow(below - eb, 2) / eb), 6) AS chi2 FROM c""")
def mood_median(spark, sf_dir):
    return rounded(t.mood_median(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


@query("wilcoxon", """WITH x AS (SELECT abs(l_quantity - 25) AS a, l_quantity > 25 AS up FROM lineitem WHERE l_quantity <> 25), r AS (SELECT up, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY a) AS t FROM x),
s AS (SELECT count(*) AS n, sum(CASE WHEN up THEN rk ELSE 0 END) AS p, sum(CASE WHEN up THEN 0 ELSE rk END) AS m, sum(t * t - 1.0) AS ties FROM r)
SELECT n, round(CAST(least(p, m) AS DOUBLE), 6) AS t, round((least(p, m) - n * (n + 1.0) / 4) / sqrt((n * (n + 1.0) * (2 * n + 1) - 0.5 * ties) / 24), 6) AS z FROM s""")
def wilcoxon(spark, sf_dir):
    return rounded(t.wilcoxon(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("d")), "d"))


@query("friedman", """WITH x AS (SELECT l_suppkey AS b, l_returnflag AS g, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT g, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY b, x) AS t FROM x),
p AS (SELECT g, sum(rk) AS r, count(*) AS n FROM r GROUP BY g), s AS (SELECT sum(r * r) AS s, max(n) AS n, count(*) AS k FROM p), ti AS (SELECT sum(t * t - 1.0) AS ties FROM r)
SELECT n, k, round((12.0 / (n * k * (k + 1)) * s - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1.0))), 6) AS chi2 FROM s, ti""")
def friedman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return rounded(t.friedman(rows, "l_suppkey", "l_returnflag", "v"))


@query("runs_test", """WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id), r AS (SELECT e.user_id, value > m AS up, lag(value > m) OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS was FROM events e JOIN m USING (user_id) WHERE value <> m),
s AS (SELECT user_id, sum(CASE WHEN was IS NULL OR was <> up THEN 1 ELSE 0 END) AS runs, count(*) FILTER (up) AS n1, count(*) FILTER (NOT up) AS n2 FROM r GROUP BY user_id),
q AS (SELECT *, 2.0 * n1 * n2 / (n1 + n2) + 1 AS mu, 2.0 * n1 * n2 * (2.0 * n1 * n2 - n1 - n2) / (pow(n1 + n2, 2) * (n1 + n2 - 1)) AS v FROM s)
SELECT user_id, n1, n2, CAST(runs AS BIGINT) AS runs, round(mu, 6) AS expected, round(CASE WHEN v > 0 THEN (runs - mu) / sqrt(v) ELSE 0 END, 6) AS z FROM q""")
def runs_test(spark, sf_dir):
    return rounded(t.runs_test(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", "user_id"))


@query("jonckheere", """WITH x AS (SELECT o_orderpriority AS g, round(o_totalprice / 5000) AS x, count(*) AS c FROM orders GROUP BY 1, 2), n AS (SELECT g, sum(c) AS n FROM x GROUP BY g)
SELECT round((SELECT CAST(sum(a.c * b.c * CASE WHEN b.x > a.x THEN 1.0 WHEN b.x = a.x THEN 0.5 ELSE 0 END) AS DOUBLE) FROM x a JOIN x b ON a.g < b.g), 6) AS j, round((SELECT (pow(sum(n), 2) - sum(n * n)) / 4.0 FROM n), 6) AS expected""")
def jonckheere(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.round(F.col("o_totalprice") / 5000).alias("v"))
    return rounded(t.jonckheere(rows, "o_orderpriority", "v"))


_P = "SELECT s_suppkey AS id, (s_suppkey * 37 % 101) / 2020.0 + 0.0001 * s_suppkey + 0.001 AS p FROM supplier"


@query("adjusted_p_values", f"""WITH x AS ({_P}), r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m, (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) + 1 FROM supplier)) t(i)) AS h FROM x)
SELECT id, round(p, 6) AS p, round(least(1, m * p), 6) AS bonferroni, round(least(1, max((m - k + 1) * p) OVER (ORDER BY p, id)), 6) AS holm, round(least(1, min((m - k + 1) * p) OVER (ORDER BY p DESC, id DESC)), 6) AS hochberg,
round(least(1, min(m * p / k) OVER (ORDER BY p DESC, id DESC)), 6) AS bh, round(least(1, min(h * m * p / k) OVER (ORDER BY p DESC, id DESC)), 6) AS "by" FROM r""")
def adjusted_p_values(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.expr("(s_suppkey * 37 % 101) / 2020D + 0.0001D * s_suppkey + 0.001D")).alias("p"))
    return rounded(t.adjust_p(rows, "id", "p"))


@query("fisher_combine", f"WITH x AS ({_P}) SELECT id % 4 AS part, round(-2 * sum(ln(p)), 6) AS statistic, 2 * count(*) AS df, round(1 - pow(1 - min(p), count(*)), 6) AS tippett FROM x GROUP BY 1")
def fisher_combine(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey % 4").alias("part"), (F.expr("(s_suppkey * 37 % 101) / 2020D + 0.0001D * s_suppkey + 0.001D")).alias("p"))
    return rounded(t.fisher_combine(rows, "p", ["part"]))
