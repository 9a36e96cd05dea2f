"""Survival curves, calibration, scoring rules, conformal sets and drift over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import evaluation as ev
from tessel.operators import survival as sv
from tessel.plans.base import query, rounded, table

_T = "SELECT l_returnflag AS g, l_quantity AS t, CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS e, CASE WHEN l_discount > 0.06 THEN 2 WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS cause FROM lineitem"
_KM = f"WITH x AS ({_T}), c AS (SELECT g, t, sum(e) AS d, count(*) AS n FROM x GROUP BY g, t), r AS (SELECT g, t, d, sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS y FROM c)"


def _times(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS g", "l_quantity AS t", "CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS e", "CASE WHEN l_discount > 0.06 THEN 2 WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS cause")


@query("kaplan_meier", _KM + "SELECT g, t, CAST(y AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS d, round(product(1 - d / y) OVER w, 6) AS survival, round(product(1 - d / y) OVER w * sqrt(sum(CASE WHEN y = d THEN 0 ELSE d / (y * (y - d)) END) OVER w), 6) AS se FROM r WHERE d > 0 WINDOW w AS (PARTITION BY g ORDER BY t)")
def kaplan_meier(spark, sf_dir):
    return rounded(sv.kaplan_meier(_times(spark, sf_dir), "t", "e", ["g"]))


@query("median_survival", _KM + ", s AS (SELECT g, t, product(1 - d / y) OVER (PARTITION BY g ORDER BY t) AS s FROM r WHERE d > 0) SELECT g, min(t) FILTER (s <= 0.5) AS median FROM s GROUP BY g")
def median_survival(spark, sf_dir):
    return sv.median_survival(sv.kaplan_meier(_times(spark, sf_dir), "t", "e", ["g"]), ["g"])


@query("nelson_aalen", _KM + "SELECT g, t, CAST(y AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS d, round(sum(d / y) OVER w, 6) AS hazard, round(sqrt(sum(d / (y * y)) OVER w), 6) AS se FROM r WHERE d > 0 WINDOW w AS (PARTITION BY g ORDER BY t)")
def nelson_aalen(spark, sf_dir):
    return rounded(sv.nelson_aalen(_times(spark, sf_dir), "t", "e", ["g"]))


@query("aalen_johansen", _KM + ", s AS (SELECT g, t, y, coalesce(product(1 - d / y) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS s FROM r WHERE d > 0), k AS (SELECT g, t, cause, count(*) AS k FROM x WHERE cause <> 0 GROUP BY ALL) SELECT k.g, cause, k.t, round(sum(s * k / y) OVER (PARTITION BY k.g, cause ORDER BY k.t), 6) AS incidence FROM k JOIN s ON s.g = k.g AND s.t = k.t")
def aalen_johansen(spark, sf_dir):
    return rounded(sv.aalen_johansen(_times(spark, sf_dir), "t", "cause", ["g"]))


@query("log_rank", f"WITH x AS ({_T}), c AS (SELECT t, sum(e) AS d, count(*) AS n, sum(CASE WHEN g = 'A' THEN e ELSE 0 END) AS d1, count(*) FILTER (g = 'A') AS n1 FROM x GROUP BY t), r AS (SELECT t, d, d1, sum(n) OVER w AS y, sum(n1) OVER w AS y1 FROM c WINDOW w AS (ORDER BY t DESC)), s AS (SELECT sum(d1) AS o, sum(d * y1 / y) AS e, sum(d * y1 / y * (1 - y1 / y) * (y - d) / (y - 1)) AS v FROM r WHERE d > 0) SELECT CAST(o AS BIGINT) AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round(pow(o - e, 2) / v, 6) AS chi2 FROM s")
def log_rank(spark, sf_dir):
    return rounded(sv.log_rank(_times(spark, sf_dir), "t", "e", "g", "A"))


@query("person_period", f"WITH x AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) AS INTEGER) AS p, CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS e FROM lineitem), y AS (SELECT unnest(range(0, p + 1)) AS period, p, e FROM x) SELECT CAST(period AS INTEGER) AS period, count(*) AS n, CAST(sum(CASE WHEN period = p THEN e ELSE 0 END) AS BIGINT) AS events FROM y GROUP BY period")
def person_period(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS t", "CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS e")
    return sv.person_period(rows, "t", "e", ["l_orderkey", "l_linenumber"], 10).groupBy("period").agg(F.count("*").alias("n"), F.sum("event").alias("events"))


_F = "SELECT l_quantity / 51 AS p, CASE WHEN (l_orderkey * 7 + l_linenumber * 3) % 50 < l_quantity THEN 1 ELSE 0 END AS y FROM lineitem"


def _forecasts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_quantity / 51 AS p", "CASE WHEN (l_orderkey * 7 + l_linenumber * 3) % 50 < l_quantity THEN 1 ELSE 0 END AS y", "l_returnflag AS g")


_BIN = f"WITH x AS ({_F}), r AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM x GROUP BY 1)"


@query("reliability", _BIN + "SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM r")
def reliability(spark, sf_dir):
    return rounded(ev.reliability(_forecasts(spark, sf_dir), "p", "y"))


@query("calibration_error", _BIN + "SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece, round(sqrt(sum(n * pow(mean_p - mean_y, 2)) / sum(n)), 6) AS ece2, round(max(abs(mean_p - mean_y)), 6) AS mce FROM r")
def calibration_error(spark, sf_dir):
    return rounded(ev.calibration_error(_forecasts(spark, sf_dir), "p", "y"))


@query("brier_decomposition", _BIN + ", b AS (SELECT avg(y) AS b FROM x), d AS (SELECT sum(n * pow(mean_p - mean_y, 2)) / sum(n) AS rel, sum(n * pow(mean_y - b, 2)) / sum(n) AS res, max(b * (1 - b)) AS unc FROM r, b) SELECT round(rel, 6) AS reliability, round(res, 6) AS resolution, round(unc, 6) AS uncertainty, round(rel - res + unc, 6) AS brier FROM d")
def brier_decomposition(spark, sf_dir):
    return rounded(ev.brier_decomposition(_forecasts(spark, sf_dir), "p", "y"))


@query("scoring_rules", f"WITH x AS ({_F}) SELECT round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_score, round(avg(greatest(0.9 * (y - p), -0.1 * (y - p))), 6) AS pinball, round(avg(0.4 + 20 * (greatest(p - 0.2 - y, 0) + greatest(y - p - 0.2, 0))), 6) AS interval_score FROM x")
def scoring_rules(spark, sf_dir):
    p, y = F.col("p"), F.col("y")
    return rounded(_forecasts(spark, sf_dir).agg(F.avg(ev.brier(p, y)).alias("brier"), F.avg(ev.log_score(p, y)).alias("log_score"), F.avg(ev.pinball(y, p, 0.9)).alias("pinball"), F.avg(ev.interval_score(p - 0.2, p + 0.2, y, 0.1)).alias("interval_score")))


@query("crps_ensemble", "WITH e AS (SELECT o_orderkey, o_totalprice AS y, [o_totalprice * 0.9, o_totalprice * 1.2, 100000.0 + o_custkey, 150000.0] AS m FROM orders), p AS (SELECT o_orderkey, y, unnest(m) AS x FROM e), a AS (SELECT o_orderkey, avg(abs(x - y)) AS a FROM p GROUP BY o_orderkey), b AS (SELECT q.o_orderkey, sum(abs(q.x - r.x)) / 32 AS b FROM p q JOIN p r USING (o_orderkey) GROUP BY q.o_orderkey) SELECT round(avg(a - b), 4) AS crps FROM a JOIN b USING (o_orderkey)")
def crps_ensemble(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_totalprice AS y", "array(o_totalprice * 0.9D, o_totalprice * 1.2D, 100000D + o_custkey, 150000D) AS m")
    return rows.agg(F.round(F.avg(ev.crps_ensemble(F.col("m"), F.col("y"))), 4).alias("crps"))


@query("roc_auc", f"WITH x AS ({_F}), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM x) SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def roc_auc(spark, sf_dir):
    return rounded(ev.roc_auc(_forecasts(spark, sf_dir), "p", "y"))


_S = "SELECT o_orderpriority AS g, abs(o_totalprice - 150000) AS s, 1 + o_custkey % 5 AS w FROM orders"


def _residuals(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS g", "abs(o_totalprice - 150000) AS s", "1 + o_custkey % 5 AS w")


@query("split_conformal", f"WITH x AS ({_S}), r AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM x) SELECT n, round(max(s) FILTER (k = ceil((n + 1) * 0.9)), 6) AS quantile FROM r GROUP BY n")
def split_conformal(spark, sf_dir):
    return rounded(ev.conformal_quantile(_residuals(spark, sf_dir), "s", 0.1))


@query("mondrian_conformal", f"WITH x AS ({_S}), r AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s) AS k, count(*) OVER (PARTITION BY g) AS n FROM x) SELECT g, n, round(max(s) FILTER (k = ceil((n + 1) * 0.9)), 6) AS quantile FROM r GROUP BY g, n")
def mondrian_conformal(spark, sf_dir):
    return rounded(ev.conformal_quantile(_residuals(spark, sf_dir), "s", 0.1, ["g"]))


@query("weighted_conformal", f"WITH x AS ({_S}), p AS (SELECT s, sum(w) AS w FROM x GROUP BY s), c AS (SELECT s, sum(w) OVER (ORDER BY s) / (SELECT sum(w) + 1 FROM p) AS c FROM p) SELECT round(min(s) FILTER (c >= 0.9), 6) AS quantile FROM c")
def weighted_conformal(spark, sf_dir):
    return rounded(ev.weighted_conformal(_residuals(spark, sf_dir), "s", "w", 0.1))


@query("pit_histogram", f"WITH x AS ({_F}) SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM x GROUP BY 1")
def pit_histogram(spark, sf_dir):
    return ev.pit_histogram(_forecasts(spark, sf_dir), F.col("p"))


_D = "SELECT o_totalprice AS x, year(o_orderdate) < 1998 AS r FROM orders"


@query("psi", f"WITH x AS ({_D}), q AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM x WHERE r), b AS (SELECT r, (x >= q[1])::INT + (x >= q[2])::INT + (x >= q[3])::INT + (x >= q[4])::INT + (x >= q[5])::INT + (x >= q[6])::INT + (x >= q[7])::INT + (x >= q[8])::INT + (x >= q[9])::INT AS bin FROM x, q), c AS (SELECT bin, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM b GROUP BY bin), p AS (SELECT a / sum(a) OVER () + 1e-6 AS r, b / sum(b) OVER () + 1e-6 AS c FROM c) SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM p")
def psi(spark, sf_dir):
    return rounded(ev.psi(table(spark, sf_dir, "orders"), "o_totalprice", F.year("o_orderdate") < 1998))


@query("js_divergence", f"WITH x AS ({_D}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x), b AS (SELECT r, least(floor((x - lo) / (hi - lo) * 20), 19) AS bin FROM x, e), c AS (SELECT bin, count(*) FILTER (r) + 1e-12 AS a, count(*) FILTER (NOT r) + 1e-12 AS b FROM b GROUP BY bin), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c) SELECT round(0.5 * sum(p * log2(p / ((p + q) / 2))) + 0.5 * sum(q * log2(q / ((p + q) / 2))), 6) AS js_bits FROM p")
def js_divergence(spark, sf_dir):
    return rounded(ev.js_divergence(table(spark, sf_dir, "orders"), "o_totalprice", F.year("o_orderdate") < 1998))
