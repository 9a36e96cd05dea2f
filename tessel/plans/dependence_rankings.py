"""Rankings, paired comparisons, copulas, compositions, directions, bags, graphs and censored models over the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessel.operators import multivariate as mv
from tessel.operators import rankings as rk
from tessel.operators import survival_regression as sr
from tessel.plans.analytics import sums_in_order
from tessel.plans.base import query, rounded, table

# Voters are the customers that ordered with every priority; a ranking is the order of what they spent.
_RANKED = "WITH s AS (SELECT o_custkey AS v, o_orderpriority AS item, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2), f AS (SELECT v FROM s GROUP BY v HAVING count(*) = 5), r AS (SELECT v, item, row_number() OVER (PARTITION BY v ORDER BY t DESC, item) AS pos FROM s JOIN f USING (v))"


def _rankings(spark, sf_dir):
    from pyspark.sql import Window

    spent = sums_in_order(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey").toDF("v", "item", "t")
    full = spent.groupBy("v").agg(F.count("*").alias("k")).where("k = 5").select("v")
    return spent.join(full, "v").select("v", "item", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("t"), "item")).alias("pos"))


@query("precedence_counts", _RANKED + " SELECT x.item AS a, y.item AS b, count(*) AS n FROM r x JOIN r y ON x.v = y.v AND x.pos < y.pos GROUP BY 1, 2")
def precedence_counts(spark, sf_dir):
    return rk.precedence(_rankings(spark, sf_dir), "v", "item", "pos")


@query("mallows_centre", _RANKED + """, p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM r x JOIN r y ON x.v = y.v AND x.pos < y.pos GROUP BY 1, 2), z AS (SELECT item, sum(s) AS score FROM (SELECT a AS item, n AS s FROM p UNION ALL SELECT b, -n FROM p) GROUP BY item),
c AS (SELECT item, score, row_number() OVER (ORDER BY score DESC, item) AS place FROM z) SELECT item, CAST(score AS BIGINT) AS score, CAST(place AS INTEGER) AS place, round((SELECT sum(n) FROM p JOIN c x ON x.item = p.a JOIN c y ON y.item = p.b WHERE x.place > y.place) * 1.0 / (SELECT count(DISTINCT v) FROM r), 6) AS mean_distance FROM c""")
def mallows_centre(spark, sf_dir):
    return rounded(rk.mallows_centre(_rankings(spark, sf_dir), "v", "item", "pos"))


@query("mallows_score", _RANKED + """, p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM r x JOIN r y ON x.v = y.v AND x.pos < y.pos GROUP BY 1, 2), z AS (SELECT item, sum(s) AS score FROM (SELECT a AS item, n AS s FROM p UNION ALL SELECT b, -n FROM p) GROUP BY item),
c AS (SELECT item, row_number() OVER (ORDER BY score DESC, item) AS place FROM z), q AS (SELECT v, pos, place FROM r JOIN c USING (item)), d AS (SELECT x.v, count(*) FILTER (x.place > y.place) AS distance FROM q x LEFT JOIN q y ON x.v = y.v AND x.pos < y.pos GROUP BY x.v)
SELECT distance, count(*) AS voters, round(-0.3 * distance - (SELECT sum(ln((1 - exp(-j * 0.3)) / (1 - exp(-0.3)))) FROM range(1, 6) t(j)), 6) AS ll FROM d GROUP BY distance""")
def mallows_score(spark, sf_dir):
    rows = _rankings(spark, sf_dir)
    scored = rk.mallows_score(rows, rk.mallows_centre(rows, "v", "item", "pos"), "v", "item", "pos", 0.3, 5)
    return scored.groupBy("distance", F.round("ll", 6).alias("ll")).agg(F.count("*").alias("voters"))


def _plackett_luce_sql(steps: int) -> str:
    parts = ["w0 AS (SELECT DISTINCT item, 0.2::DOUBLE AS w FROM r)"]
    for i in range(1, steps + 1):
        parts.append(f"d{i} AS (SELECT v, item, pos, sum(w) OVER (PARTITION BY v ORDER BY pos DESC) AS d FROM r JOIN w{i - 1} USING (item))")
        parts.append(f"s{i} AS (SELECT item, pos, sum(CASE WHEN pos = 5 THEN 0 ELSE 1 / d END) OVER (PARTITION BY v ORDER BY pos) AS part FROM d{i})")
        parts.append(f"u{i} AS (SELECT item, count(*) FILTER (pos < 5) / sum(part) AS u FROM s{i} GROUP BY item)")
        parts.append(f"w{i} AS (SELECT item, u / (SELECT sum(u) FROM u{i}) AS w FROM u{i})")
    return _RANKED + ", " + ", ".join(parts) + f" SELECT item, round(w, 6) AS w FROM w{steps}"


@query("plackett_luce", _plackett_luce_sql(4))
def plackett_luce(spark, sf_dir):
    return rounded(rk.plackett_luce(_rankings(spark, sf_dir), "v", "item", "pos", 4))


@query("plackett_luce_score", _RANKED + ", w AS (SELECT item, length(item) / 10.0 AS w FROM (SELECT DISTINCT item FROM r)), d AS (SELECT v, w, sum(w) OVER (PARTITION BY v ORDER BY pos DESC) AS d FROM r JOIN w USING (item)), z AS (SELECT v, sum(ln(w / d)) AS ll FROM d GROUP BY v) SELECT count(*) AS voters, round(avg(ll), 6) AS mean_ll, round(min(ll), 6) AS least_ll FROM z")
def plackett_luce_score(spark, sf_dir):
    rows = _rankings(spark, sf_dir)
    worths = rows.select("item").distinct().select("item", (F.length("item") / 10.0).alias("w"))
    return rounded(rk.plackett_luce_score(rows, worths, "v", "item", "pos").agg(F.count("*").alias("voters"), F.avg("ll").alias("mean_ll"), F.min("ll").alias("least_ll")))


_WINS = "WITH x AS (SELECT l_orderkey AS o, l_returnflag || l_linestatus || CAST(l_linenumber % 3 AS VARCHAR) AS p, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1, 2), g AS (SELECT a.p AS a, b.p AS b, count(*) AS n FROM x a JOIN x b ON a.o = b.o AND a.t > b.t AND a.p <> b.p GROUP BY 1, 2)"


def _wins(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.expr("concat(l_returnflag, l_linestatus, CAST(l_linenumber % 3 AS STRING))").alias("p")).agg(F.sum("l_extendedprice").alias("t"))
    met = x.select("o", F.col("p").alias("winner"), "t").join(x.select("o", F.col("p").alias("loser"), F.col("t").alias("u")), "o").where("t > u AND winner <> loser")
    return rk.paired_counts(met, "winner", "loser")


def _bradley_terry_sql(steps: int) -> str:
    parts = ["m AS (SELECT a, b, sum(n) AS n, sum(won) AS won FROM (SELECT a, b, n, n AS won FROM g UNION ALL SELECT b, a, n, 0 FROM g) GROUP BY 1, 2)", "w0 AS (SELECT DISTINCT a AS item, 1.0 / (SELECT count(DISTINCT a) FROM m) AS w FROM m)"]
    for i in range(1, steps + 1):
        parts.append(f"u{i} AS (SELECT m.a AS item, sum(won) / sum(n / (x.w + y.w)) AS u FROM m JOIN w{i - 1} x ON x.item = m.a JOIN w{i - 1} y ON y.item = m.b GROUP BY 1)")
        parts.append(f"w{i} AS (SELECT item, u / (SELECT sum(u) FROM u{i}) AS w FROM u{i})")
    return _WINS + ", " + ", ".join(parts) + f" SELECT item, round(w, 6) AS w FROM w{steps}"


@query("bradley_terry", _bradley_terry_sql(4))
def bradley_terry(spark, sf_dir):
    return rounded(rk.bradley_terry(_wins(spark, sf_dir), 4))


def _probit_sql(p: str) -> str:
    def poly(c, x):
        out = repr(c[0])
        for v in c[1:]:
            out = f"({out} * {x} + {v!r})"
        return out

    tail = lambda q: f"{poly(mv._PROBIT_C, f'sqrt(-2 * ln({q}))')} / {poly(mv._PROBIT_D, f'sqrt(-2 * ln({q}))')}"
    q = f"({p} - 0.5)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 1 - 0.02425 THEN -({tail(f'(1 - {p})')}) ELSE {poly(mv._PROBIT_A, f'({q} * {q})')} * {q} / {poly(mv._PROBIT_B, f'({q} * {q})')} END"


_U = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / (count(*) OVER () + 1)"


@query("gaussian_copula", f"WITH u AS (SELECT {_U.format(c='l_quantity')} AS a, {_U.format(c='l_extendedprice')} AS b, {_U.format(c='l_discount')} AS c FROM lineitem), z AS (SELECT {_probit_sql('a')} AS a, {_probit_sql('b')} AS b, {_probit_sql('c')} AS c FROM u) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(a, b), 6) AS rho FROM z UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(a, c), 6) FROM z UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(b, c), 6) FROM z")
def gaussian_copula(spark, sf_dir):
    return rounded(mv.gaussian_copula(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"]))


_UV = "WITH x AS (SELECT l_returnflag, l_quantity / 51 AS u, (l_linenumber * 50 + l_quantity) / 401 AS v FROM lineitem)"


@query("copula_scores", _UV + " SELECT l_returnflag, round(avg(ln(3.0) - 3 * (ln(u) + ln(v)) - 2.5 * ln(pow(u, -2) + pow(v, -2) - 1)), 6) AS clayton, round(avg(ln(4 * (1 - exp(-4.0))) - 4 * (u + v) - 2 * ln(1 - exp(-4.0) - (1 - exp(-4 * u)) * (1 - exp(-4 * v)))), 6) AS frank, round(avg(-sqrt(pow(ln(u), 2) + pow(ln(v), 2)) - ln(u) - ln(v) + ln(-ln(u)) + ln(-ln(v)) - 1.5 * ln(pow(ln(u), 2) + pow(ln(v), 2)) + ln(sqrt(pow(ln(u), 2) + pow(ln(v), 2)) + 1)), 6) AS gumbel FROM x GROUP BY 1")
def copula_scores(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 51).alias("u"), ((F.col("l_linenumber") * 50 + F.col("l_quantity")) / 401).alias("v"))
    return rounded(rows.groupBy("l_returnflag").agg(F.avg(mv.clayton_logpdf(u, v, 2.0)).alias("clayton"), F.avg(mv.frank_logpdf(u, v, 4.0)).alias("frank"), F.avg(mv.gumbel_logpdf(u, v, 2.0)).alias("gumbel")))


@query("composition_normal", "WITH x AS (SELECT l_returnflag, sqrt(0.5) * (ln(l_quantity) - ln(l_extendedprice)) AS a, sqrt(2.0 / 3) * ((ln(l_quantity) + ln(l_extendedprice)) / 2 - ln(1 + l_tax)) AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(a), 5) AS m_0, round(avg(b), 5) AS m_1, round(var_pop(a), 5) AS v_0_0, round(covar_pop(a, b), 5) AS v_0_1, round(var_pop(b), 5) AS v_1_1 FROM x GROUP BY 1")
def composition_normal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a, b = mv.log_ratios([F.col("l_quantity"), F.col("l_extendedprice"), 1 + F.col("l_tax")])
    return rounded(mv.covariance(rows.select("l_returnflag", a.alias("a"), b.alias("b")), ["a", "b"], ["l_returnflag"]), 5)


@query("fit_multinomial", "WITH b AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT event_type AS level, CAST(sum(c) AS BIGINT) AS n, round(sum(c) / (SELECT sum(c) FROM b), 6) AS p FROM b GROUP BY 1")
def fit_multinomial(spark, sf_dir):
    return rounded(mv.fit_multinomial(_bags(spark, sf_dir), "user_id", "event_type", "c"))


def _bags(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))


@query("score_multinomial", "WITH b AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT event_type, sum(c) / (SELECT sum(c) FROM b) AS p FROM b GROUP BY 1) SELECT user_id, CAST(sum(c) AS DOUBLE) AS total, round(sum(c * ln(p)), 5) AS ll FROM b JOIN p USING (event_type) GROUP BY 1")
def score_multinomial(spark, sf_dir):
    bags = _bags(spark, sf_dir)
    return rounded(mv.score_multinomial(bags, mv.fit_multinomial(bags, "user_id", "event_type", "c"), "user_id", "event_type", "c"), 5)


@query("mean_direction", "WITH x AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS norm FROM embeddings), e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) / norm AS x FROM x WHERE norm > 0), s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT label, max(n) AS n, sqrt(sum(s * s)) / max(n) AS r FROM s GROUP BY 1) SELECT label, n, round(r, 6) AS length, round(r * (64 - r * r) / (1 - r * r), 4) AS start FROM t")
def mean_direction(spark, sf_dir):
    got = mv.mean_direction(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return got.select("label", "n", F.round("length", 6).alias("length"), F.round(mv.concentration_start(F.col("length"), 64), 4).alias("start"))


@query("edge_probability", "WITH e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49 AND l_discount > 0.09 AND c_nationkey <> s_nationkey), n AS (SELECT count(*) AS n FROM nation) SELECT n AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / (n * (n - 1.0)), 6) AS p FROM n")
def edge_probability(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount > 0.09").select("l_orderkey", "l_suppkey")
    edges = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rounded(mv.edge_probability(edges.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")), table(spark, sf_dir, "nation")))


_CENSORED = "SELECT l_returnflag, l_quantity AS t, CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS e FROM lineitem"


def _censored(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_quantity AS t", "CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS e", "l_tax AS x", "CASE WHEN l_linenumber > 3 THEN 1.0D ELSE 0.0D END AS z")


@query("censored_exponential", f"WITH x AS ({_CENSORED}) SELECT l_returnflag, round(sum(t) / sum(e), 6) AS beta FROM x GROUP BY 1")
def censored_exponential(spark, sf_dir):
    return rounded(sr.fit_censored_exponential(_censored(spark, sf_dir), "t", "e", ["l_returnflag"]))


@query("censored_score", f"WITH x AS ({_CENSORED}) SELECT l_returnflag, round(avg(CASE WHEN e = 1 THEN -ln(40) - t / 40 ELSE -t / 40 END), 6) AS mean_ll FROM x GROUP BY 1")
def censored_score(spark, sf_dir):
    t = F.col("t")
    return rounded(_censored(spark, sf_dir).groupBy("l_returnflag").agg(F.avg(sr.censored_loglik(-F.ln(F.lit(40.0)) - t / 40, F.exp(-t / 40), F.col("e"))).alias("mean_ll")))


def _weibull_sql(steps: int) -> str:
    parts = [f"x AS ({_CENSORED})", "r AS (SELECT ln(t) AS u, count(*) AS n, sum(e) AS d FROM x GROUP BY 1)", "k0 AS (SELECT 1.0::DOUBLE AS k)"]
    for i in range(1, steps + 1):
        parts.append(f"s{i} AS (SELECT k, sum(n * exp(k * u)) AS s0, sum(n * exp(k * u) * u) AS s1, sum(n * exp(k * u) * u * u) AS s2, sum(d) AS d, sum(d * u) AS v FROM r, k{i - 1} GROUP BY k)")
        parts.append(f"k{i} AS (SELECT greatest(k - (1 / k + v / d - s1 / s0) / (-1 / (k * k) - (s2 / s0 - pow(s1 / s0, 2))), k / 4) AS k FROM s{i})")
    return "WITH " + ", ".join(parts) + f" SELECT round(k, 6) AS shape, round(pow((SELECT sum(n * exp(k * u)) FROM r) / (SELECT sum(d) FROM r), 1 / k), 5) AS scale FROM k{steps}"


@query("censored_weibull", _weibull_sql(6))
def censored_weibull(spark, sf_dir):
    k, scale = sr.fit_censored_weibull(_censored(spark, sf_dir), "t", "e", 6)
    return spark.createDataFrame([(round(k, 6), round(scale, 5))], "shape double, scale double")


def _cox_sql(steps: int) -> str:
    """Breslow's form with two covariates, Newton steps written out."""
    parts = ["x AS (SELECT l_quantity AS t, CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS e, l_tax AS x, CASE WHEN l_linenumber > 3 THEN 1.0 ELSE 0.0 END AS z FROM lineitem)", "b0 AS (SELECT 0.0::DOUBLE AS bx, 0.0::DOUBLE AS bz)"]
    for i in range(1, steps + 1):
        parts.append(f"p{i} AS (SELECT t, sum(e) AS d, sum(e * x) AS yx, sum(e * z) AS yz, sum(w) AS r, sum(w * x) AS rx, sum(w * z) AS rz, sum(w * x * x) AS rxx, sum(w * x * z) AS rxz, sum(w * z * z) AS rzz FROM (SELECT *, exp(bx * x + bz * z) AS w FROM x, b{i - 1}) GROUP BY t)")
        parts.append(f"a{i} AS (SELECT d, yx, yz, sum(r) OVER o AS a, sum(rx) OVER o AS ax, sum(rz) OVER o AS az, sum(rxx) OVER o AS axx, sum(rxz) OVER o AS axz, sum(rzz) OVER o AS azz FROM p{i} WINDOW o AS (ORDER BY t DESC))")
        parts.append(f"g{i} AS (SELECT sum(yx - d * ax / a) AS gx, sum(yz - d * az / a) AS gz, sum(d * (axx / a - pow(ax / a, 2))) AS hxx, sum(d * (axz / a - ax * az / (a * a))) AS hxz, sum(d * (azz / a - pow(az / a, 2))) AS hzz FROM a{i} WHERE d > 0)")
        parts.append(f"b{i} AS (SELECT bx + (hzz * gx - hxz * gz) / (hxx * hzz - hxz * hxz) AS bx, bz + (hxx * gz - hxz * gx) / (hxx * hzz - hxz * hxz) AS bz FROM g{i}, b{i - 1})")
    return "WITH " + ", ".join(parts) + f" SELECT round(bx, 5) AS x, round(bz, 5) AS z, round(sqrt(hzz / (hxx * hzz - hxz * hxz)), 5) AS se_x, round(sqrt(hxx / (hxx * hzz - hxz * hxz)), 5) AS se_z FROM b{steps}, g{steps}"


@query("cox_breslow", _cox_sql(4))
def cox_breslow(spark, sf_dir):
    beta, se, _, _ = sr.cox_ph(_censored(spark, sf_dir), "t", "e", ["x", "z"], ties="breslow", iterations=4, tolerance=0.0)
    return spark.createDataFrame([tuple(round(float(v), 5) for v in np.concatenate([beta, se]))], "x double, z double, se_x double, se_z double")


@query("cox_efron")
def cox_efron(spark, sf_dir):
    beta, se, loglik, _ = sr.cox_ph(_censored(spark, sf_dir), "t", "e", ["x", "z"], strata="l_returnflag")
    return spark.createDataFrame([(*(round(float(v), 6) for v in np.concatenate([beta, se])), round(loglik, 3))], "x double, z double, se_x double, se_z double, loglik double")
