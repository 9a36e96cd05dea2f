"""Profiles, dependence, diversity, extremes, rank aggregation, regression and folds over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import chooser as ch
from tessel.operators import ecology as ec
from tessel.operators import kendall
from tessel.operators import profile as pr
from tessel.operators import regression as rg
from tessel.plans.base import query, rounded, table

_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("profile_columns", "SELECT 'o_totalprice' AS \"column\", count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders UNION ALL SELECT 'o_custkey', count(*), round(avg(o_custkey), 4), round(stddev_pop(o_custkey), 4), CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE) FROM orders")
def profile_columns(spark, sf_dir):
    p = pr.profile_columns(table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey"))
    return p.select("column", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "least", "most")


@query("recommend_models")
def recommend_models(spark, sf_dir):
    return pr.recommend(table(spark, sf_dir, "lineitem"))


@query("choose_models")
def choose_models(spark, sf_dir):
    """Kinds by code length, of flat columns and of vectors."""
    return ch.choose(table(spark, sf_dir, "lineitem")).unionByName(ch.choose(table(spark, sf_dir, "embeddings")))


@query("integer_code_lengths", """WITH c AS (SELECT l_linenumber AS x, count(*) AS k FROM lineitem GROUP BY 1), s AS (SELECT sum(k) AS n, sum(k * x) / sum(k) AS m, sum(k * x * x) / sum(k) - pow(sum(k * x) / sum(k), 2) AS v, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h, max(x) - min(x) + 1 AS w, sum(k * lgamma(x + 1)) / sum(k) AS f FROM c)
SELECT 'gaussian' AS family, round(0.5 * log2(2 * pi() * exp(1) * (v + 1 / 12.0)) + log2(n) / n, 6) AS bits FROM s UNION ALL SELECT 'integer_categorical', round(h + 0.5 * log2(n) / n * (w - 1), 6) FROM s UNION ALL SELECT 'poisson', round((m - m * ln(m) + f) / ln(2) + 0.5 * log2(n) / n, 6) FROM s""")
def integer_code_lengths(spark, sf_dir):
    return rounded(ch.code_lengths(table(spark, sf_dir, "lineitem"), "l_linenumber"))


@query("real_code_lengths", """WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v, avg(ln(l_extendedprice)) AS ml, var_pop(ln(l_extendedprice)) AS vl FROM lineitem), g AS (SELECT *, ln(m) - ml AS c FROM s), k AS (SELECT *, (3 - c + sqrt(pow(c - 3, 2) + 24 * c)) / (12 * c) AS k FROM g)
SELECT 'gaussian' AS family, round(0.5 * log2(2 * pi() * exp(1) * v) + log2(n) / n, 6) AS bits FROM k UNION ALL SELECT 'exponential', round((1 + ln(m)) / ln(2) + 0.5 * log2(n) / n, 6) FROM k UNION ALL SELECT 'lognormal', round(ml / ln(2) + 0.5 * log2(2 * pi() * exp(1) * vl) + log2(n) / n, 6) FROM k UNION ALL SELECT 'gamma', round(-((k - 1) * ml - k - lgamma(k) - k * ln(m / k)) / ln(2) + log2(n) / n, 6) FROM k""")
def real_code_lengths(spark, sf_dir):
    return rounded(ch.code_lengths(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


def _entropy_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(*) AS levels, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS bits, round(log2(sum(k)) - sum(k * log2(k)) / sum(k) + 0.5 * (count(*) - 1) * log2(sum(k)) / sum(k), 6) AS bic_bits FROM (SELECT {c}, count(*) AS k FROM lineitem GROUP BY 1)"


@query("profile_entropy_bits", " UNION ALL ".join(_entropy_sql(c) for c in _COLS))
def profile_entropy_bits(spark, sf_dir):
    return rounded(pr.entropy_bits(table(spark, sf_dir, "lineitem"), _COLS))


@query("bic_family_choice", """WITH s AS (SELECT count(*) AS n, var_pop(l_extendedprice) AS v, avg(l_extendedprice) AS m, avg(ln(l_extendedprice)) AS ml, var_pop(ln(l_extendedprice)) AS vl FROM lineitem)
SELECT 'gaussian' AS family, round(0.5 * log2(2 * pi() * exp(1) * v) + log2(n) / n, 6) AS bits FROM s UNION ALL SELECT 'lognormal', round(ml / ln(2) + greatest(0.5 * log2(2 * pi() * exp(1) * vl), 0) + log2(n) / n, 6) FROM s UNION ALL SELECT 'exponential', round((1 + ln(m)) / ln(2) + 0.5 * log2(n) / n, 6) FROM s""")
def bic_family_choice(spark, sf_dir):
    return rounded(pr.bic_family_choice(table(spark, sf_dir, "lineitem"), "l_extendedprice").drop("weight"))


def _mi_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, CAST(sum(k) AS BIGINT) AS n, greatest(sum(k * log2(k * t / (ka * kb))) / sum(k), 0) AS mi, count(*) AS cells, count(DISTINCT a) AS la, count(DISTINCT b) AS lb
FROM (SELECT a, b, k, sum(k) OVER (PARTITION BY a) * 1.0 AS ka, sum(k) OVER (PARTITION BY b) * 1.0 AS kb, sum(k) OVER () AS t FROM (SELECT {a} AS a, {b} AS b, count(*) AS k FROM lineitem GROUP BY 1, 2))"""


@query("pairwise_mi", "WITH x AS (" + " UNION ALL ".join(_mi_sql(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + ") SELECT a, b, n, round(mi, 6) AS mi_bits, round(greatest(mi - (cells - la - lb + 1) / (2 * n * ln(2)), 0), 6) AS adjusted_bits, round(mi - 0.5 * (la - 1) * (lb - 1) * log2(n) / n, 6) AS gain_bits FROM x")
def pairwise_mi(spark, sf_dir):
    return rounded(pr.pairwise_mi(table(spark, sf_dir, "lineitem"), _COLS))


@query("dependency_forest")
def dependency_forest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.month("o_orderdate").alias("month"))
    edges = pr.dependency_forest(pr.pairwise_mi(rows, rows.columns))
    return spark.createDataFrame([(a, b, round(w, 6)) for a, b, w in edges], "a string, b string, bits double")


@query("dependency_gain", "WITH p AS (SELECT l_returnflag, count(*) AS n, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS n, var_pop(l_quantity) AS v FROM lineitem) SELECT count(*) AS levels, round(sum(-0.5 * p.n * (ln(2 * pi() * p.v) + 1)) + 0.5 * max(t.n) * (ln(2 * pi() * max(t.v)) + 1) - (count(*) - 1) * ln(max(t.n)), 4) AS gain FROM p, t")
def dependency_gain(spark, sf_dir):
    return rounded(pr.dependency_gain(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity"), 4)


@query("linear_gaussian_edge", "WITH s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, var_pop(l_extendedprice) AS v, covar_pop(l_extendedprice, l_quantity) AS c FROM lineitem) SELECT round(b, 4) AS slope, round(a, 3) AS intercept, round(sqrt(v - b * c), 3) AS residual_sd, round(-0.5 * n * ln(v - b * c) + 0.5 * n * ln(v) - 0.5 * ln(n), 3) AS gain FROM s")
def linear_gaussian_edge(spark, sf_dir):
    got = pr.linear_gaussian_edge(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return got.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round(F.sqrt("residual_variance"), 3).alias("residual_sd"), F.round("gain", 3).alias("gain"))


@query("conditional_mi", "WITH j AS (SELECT l_returnflag AS x, l_linestatus AS y, l_linenumber AS z, count(*) AS k FROM lineitem GROUP BY ALL), w AS (SELECT k, sum(k) OVER (PARTITION BY z) AS kz, sum(k) OVER (PARTITION BY x, z) AS kxz, sum(k) OVER (PARTITION BY y, z) AS kyz FROM j) SELECT round(greatest(sum(k * ln(k * kz / (kxz * kyz))) / sum(k), 0), 6) AS cmi FROM w")
def conditional_mi(spark, sf_dir):
    return rounded(pr.conditional_mi(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber"))


_AB = "WITH c AS (SELECT o_orderpriority AS g, o_custkey AS s, count(*) AS k FROM orders GROUP BY 1, 2)"


def _abundance(spark, sf_dir):
    return ec.abundance(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority"])


@query("chao1", _AB + " SELECT g AS o_orderpriority, count(*) AS observed, round(count(*) + count(*) FILTER (k = 1) * (count(*) FILTER (k = 1) - 1) / (2.0 * (count(*) FILTER (k = 2) + 1)), 6) AS chao1, round(1 - count(*) FILTER (k = 1) / sum(k), 6) AS coverage FROM c GROUP BY g")
def chao1(spark, sf_dir):
    return rounded(ec.chao1(_abundance(spark, sf_dir), ["o_orderpriority"]))


@query("chao2", "WITH i AS (SELECT DISTINCT user_id AS s, hour(ts) * 60 + minute(ts) AS m FROM events), q AS (SELECT m, count(*) AS k FROM i GROUP BY m), t AS (SELECT count(DISTINCT s) AS m FROM i) SELECT count(*) AS s, round(count(*) + (max(t.m) - 1) / max(t.m) * count(*) FILTER (k = 1) * (count(*) FILTER (k = 1) - 1) / (2.0 * (count(*) FILTER (k = 2) + 1)), 6) AS chao2 FROM q, t")
def chao2(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    return rounded(ec.chao2(rows, "user_id", "minute"))


@query("ace", "WITH c AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), s AS (SELECT count(*) FILTER (k > 10) AS sa, count(*) FILTER (k <= 10) AS sr, sum(k) FILTER (k <= 10) AS nr, count(*) FILTER (k = 1) AS f1, sum(k * (k - 1)) FILTER (k <= 10) AS ii FROM c), d AS (SELECT *, 1 - f1 / nr AS cv FROM s) SELECT round(sa + sr / cv + f1 / cv * greatest(sr / cv * ii / (nr * (nr - 1)) - 1, 0), 6) AS ace FROM d")
def ace(spark, sf_dir):
    return rounded(ec.ace(ec.abundance(table(spark, sf_dir, "orders"), "o_custkey")))


@query("hill_numbers", _AB + ", p AS (SELECT g, k / sum(k) OVER (PARTITION BY g) AS p FROM c) SELECT g AS o_orderpriority, CAST(count(*) AS DOUBLE) AS q0, round(exp(-sum(p * ln(p))), 5) AS q1, round(1 / sum(p * p), 5) AS q2 FROM p GROUP BY g")
def hill_numbers(spark, sf_dir):
    return rounded(ec.hill_numbers(_abundance(spark, sf_dir), ["o_orderpriority"]), 5)


@query("hill_tail_index", "WITH t AS (SELECT ln(o_totalprice) AS lx, row_number() OVER (ORDER BY o_totalprice DESC) AS r FROM orders), d AS (SELECT lx - (SELECT lx FROM t WHERE r = 201) AS d FROM t WHERE r <= 200) SELECT round(avg(d), 6) AS hill, round(avg(d) + 1 - 0.5 / (1 - pow(avg(d), 2) / avg(d * d)), 6) AS moment FROM d")
def hill_tail_index(spark, sf_dir):
    return rounded(ec.hill_estimator(table(spark, sf_dir, "orders"), "o_totalprice", 200))


@query("mean_excess", "SELECT u, count(*) FILTER (o_totalprice > u) AS n, round(avg(o_totalprice - u) FILTER (o_totalprice > u), 4) AS mean_excess FROM orders, (SELECT unnest([50000.0::DOUBLE, 100000.0::DOUBLE, 200000.0::DOUBLE]) AS u) GROUP BY u")
def mean_excess(spark, sf_dir):
    return rounded(ec.mean_excess(table(spark, sf_dir, "orders"), "o_totalprice", [50000, 100000, 200000]), 4)


@query("record_times", "WITH r AS (SELECT user_id, row_number() OVER w AS position, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, CAST(position AS INTEGER) AS position, value FROM r WHERE b IS NULL OR value > b")
def record_times(spark, sf_dir):
    return ec.record_times(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


_RANKS = "WITH c AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS m FROM c)"


def sums_in_order(rows, by: str, item: str, value: str, at: str):
    """(by, item, v): sums of doubles; those that lie within rounding of another of the same `by` are added up anew in the order of `at`.

    Which of two such sums is larger depends on the order of their parts; only rows of such sums are gathered.
    """
    from pyspark.sql import Window

    near, beside = F.lit(1e-9), Window.partitionBy(by).orderBy(F.desc("v"), item)
    sums = rows.groupBy(by, item).agg(F.sum(value).alias("v"), F.sum(F.abs(value)).alias("size"))
    close = lambda step: F.abs(F.col("v") - step("v").over(beside)) <= near * F.greatest("size", step("size").over(beside))
    sums = sums.select(by, item, "v", F.coalesce(close(F.lag) | close(F.lead), close(F.lag), close(F.lead), F.lit(False)).alias("close"))
    parts = rows.where(F.col(value).isNotNull()).join(sums.where("close").select(by, item), [by, item])
    anew = parts.groupBy(by, item).agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("parts"))
    anew = anew.select(by, item, F.aggregate("parts", F.lit(0.0), lambda a, r: a + r[value]).alias("anew"))
    return sums.join(anew, [by, item], "left").select(by, item, F.coalesce("anew", "v").alias("v"))


def _rankings(spark, sf_dir):
    from pyspark.sql import Window

    per = sums_in_order(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")
    return per.select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("v"), "event_type")) - 1).alias("pos"))


@query("borda", _RANKS + " SELECT event_type, CAST(sum(m - 1 - pos) AS BIGINT) AS score FROM r GROUP BY 1")
def borda(spark, sf_dir):
    return ec.borda(_rankings(spark, sf_dir), "user_id", "event_type", "pos")


@query("copeland", _RANKS + ", d AS (SELECT a.event_type AS item, b.event_type AS other, sum(CASE WHEN a.pos < b.pos THEN 1 ELSE -1 END) AS d FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY 1, 2) SELECT item, CAST(sum(sign(d)) AS BIGINT) AS score FROM d GROUP BY 1")
def copeland(spark, sf_dir):
    return ec.copeland(_rankings(spark, sf_dir), "user_id", "event_type", "pos")


@query("kendall_tau", "WITH c AS (SELECT l_linenumber AS x, CAST(l_quantity / 5 AS INTEGER) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT CAST(a.n AS HUGEINT) * b.n AS w, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM c a JOIN c b ON a.x > b.x OR (a.x = b.x AND a.y > b.y)), q AS (SELECT CAST(sum(CASE WHEN s > 0 THEN w ELSE 0 END) AS BIGINT) AS concordant, CAST(sum(CASE WHEN s < 0 THEN w ELSE 0 END) AS BIGINT) AS discordant, CAST(sum(CASE WHEN tx THEN w ELSE 0 END) AS BIGINT) AS ties_x, CAST(sum(CASE WHEN ty THEN w ELSE 0 END) AS BIGINT) AS ties_y FROM p) SELECT *, round((concordant - discordant) / sqrt(CAST(concordant + discordant + ties_x AS DOUBLE) * (concordant + discordant + ties_y)), 6) AS tau_b FROM q")
def kendall_tau(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.round(F.col("l_quantity") / 5).cast("int").alias("y"))
    return rounded(kendall.counts(rows, "l_linenumber", "y"))


@query("ols_simple", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS b0, round(regr_slope(l_extendedprice, l_quantity), 5) AS b1 FROM lineitem")
def ols_simple(spark, sf_dir):
    b = rg.ols(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(b[0]), 4), round(float(b[1]), 5))], "b0 double, b1 double")


def _coefficients(spark, beta, digits=6):
    return spark.createDataFrame([(i, round(float(b), digits)) for i, b in enumerate(beta)], "i int, beta double")


@query("ridge")
def ridge(spark, sf_dir):
    return _coefficients(spark, rg.ols(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ridge=10.0), 3)


def _binary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_quantity / 50 AS q", "l_discount AS d", "CASE WHEN (l_orderkey * 7 + l_linenumber * 3) % 50 < l_quantity THEN 1 ELSE 0 END AS y", "l_linenumber AS k", "l_suppkey")


_BINARY = "x AS (SELECT l_quantity / 50 AS q, l_discount AS d, CASE WHEN (l_orderkey * 7 + l_linenumber * 3) % 50 < l_quantity THEN 1 ELSE 0 END AS y, l_linenumber AS k, l_suppkey FROM lineitem)"
#: The inverse of a symmetric 3 x 3 matrix g00 .. g22 over its determinant, entry by entry.
_DET = "(g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02))"
_INVERSE = {
    (0, 0): "(g11 * g22 - g12 * g12)",
    (0, 1): "(g02 * g12 - g01 * g22)",
    (0, 2): "(g01 * g12 - g02 * g11)",
    (1, 1): "(g00 * g22 - g02 * g02)",
    (1, 2): "(g01 * g02 - g00 * g12)",
    (2, 2): "(g00 * g11 - g01 * g01)",
}
_GRAM = "sum({w}) AS g00, sum({w} * q) AS g01, sum({w} * d) AS g02, sum({w} * q * q) AS g11, sum({w} * q * d) AS g12, sum({w} * d * d) AS g22"


def _inverse(i: int, j: int) -> str:
    return f"({_INVERSE[min(i, j), max(i, j)]} / {_DET})"


def _times(i: int, b: str = "b") -> str:
    return " + ".join(f"{_inverse(i, j)} * {b}{j}" for j in range(3))


def _newton_sql(y: str, mean: str, weight: str, start: str, steps: int) -> str:
    """Newton steps on the likelihood of y, whose mean and weight are written in the linear part e."""
    parts = [_BINARY, f"c0 AS ({start})"]
    for i in range(1, steps + 1):
        parts.append(f"e{i} AS (SELECT *, c_0 + c_1 * q + c_2 * d AS e FROM x, c{i - 1})")
        parts.append(f"m{i} AS (SELECT *, {mean} AS mu, {weight} AS w FROM e{i})")
        parts.append(f"g{i} AS (SELECT c_0, c_1, c_2, {_GRAM.format(w='w')}, sum({y} - mu) AS b0, sum(({y} - mu) * q) AS b1, sum(({y} - mu) * d) AS b2 FROM m{i} GROUP BY c_0, c_1, c_2)")
        parts.append(f"c{i} AS (SELECT {', '.join(f'c_{j} + {_times(j)} AS c_{j}' for j in range(3))} FROM g{i})")
    return "WITH " + ", ".join(parts) + " SELECT CAST(i AS INTEGER) AS i, round(CASE i WHEN 0 THEN c_0 WHEN 1 THEN c_1 ELSE c_2 END, 6) AS beta FROM c" + str(steps) + ", range(3) t(i)"


@query("logistic_irls", _newton_sql("y", "1 / (1 + exp(-e))", "1 / (1 + exp(-e)) * (1 - 1 / (1 + exp(-e)))", "SELECT 0.0::DOUBLE AS c_0, 0.0::DOUBLE AS c_1, 0.0::DOUBLE AS c_2", 8))
def logistic_irls(spark, sf_dir):
    return _coefficients(spark, rg.glm(_binary(spark, sf_dir), ["q", "d"], "y"))


@query("poisson_irls", _newton_sql("k", "exp(e)", "exp(e)", "SELECT ln(avg(k)) AS c_0, 0.0::DOUBLE AS c_1, 0.0::DOUBLE AS c_2 FROM x", 6))
def poisson_irls(spark, sf_dir):
    return _coefficients(spark, rg.glm(_binary(spark, sf_dir), ["q", "d"], "k", "poisson"))


def _robust_sql(cluster: bool) -> str:
    parts = [_BINARY, f"g AS (SELECT count(*) AS n, {_GRAM.format(w='1')}, sum(k) AS b0, sum(k * q) AS b1, sum(k * d) AS b2 FROM x)", f"v AS (SELECT *, {', '.join(f'{_times(j)} AS c{j}' for j in range(3))} FROM g)"]
    parts.append("e AS (SELECT l_suppkey, q, d, k - c0 - c1 * q - c2 * d AS e FROM x, v)")
    parts.append("s AS (SELECT " + ("sum(e) AS s0, sum(e * q) AS s1, sum(e * d) AS s2 FROM e GROUP BY l_suppkey" if cluster else "e AS s0, e * q AS s1, e * d AS s2 FROM e") + ")")
    parts.append("m AS (SELECT count(*) AS k, " + ", ".join(f"sum(s{i} * s{j}) AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM s)")
    factor = "k / (k - 1.0) * (n - 1.0) / (n - 3.0)" if cluster else "n / (n - 3.0)"
    quad = lambda r: " + ".join(f"{_inverse(r, i)} * m{i}{j} * {_inverse(j, r)}" for i in range(3) for j in range(3))
    return "WITH " + ", ".join(parts) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {r} AS i, round(c{r}, 6) AS beta, round(sqrt({factor} * ({quad(r)})), 6) AS se FROM v, m" for r in range(3)) + ")"


@query("robust_hc1", _robust_sql(False))
def robust_hc1(spark, sf_dir):
    beta, se = rg.robust_errors(_binary(spark, sf_dir), ["q", "d"], "k")
    return spark.createDataFrame([(i, round(float(b), 6), round(float(s), 6)) for i, (b, s) in enumerate(zip(beta, se, strict=True))], "i int, beta double, se double")


@query("cluster_robust", _robust_sql(True))
def cluster_robust(spark, sf_dir):
    beta, se = rg.robust_errors(_binary(spark, sf_dir), ["q", "d"], "k", "l_suppkey")
    return spark.createDataFrame([(i, round(float(b), 6), round(float(s), 6)) for i, (b, s) in enumerate(zip(beta, se, strict=True))], "i int, beta double, se double")


@query("newey_west", "WITH s AS (SELECT user_id, count(*) AS n, avg(value) AS mean, floor(4 * pow(count(*) / 100.0, 2.0 / 9)) AS l FROM events GROUP BY 1), e AS (SELECT e.user_id, value - mean AS e, n, mean, l, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS t FROM events e JOIN s USING (user_id)), p AS (SELECT a.user_id, a.n, a.mean, sum(CASE WHEN a.t = b.t THEN a.e * a.e ELSE 2 * (1 - (a.t - b.t) / (a.l + 1)) * a.e * b.e END) AS v FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t AND a.t - b.t <= a.l GROUP BY 1, 2, 3) SELECT user_id, n, round(mean, 6) AS mean, round(sqrt(v / pow(n, 2) * n / (n - 1)), 6) AS se FROM p")
def newey_west(spark, sf_dir):
    return rounded(rg.newey_west(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", "user_id"))


@query("kfold", "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r")
def kfold(spark, sf_dir):
    return rg.kfold(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 7)


@query("stratified_kfold", "SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def stratified_kfold(spark, sf_dir):
    return rg.stratified_kfold(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 5)


@query("group_kfold")
def group_kfold(spark, sf_dir):
    return rg.group_kfold(table(spark, sf_dir, "supplier"), "s_nationkey", 4)


@query("time_series_folds", "WITH n AS (SELECT count(*) AS n FROM orders), f AS (SELECT i, n, n // 6 AS s FROM n, range(5) t(i)) SELECT CAST(i AS INTEGER) AS fold, greatest(0, (i + 1) * s - 10) AS train_end, (i + 1) * s AS test_start, CASE WHEN i = 4 THEN n ELSE (i + 2) * s END AS test_end FROM f")
def time_series_folds(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    return spark.createDataFrame([(i, *f) for i, f in enumerate(rg.time_series_folds(n, 5, 10))], "fold int, train_end long, test_start long, test_end long")


@query("poisson_bootstrap")
def poisson_bootstrap(spark, sf_dir):
    return rounded(rg.poisson_bootstrap(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 20))
