"""Composite, conditional, mixture and sequence models over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import combinators as cb
from tessel.operators import families as fam
from tessel.plans.base import query, rounded, table

_REC = [cb.Categories("l_returnflag", ("A", "N", "R")), cb.Leaf("gaussian", "l_extendedprice"), cb.Leaf("gaussian", "l_quantity")]
_COND = """WITH m AS (SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS r, avg(l_extendedprice) AS me, var_pop(l_extendedprice) AS ve, avg(l_quantity) AS mq, var_pop(l_quantity) AS vq FROM lineitem GROUP BY 1),
s AS (SELECT l_linestatus, ln(CASE l_returnflag WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END) - 0.5 * ln(2 * pi() * ve) - pow(l_extendedprice - me, 2) / (2 * ve) - 0.5 * ln(2 * pi() * vq) - pow(l_quantity - mq, 2) / (2 * vq) AS ll FROM lineitem JOIN m USING (l_linestatus))
SELECT l_linestatus, count(*) AS n, round(avg(ll), 6) AS mean_ll FROM s GROUP BY 1"""


@query("conditional_composite_score", _COND)
def conditional_composite_score(spark, sf_dir):
    """One aggregation fits a record model per line status; rows are scored under their own and averaged."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity")
    model = cb.fit_conditional(rows, "l_linestatus", _REC)
    return rounded(cb.score_conditional(rows, model, "l_linestatus", _REC).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.avg("ll").alias("mean_ll")))


@query("conditional_gaussian", "SELECT o_orderpriority, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, round(avg(o_totalprice), 4) AS mu, round(sqrt(var_pop(o_totalprice)), 4) AS sigma FROM orders GROUP BY 1")
def conditional_gaussian(spark, sf_dir):
    got = cb.fit_conditional(table(spark, sf_dir, "orders"), "o_orderpriority", [cb.Leaf("gaussian", "o_totalprice")])
    return got.select("o_orderpriority", "n", F.round("share", 6).alias("share"), F.round("m0_p_mu", 4).alias("mu"), F.round(F.sqrt("m0_p_sigma2"), 4).alias("sigma"))


_MIX = "0.4 * exp(-0.5 * ln(2 * pi() * 80) - pow(l_quantity - 12, 2) / 160)", "0.6 * exp(-0.5 * ln(2 * pi() * 90) - pow(l_quantity - 36, 2) / 180)"


def _mixture(*more):
    return cb.Mixture([cb.Leaf("gaussian", "l_quantity")], [0.4, 0.6], [{"0_mu": 12.0, "0_sigma2": 80.0}, {"0_mu": 36.0, "0_sigma2": 90.0}])


@query("mixture_score", f"SELECT l_returnflag, round(avg(ln({_MIX[0]} + {_MIX[1]})), 6) AS mean_ll FROM lineitem GROUP BY 1")
def mixture_score(spark, sf_dir):
    return rounded(_mixture().score(table(spark, sf_dir, "lineitem")).groupBy("l_returnflag").agg(F.avg("ll").alias("mean_ll")))


@query("mixture_posterior", f"SELECT l_quantity, round({_MIX[0]} / ({_MIX[0]} + {_MIX[1]}), 6) AS p0, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mixture_posterior(spark, sf_dir):
    got = _mixture().posterior(table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")))
    return got.select("l_quantity", F.round(F.col("posterior")[0], 6).alias("p0"), "n")


@query("classify_argmax", f"SELECT CASE WHEN {_MIX[0]} >= {_MIX[1]} THEN 0 ELSE 1 END AS component, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1")
def classify_argmax(spark, sf_dir):
    return rounded(_mixture().classify(table(spark, sf_dir, "lineitem")).groupBy("component").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity")))


def _em_sql(iterations: int) -> str:
    parts, prev = ["p0 AS (SELECT 0.4::DOUBLE AS w, 12.0::DOUBLE AS m0, 80.0::DOUBLE AS v0, 36.0::DOUBLE AS m1, 90.0::DOUBLE AS v1, 0.0::DOUBLE AS ll)", "q AS (SELECT l_quantity AS x, count(*) AS c FROM lineitem GROUP BY 1)"], "p0"
    for i in range(1, iterations + 1):
        parts.append(f"t{i} AS (SELECT x, c, ln(w) - 0.5 * ln(2 * pi() * v0) - pow(x - m0, 2) / (2 * v0) AS a, ln(1 - w) - 0.5 * ln(2 * pi() * v1) - pow(x - m1, 2) / (2 * v1) AS b FROM q, {prev})")
        parts.append(f"r{i} AS (SELECT x, c, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS l, exp(a - (greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))))) AS r FROM t{i})")
        parts.append(f"p{i} AS (SELECT sum(c * r) / sum(c) AS w, sum(c * r * x) / sum(c * r) AS m0, sum(c * r * x * x) / sum(c * r) - pow(sum(c * r * x) / sum(c * r), 2) AS v0, sum(c * (1 - r) * x) / sum(c * (1 - r)) AS m1, sum(c * (1 - r) * x * x) / sum(c * (1 - r)) - pow(sum(c * (1 - r) * x) / sum(c * (1 - r)), 2) AS v1, sum(c * l) AS ll FROM r{i})")
        prev = f"p{i}"
    return "WITH " + ", ".join(parts) + f" SELECT round(w, 5) AS w, round(m0, 4) AS m0, round(v0, 3) AS v0, round(m1, 4) AS m1, round(v1, 3) AS v1, round(ll, 2) AS ll FROM {prev}"


def _em(name: str, iterations: int):
    @query(name, _em_sql(iterations))
    def run(spark, sf_dir):
        model, trace = cb.fit_mixture(table(spark, sf_dir, "lineitem").select("l_quantity"), _mixture(), iterations, 0.0)
        a, b = model.params
        return spark.createDataFrame([(round(model.weights[0], 5), round(a["0_mu"], 4), round(a["0_sigma2"], 3), round(b["0_mu"], 4), round(b["0_sigma2"], 3), round(trace[-1], 2))], "w double, m0 double, v0 double, m1 double, v1 double, ll double")


_em("mixture_em_step", 1)
_em("mixture_em_5_steps", 5)


def _strategy_sql(how: str, steps: int) -> str:
    """Steps where the likelier component takes a row whole, or where terms are divided by a falling temperature."""
    parts, prev = ["p0 AS (SELECT 0.4::DOUBLE AS w, 12.0::DOUBLE AS m0, 80.0::DOUBLE AS v0, 36.0::DOUBLE AS m1, 90.0::DOUBLE AS v1, 0.0::DOUBLE AS ll)", "q AS (SELECT l_quantity AS x, count(*) AS c FROM lineitem GROUP BY 1)"], "p0"
    for i in range(1, steps + 1):
        heat = max(1.0, 4.0 * 0.7 ** (i - 1))
        parts.append(f"t{i} AS (SELECT x, c, ln(w) - 0.5 * ln(2 * pi() * v0) - pow(x - m0, 2) / (2 * v0) AS a, ln(1 - w) - 0.5 * ln(2 * pi() * v1) - pow(x - m1, 2) / (2 * v1) AS b FROM q, {prev})")
        r = "CASE WHEN a >= b THEN 1.0 ELSE 0.0 END" if how == "hard" else f"1 / (1 + exp((b - a) / {heat!r}))"
        parts.append(f"r{i} AS (SELECT x, c, greatest(a, b) + ln(1 + exp(-abs(a - b))) AS l, {r} AS r FROM t{i})")
        parts.append(f"p{i} AS (SELECT sum(c * r) / sum(c) AS w, sum(c * r * x) / sum(c * r) AS m0, sum(c * r * x * x) / sum(c * r) - pow(sum(c * r * x) / sum(c * r), 2) AS v0, sum(c * (1 - r) * x) / sum(c * (1 - r)) AS m1, sum(c * (1 - r) * x * x) / sum(c * (1 - r)) - pow(sum(c * (1 - r) * x) / sum(c * (1 - r)), 2) AS v1, sum(c * l) AS ll FROM r{i})")
        prev = f"p{i}"
    return "WITH " + ", ".join(parts) + f" SELECT unnest([0.0::DOUBLE, 1.0]) AS component, round(unnest([w, 1 - w]), 6) AS w, round(unnest([m0, m1]), 6) AS mu, round(ll, 3) AS ll FROM {prev}"


def _em_strategy(how: str):
    @query(f"mixture_em_{how}", _strategy_sql(how, 8))
    def run(spark, sf_dir):
        model, trace = cb.fit_mixture(table(spark, sf_dir, "lineitem").select("l_quantity"), _mixture(), 8, 0.0, how)
        return spark.createDataFrame([(float(k), round(w, 6), round(p["0_mu"], 6), round(trace[-1], 3)) for k, (w, p) in enumerate(zip(model.weights, model.params, strict=True))], "component double, w double, mu double, ll double")


for _how in ("hard", "annealed"):
    _em_strategy(_how)


@query("optional_missing_rate", "WITH x AS (SELECT l_returnflag, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem) SELECT l_returnflag, round(avg(CASE WHEN d IS NULL THEN 1.0 ELSE 0 END), 6) AS p_missing, round(avg(d), 6) AS mu, round(var_pop(d), 6) AS sigma2 FROM x GROUP BY 1")
def optional_missing_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_discount END AS d")
    rate = rows.groupBy("l_returnflag").agg(F.avg(F.col("d").isNull().cast("double")).alias("p_missing"))
    return rounded(rate.join(fam.fit(rows, "gaussian", "d", ["l_returnflag"]), "l_returnflag"))


@query("score_optional", "WITH x AS (SELECT l_returnflag, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) SELECT l_returnflag, round(avg(CASE WHEN q IS NULL THEN ln(0.06) ELSE ln(0.94) - 0.5 * ln(2 * pi() * 200) - pow(q - 25, 2) / 400 END), 6) AS modelled, round(avg(CASE WHEN q IS NULL THEN 0 ELSE -0.5 * ln(2 * pi() * 200) - pow(q - 25, 2) / 400 END), 6) AS marginalised FROM x GROUP BY 1")
def score_optional(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS q")
    child = fam.FAMILIES["gaussian"].logpdf(F.col("q"), {"mu": F.lit(25.0), "sigma2": F.lit(200.0)})
    return rounded(rows.groupBy("l_returnflag").agg(F.avg(cb.optional_logpdf(F.col("q"), child, 0.06)).alias("modelled"), F.avg(cb.optional_logpdf(F.col("q"), child, None)).alias("marginalised")))


@query("hurdle_and_zero_inflated", "WITH x AS (SELECT l_linestatus, CAST(l_linenumber % 4 AS DOUBLE) AS k FROM lineitem), s AS (SELECT l_linestatus, k, k * ln(1.5) - 1.5 - lgamma(k + 1) AS c FROM x) SELECT l_linestatus, round(avg(CASE WHEN k = 0 THEN ln(0.3) ELSE ln(0.7) + c - ln(1 - exp(-1.5)) END), 6) AS hurdle, round(avg(CASE WHEN k = 0 THEN ln(0.3 + 0.7 * exp(-1.5)) ELSE ln(0.7) + c END), 6) AS zero_inflated FROM s GROUP BY 1")
def hurdle_and_zero_inflated(spark, sf_dir):
    k = F.col("k")
    child = fam.FAMILIES["poisson"].logpdf(k, {"lam": F.lit(1.5)})
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linestatus", "CAST(l_linenumber % 4 AS DOUBLE) AS k")
    return rounded(rows.groupBy("l_linestatus").agg(F.avg(cb.hurdle_logpdf(k, child, F.lit(-1.5), F.lit(0.3))).alias("hurdle"), F.avg(cb.zero_inflated_logpdf(k, child, F.lit(-1.5), F.lit(0.3))).alias("zero_inflated")))


@query("truncated_categorical", "WITH p AS (SELECT event_type, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM events GROUP BY 1) SELECT event_type AS level, round(p / sum(p) OVER (), 6) AS p FROM p WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 3)")
def truncated_categorical(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    levels = [r[0] for r in rows.select("event_type").distinct().orderBy("event_type").limit(3).collect()]
    return rounded(cb.truncated(fam.fit_categorical(rows, "event_type"), "level", "p", levels))


@query("select_route", "SELECT o_orderstatus, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN -ln(120000) - o_totalprice / 120000 ELSE -0.5 * ln(2 * pi() * 1e10) - pow(o_totalprice - 150000, 2) / 2e10 END), 6) AS mean_ll FROM orders GROUP BY 1")
def select_route(spark, sf_dir):
    x = F.col("o_totalprice")
    ll = F.when(F.col("o_orderstatus") == "F", fam.FAMILIES["exponential"].logpdf(x, {"beta": F.lit(120000.0)})).otherwise(fam.FAMILIES["gaussian"].logpdf(x, {"mu": F.lit(150000.0), "sigma2": F.lit(1e10)}))
    return rounded(table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg(ll).alias("mean_ll")))


@query("sequence_length_model", "WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT event_type, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM events GROUP BY 1), l AS (SELECT avg(n) AS lam FROM s), c AS (SELECT user_id, sum(ln(p)) AS ll FROM events JOIN t USING (event_type) GROUP BY 1) SELECT s.user_id, round(c.ll + n * ln(lam) - lam - lgamma(n + 1), 5) AS ll FROM s JOIN c USING (user_id), l")
def sequence_length_model(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    levels = fam.fit_categorical(rows, "event_type").select(F.col("level").alias("event_type"), "p")
    per = rows.join(F.broadcast(levels), "event_type").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.ln("p")).alias("c"))
    lam = rows.groupBy("user_id").count().agg(F.avg("count").alias("lam"))
    ll = F.col("c") + fam.FAMILIES["poisson"].logpdf(F.col("n").cast("double"), {"lam": F.col("lam")})
    return rounded(per.crossJoin(F.broadcast(lam)).select("user_id", ll.alias("ll")), 5)


@query("bernoulli_set", "WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60), n AS (SELECT count(DISTINCT user_id) AS n FROM s) SELECT event_type, round(count(*) * 1.0 / n, 6) AS p FROM s, n GROUP BY event_type, n")
def bernoulli_set(spark, sf_dir):
    return rounded(cb.bernoulli_set(table(spark, sf_dir, "events").where("value > 60"), "user_id", "event_type"))


@query("bernoulli_set_score", "WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 120), n AS (SELECT count(DISTINCT user_id) AS n FROM s), p AS (SELECT event_type, count(*) * 1.0 / n AS p FROM s, n GROUP BY event_type, n) SELECT user_id, round((SELECT sum(ln(1 - p)) FROM p) + sum(ln(p / (1 - p))), 6) AS ll FROM s JOIN p USING (event_type) GROUP BY user_id")
def bernoulli_set_score(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 120")
    return rounded(cb.bernoulli_set_score(rows, cb.bernoulli_set(rows, "user_id", "event_type"), "user_id", "event_type"))


_STEPS = "WITH e AS (SELECT user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"


@query("markov_init", _STEPS + " SELECT state, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS p FROM e WHERE prev IS NULL GROUP BY state")
def markov_init(spark, sf_dir):
    return rounded(cb.markov_chain(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")[0])


@query("markov_transitions", _STEPS + " SELECT prev, state, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY prev), 6) AS p FROM e WHERE prev IS NOT NULL GROUP BY prev, state")
def markov_transitions(spark, sf_dir):
    return rounded(cb.markov_chain(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")[1])


@query("markov_seq_loglik", _STEPS + ", i AS (SELECT state, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM e WHERE prev IS NULL GROUP BY state), m AS (SELECT prev, state, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY prev) AS p FROM e WHERE prev IS NOT NULL GROUP BY prev, state) SELECT user_id, count(*) AS n, round(sum(ln(coalesce(m.p, i.p))), 5) AS ll FROM e LEFT JOIN m ON m.prev = e.prev AND m.state = e.state LEFT JOIN i ON e.prev IS NULL AND i.state = e.state GROUP BY user_id")
def markov_seq_loglik(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    init, moves = cb.markov_chain(rows, "user_id", ["ts", "event_id"], "event_type")
    return rounded(cb.markov_score(rows, init, moves, "user_id", ["ts", "event_id"], "event_type"), 5)


@query("ctmc_rates", "WITH e AS (SELECT event_type AS state, lead(event_type) OVER w AS nxt, epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)), d AS (SELECT state, sum(dt) AS dwell FROM e WHERE nxt IS NOT NULL GROUP BY 1), m AS (SELECT state, nxt, count(*) AS n FROM e WHERE nxt IS NOT NULL AND nxt <> state GROUP BY 1, 2) SELECT m.state, m.nxt AS next, m.n, round(d.dwell, 1) AS dwell, round(m.n / d.dwell * 1e6, 4) AS rate_per_ms FROM m JOIN d USING (state)")
def ctmc_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return cb.ctmc_rates(rows, "user_id", "t", "event_type").select("state", "next", "n", F.round("dwell", 1).alias("dwell"), F.round(F.col("rate") * 1e6, 4).alias("rate_per_ms"))


@query("renewal_gaps", "WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) SELECT count(g) AS n, round(avg(g), 3) AS beta, round(sum(-ln((SELECT avg(g) FROM g)) - g / (SELECT avg(g) FROM g)) / count(g), 6) AS mean_ll FROM g")
def renewal_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    g = cb.gaps(rows, "user_id", "t")
    beta = fam.fit(g, "exponential", "gap")
    scored = fam.score(g.crossJoin(F.broadcast(beta)), "exponential", "gap")
    return scored.agg(F.count("*").alias("n"), F.round(F.avg("gap"), 3).alias("beta"), F.round(F.avg("ll"), 6).alias("mean_ll"))


@query("inhomogeneous_poisson", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(count(*) * 1.0 / (SELECT count(DISTINCT user_id) FROM events), 6) AS rate FROM events GROUP BY 1")
def inhomogeneous_poisson(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    users = rows.agg(F.count_distinct("user_id").alias("u"))
    return rounded(rows.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(users)).select("hour", "n", (F.col("n") / F.col("u")).alias("rate")))


@query("periodic_time_von_mises", "WITH p AS (SELECT 2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000 AS a, event_type FROM events), s AS (SELECT event_type, count(*) AS n, sum(cos(a)) AS c, sum(sin(a)) AS s FROM p GROUP BY 1), r AS (SELECT event_type, atan2(s, c) AS mu, sqrt(c * c + s * s) / n AS r FROM s) SELECT event_type, round(mu, 5) AS mu, round(2 * r + pow(r, 3) + 5 * pow(r, 5) / 6, 5) AS kappa FROM r")
def periodic_time_von_mises(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.expr("2 * pi() * pmod(unix_micros(cast(ts as timestamp)), 86400000000) / 86400000000").alias("a"))
    return rounded(fam.fit(rows, "von_mises", "a", ["event_type"]), 5)


@query("impute_conditional", "WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY 1, 2) SELECT l.l_returnflag, l.l_linestatus, count(*) AS n, round(avg(CASE WHEN l_orderkey % 17 = 0 THEN m.m ELSE l_quantity END), 6) AS mean_quantity FROM lineitem l JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2")
def impute_conditional(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus", "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS q")
    means = rows.groupBy("l_returnflag", "l_linestatus").agg(F.avg("q").alias("m"))
    return rounded(rows.join(F.broadcast(means), ["l_returnflag", "l_linestatus"]).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg(F.coalesce("q", "m")).alias("mean_quantity")))


@query("transform_score", "SELECT l_returnflag, round(avg(-0.5 * ln(2 * pi() * 0.5) - pow(ln(l_extendedprice) - 10, 2) - ln(l_extendedprice)), 6) AS exp_ll, round(avg(-ln(2.0) - (0.5 * ln(2 * pi()) + pow((l_quantity - 25) / 2, 2) / 2)), 6) AS affine_ll, round(avg(-0.5 * ln(2 * pi()) - pow(ln((l_quantity / 51) / (1 - l_quantity / 51)), 2) / 2 - ln(l_quantity / 51) - ln(1 - l_quantity / 51)), 6) AS logistic_ll FROM lineitem GROUP BY 1")
def transform_score(spark, sf_dir):
    def normal(sigma2: float, mu: float = 0.0):
        return lambda y: fam.FAMILIES["gaussian"].logpdf(y, {"mu": F.lit(mu), "sigma2": F.lit(sigma2)})

    rows = table(spark, sf_dir, "lineitem")
    lls = {
        "exp_ll": cb.transformed_logpdf(F.col("l_extendedprice"), "exp", normal(0.5, 10.0)),
        "affine_ll": cb.transformed_logpdf(F.col("l_quantity"), "affine", normal(1.0), 25.0, 2.0),
        "logistic_ll": cb.transformed_logpdf(F.col("l_quantity") / 51, "logistic", normal(1.0)),
    }
    return rounded(rows.groupBy("l_returnflag").agg(*[F.avg(c).alias(k) for k, c in lls.items()]))


@query("tilted_categorical", "WITH c AS (SELECT l_linenumber AS level, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1) SELECT level, round(p * exp(0.4 * level) / (SELECT sum(p * exp(0.4 * level)) FROM c), 6) AS p FROM c")
def tilted_categorical(spark, sf_dir):
    model = fam.fit_categorical(table(spark, sf_dir, "lineitem"), "l_linenumber")
    return rounded(cb.tilted(model, "level", "p", F.col("level"), 0.4))
