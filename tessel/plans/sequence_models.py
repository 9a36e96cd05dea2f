"""Hidden Markov models, state spaces and self-exciting processes over the event streams of users."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessel.operators import hawkes as hk
from tessel.operators import hidden_markov as hm
from tessel.operators import state_space as ss
from tessel.plans.base import query, rounded, table

# Two states of users: values are exponential with mean 40 in one, normal about 70 in the other.
_INIT, _MOVES = np.array([0.55, 0.45]), np.array([[0.85, 0.15], [0.25, 0.75]])
_VALUES = hm.FamilyEmission(["exponential", "gaussian"], [{"beta": 40.0}, {"mu": 70.0, "sigma2": 900.0}])
_STEPS = "o AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, -ln(40) - value / 40 AS e0, -0.5 * ln(2 * pi() * 900) - pow(value - 70, 2) / 1800 AS e1 FROM events)"
_LSE = "greatest({0}, {1}) + ln(1 + exp(-abs(({0}) - ({1}))))"
_F0, _F1 = _LSE.format("a0 + ln(0.85)", "a1 + ln(0.25)"), _LSE.format("a0 + ln(0.15)", "a1 + ln(0.75)")
_FORWARD = f"f AS (SELECT k, t, ln(0.55) + e0 AS a0, ln(0.45) + e1 AS a1 FROM o WHERE t = 1 UNION ALL SELECT o.k, o.t, {_F0} + o.e0, {_F1} + o.e1 FROM f JOIN o ON o.k = f.k AND o.t = f.t + 1)"
_B0, _B1 = _LSE.format("ln(0.85) + e0 + b0", "ln(0.15) + e1 + b1"), _LSE.format("ln(0.25) + e0 + b0", "ln(0.75) + e1 + b1")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value"


@query("hmm_forward", f"WITH RECURSIVE {_STEPS}, {_FORWARD}, n AS (SELECT k, max(t) AS n FROM o GROUP BY 1) SELECT k AS user_id, n, round({_LSE.format('a0', 'a1')}, 6) AS ll FROM f JOIN n USING (k) WHERE t = n")
def hmm_forward(spark, sf_dir):
    return rounded(hm.forward(*_events(spark, sf_dir), _VALUES, _INIT, _MOVES))


@query("hmm_posterior", f"""WITH RECURSIVE {_STEPS}, {_FORWARD}, n AS (SELECT k, max(t) AS n FROM o GROUP BY 1),
b AS (SELECT k, n AS t, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM n UNION ALL SELECT o.k, o.t - 1, {_B0}, {_B1} FROM b JOIN o ON o.k = b.k AND o.t = b.t WHERE o.t > 1)
SELECT k AS user_id, round(sum(1 / (1 + exp(a0 + b0 - a1 - b1))), 5) AS second_state FROM f JOIN b USING (k, t) GROUP BY 1""")
def hmm_posterior(spark, sf_dir):
    """The expected number of a user's events in the second state."""
    return rounded(hm.smooth(*_events(spark, sf_dir), _VALUES, _INIT, _MOVES).groupBy("user_id").agg(F.sum(F.col("gamma")[1]).alias("second_state")), 5)


# Types of events: as frequent as they are in one state, alike in the other. The path's length in the second state is carried along.
_TYPES = "p AS (SELECT event_type, count(*) * 1.0 / sum(count(*)) OVER () AS p0, CASE WHEN event_type IN ('error', 'signup') THEN 0.35 ELSE 0.1 END AS p1 FROM events GROUP BY 1), o AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, ln(p0) AS e0, ln(p1) AS e1 FROM events JOIN p USING (event_type))"
_TO0, _TO1 = "a0 + ln(0.85) >= a1 + ln(0.25)", "a0 + ln(0.15) >= a1 + ln(0.75)"


@query("hmm_viterbi", f"""WITH RECURSIVE {_TYPES}, v AS (SELECT k, t, ln(0.55) + e0 AS a0, ln(0.45) + e1 AS a1, 0 AS c0, 1 AS c1 FROM o WHERE t = 1
UNION ALL SELECT o.k, o.t, greatest(a0 + ln(0.85), a1 + ln(0.25)) + o.e0, greatest(a0 + ln(0.15), a1 + ln(0.75)) + o.e1, CASE WHEN {_TO0} THEN c0 ELSE c1 END, 1 + CASE WHEN {_TO1} THEN c0 ELSE c1 END FROM v JOIN o ON o.k = v.k AND o.t = v.t + 1),
n AS (SELECT k, max(t) AS n FROM o GROUP BY 1) SELECT k AS user_id, n, CAST(CASE WHEN a0 >= a1 THEN c0 ELSE c1 END AS BIGINT) AS second_state FROM v JOIN n USING (k) WHERE t = n""")
def hmm_viterbi(spark, sf_dir):
    """Events of each user, and those in the second state of the likeliest path; symbols' probabilities come from a joined table."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rare = F.when(F.col("symbol").isin("error", "signup"), 0.35).otherwise(0.1)
    symbols = counts.crossJoin(F.broadcast(total)).select("symbol", F.array(F.col("n") / F.col("total"), rare).alias("p"))
    paths = hm.viterbi(hm.scores_by_join(events, "event_type", symbols), "user_id", ["ts", "event_id"], "scores", None, _INIT, _MOVES)
    return paths.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("state").alias("second_state"))


@query("hmm_baum_welch")
def hmm_baum_welch(spark, sf_dir):
    """Three steps of EM for a state of exponential and one of normal values."""
    emission, init, moves, trace = hm.baum_welch(*_events(spark, sf_dir), _VALUES, _INIT, _MOVES, 3)
    rows = [("ll", i, float(v)) for i, v in enumerate(trace)] + [("init", i, float(v)) for i, v in enumerate(init)] + [("moves", i, float(v)) for i, v in enumerate(moves.ravel())]
    rows += [(f"state {i}: {k}", 0, float(v)) for i, p in enumerate(emission.params) for k, v in p.items()]
    return rounded(spark.createDataFrame(rows, "name string, i int, v double"), 4)


_LEVEL = "o AS (SELECT user_id AS k, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events), f AS (SELECT k, t, 50 + 510.0 / 2510 * (y - 50) AS m, 510 - 510 * 510.0 / 2510 AS p, 50.0::DOUBLE AS mp, 510.0::DOUBLE AS pp, -0.5 * (ln(2 * pi() * 2510) + pow(y - 50, 2) / 2510) AS ll FROM o WHERE t = 1 UNION ALL SELECT o.k, o.t, f.m + (f.p + 10) / (f.p + 2010) * (o.y - f.m), (f.p + 10) * (1 - (f.p + 10) / (f.p + 2010)), f.m, f.p + 10, -0.5 * (ln(2 * pi() * (f.p + 2010)) + pow(o.y - f.m, 2) / (f.p + 2010)) FROM f JOIN o ON o.k = f.k AND o.t = f.t + 1)"


@query("local_level_filter", f"WITH RECURSIVE {_LEVEL} SELECT k AS user_id, count(*) AS n, round(sum(ll), 6) AS ll, round(arg_max(m, t), 6) AS last FROM f GROUP BY 1")
def local_level_filter(spark, sf_dir):
    got = ss.kalman_filter(*_events(spark, sf_dir), ss.local_level(10.0, 2000.0, 50.0, 500.0))
    return rounded(got.select("user_id", "n", "ll", F.col("mean")[0].alias("last")))


@query("local_level_smoother", f"""WITH RECURSIVE {_LEVEL}, n AS (SELECT k, max(t) AS t FROM f GROUP BY 1),
s AS (SELECT k, t, m AS x, p AS v FROM f JOIN n USING (k, t) UNION ALL SELECT f.k, f.t, f.m + f.p / (f.p + 10) * (s.x - f.m), f.p + pow(f.p / (f.p + 10), 2) * (s.v - f.p - 10) FROM s JOIN f ON f.k = s.k AND f.t = s.t - 1)
SELECT k AS user_id, round(arg_min(x, t), 6) AS first_level, round(arg_min(v, t), 6) AS first_variance, round(avg(x), 6) AS mean_level FROM s GROUP BY 1""")
def local_level_smoother(spark, sf_dir):
    got = ss.kalman_smoother(*_events(spark, sf_dir), ss.local_level(10.0, 2000.0, 50.0, 500.0))
    first = F.min_by(F.struct(F.col("mean")[0].alias("m"), F.col("spread")[0].alias("v")), "t")
    return rounded(got.groupBy("user_id").agg(first.alias("f"), F.avg(F.col("mean")[0]).alias("mean_level")).select("user_id", F.col("f.m").alias("first_level"), F.col("f.v").alias("first_variance"), "mean_level"))


@query("trend_season_forecast")
def trend_season_forecast(spark, sf_dir):
    """Events of each type and day as level, trend and a weekly pattern: log-likelihood and the next three days."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    model = ss.structural(4.0, 0.01, 40.0, [60.0, 0.0], 900.0, season=7, q_season=1.0)
    got = ss.forecast(ss.kalman_filter(days, "event_type", ["day"], "n", model), model, 3)
    return rounded(got.select("event_type", "n", "ll", *[F.col("forecast")[i].alias(f"day_{i + 1}") for i in range(3)]), 5)


@query("autoregression_fit")
def autoregression_fit(spark, sf_dir):
    """EM for an autoregressive state that all users share."""
    phi, q, r, mean, trace = ss.fit_autoregression(*_events(spark, sf_dir), steps=4, start=(100.0, 2000.0, 50.0, 500.0))
    return rounded(spark.createDataFrame([(phi, q, r, mean, trace[0], trace[-1])], "phi double, q double, r double, mean double, first_ll double, last_ll double"), 4)


def _days(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6
    rows = table(spark, sf_dir, "events").select("user_id", t.alias("t"), F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0).alias("kind"))
    start = rows.agg(F.floor(F.min("t")).alias("t0"))
    return rows.crossJoin(F.broadcast(start)).select("user_id", (F.col("t") - F.col("t0")).alias("t"), "kind")


_TIMES = "d AS (SELECT user_id AS k, epoch_us(ts) / 86400e6 - (SELECT floor(min(epoch_us(ts) / 86400e6)) FROM events) AS t, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS c FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, c) AS i FROM d)"


def _hawkes_sql(step: int) -> str:
    """One step of EM after the parameters of CTE q{step - 1} (mu, a, b)."""
    p = f"q{step - 1}"
    return f"""h{step} AS (SELECT e.k, e.i, coalesce(sum(exp(-(SELECT b FROM {p}) * (e.t - x.t))), 0) AS r, coalesce(sum((e.t - x.t) * exp(-(SELECT b FROM {p}) * (e.t - x.t))), 0) AS s FROM e LEFT JOIN e x ON x.k = e.k AND x.i < e.i GROUP BY 1, 2),
g{step} AS (SELECT sum(mu / (mu + a * r)) AS own, sum(a * r / (mu + a * r)) AS kids, sum(a * s / (mu + a * r)) AS wait, count(*) AS n, count(DISTINCT k) AS k FROM h{step}, {p}),
q{step} AS (SELECT own / (31 * k) AS mu, kids / wait AS b, kids / wait * least(greatest(kids / n, 1e-6), 0.999) AS a FROM g{step})"""


@query("hawkes_loglik", f"WITH {_TIMES}, r AS (SELECT e.k, e.i, any_value(e.t) AS t, coalesce(sum(exp(-2 * (e.t - x.t))), 0) AS r FROM e LEFT JOIN e x ON x.k = e.k AND x.i < e.i GROUP BY 1, 2) SELECT k AS user_id, count(*) AS n, round(sum(ln(1.0 + 0.5 * r) - 0.25 * (1 - exp(-2 * (31 - t)))) - 31, 6) AS ll FROM r GROUP BY 1")
def hawkes_loglik(spark, sf_dir):
    return rounded(hk.loglik(_days(spark, sf_dir), "user_id", "t", hk.exponential(1.0, 0.5, 2.0), 31.0))


@query("hawkes_fit", f"WITH {_TIMES}, q0 AS (SELECT 1.0 AS mu, 0.5 AS a, 2.0 AS b), {_hawkes_sql(1)}, {_hawkes_sql(2)}, {_hawkes_sql(3)} SELECT round(mu, 6) AS mu, round(a, 6) AS alpha, round(b, 6) AS beta FROM q3")
def hawkes_fit(spark, sf_dir):
    return rounded(spark.createDataFrame([hk.fit_by_branching(_days(spark, sf_dir), "user_id", "t", 31.0, 3, (1.0, 0.5, 2.0))], "mu double, alpha double, beta double"))


_PAIR = "CASE WHEN e.c = 0 THEN CASE WHEN x.c = 0 THEN 0.3 ELSE 0.1 END ELSE CASE WHEN x.c = 0 THEN 0.2 ELSE 0.4 END END"


@query("multivariate_hawkes_loglik", f"WITH {_TIMES}, r AS (SELECT e.k, e.i, any_value(e.t) AS t, any_value(e.c) AS c, coalesce(sum({_PAIR} * exp(-1.5 * (e.t - x.t))), 0) AS r FROM e LEFT JOIN e x ON x.k = e.k AND x.i < e.i GROUP BY 1, 2) SELECT k AS user_id, count(*) AS n, round(sum(ln(CASE WHEN c = 0 THEN 1.2 ELSE 0.8 END + r) - 0.5 * (1 - exp(-1.5 * (31 - t))) / 1.5) - 62, 6) AS ll FROM r GROUP BY 1")
def multivariate_hawkes_loglik(spark, sf_dir):
    model = hk.exponential([1.2, 0.8], [[0.3, 0.1], [0.2, 0.4]], 1.5)
    return rounded(hk.loglik(_days(spark, sf_dir), "user_id", "t", model, 31.0, "kind"))


@query("multivariate_hawkes_fit")
def multivariate_hawkes_fit(spark, sf_dir):
    """Three steps of EM for two types of events."""
    model, trace = hk.fit(_days(spark, sf_dir), "user_id", "t", hk.exponential([1.2, 0.8], [[0.3, 0.1], [0.2, 0.4]], 1.5), 31.0, 3, "kind")
    rows = [(i, j, float(model.mu[i]), float(model.alpha[i, j]), float(model.decays[0]), float(trace[-1])) for i in range(2) for j in range(2)]
    return rounded(spark.createDataFrame(rows, "excited int, by int, mu double, alpha double, beta double, ll double"), 5)


@query("power_law_hawkes_loglik", f"WITH {_TIMES}, r AS (SELECT e.k, e.i, any_value(e.t) AS t, coalesce(sum(0.2 * pow(e.t - x.t + 0.1, -1.5)), 0) AS r FROM e LEFT JOIN e x ON x.k = e.k AND x.i < e.i GROUP BY 1, 2) SELECT k AS user_id, count(*) AS n, round(sum(ln(1.0 + r) - 0.4 * (pow(0.1, -0.5) - pow(31.1 - t, -0.5))) - 31, 5) AS ll FROM r GROUP BY 1")
def power_law_hawkes_loglik(spark, sf_dir):
    """The kernel 0.2 (t + 0.1)^-1.5 as forty exponentials, within 1e-9 of it up to the length of the window."""
    return rounded(hk.loglik(_days(spark, sf_dir), "user_id", "t", hk.power_law(1.0, 0.2, 0.1, 1.5, 31.0), 31.0), 5)
