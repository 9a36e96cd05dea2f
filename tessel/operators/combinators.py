"""Models built of models: composite records, conditionals, mixtures, optional values, routes, truncation, sequences."""

from __future__ import annotations

from collections.abc import Callable

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.special import NEG_INF, log_of, log_sum_exp
from tessel.operators.families import FAMILIES, Family
from tessel.sources.shared import written

#: Keys of a conditional model up to which it is sent to every task.
SENT_KEYS = 100_000


@dataclass(frozen=True)
class Leaf:
    """A family on one column; weights for each component come from outside."""

    family: str
    column: str

    @property
    def rules(self) -> Family:
        return FAMILIES[self.family]


@dataclass(frozen=True)
class Categories:
    """A categorical leaf over known levels."""

    column: str
    levels: tuple


Record = list[Leaf | Categories]


def record_sums(record: Record, weight: Column, prefix: str) -> list[Column]:
    """All weighted sums that the leaves of a record need, as one list of aggregates."""
    out = [F.sum(weight).alias(f"{prefix}w")]
    for i, leaf in enumerate(record):
        if isinstance(leaf, Leaf):
            x = F.col(leaf.column).cast("double")
            w = F.when(x.isNotNull(), weight).otherwise(0.0)
            out += [c.alias(f"{prefix}{i}_{k}") for k, c in leaf.rules.stats(F.coalesce(x, F.lit(0.0)), w).items()]
        else:
            out += [F.sum(F.when(F.col(leaf.column) == F.lit(v), weight).otherwise(0.0)).alias(f"{prefix}{i}_{k}") for k, v in enumerate(leaf.levels)]
    return out


def record_params(record: Record, prefix: str) -> list[Column]:
    """Parameters of the leaves from `record_sums`, as columns named prefix, leaf, parameter."""
    out = []
    for i, leaf in enumerate(record):
        if isinstance(leaf, Leaf):
            names = leaf.rules.stats(F.lit(0.0), F.lit(0.0))
            solved = leaf.rules.solve({k: F.col(f"{prefix}{i}_{k}") for k in names})
            out += [solved[k].cast("double").alias(f"{prefix}{i}_p_{k}") for k in leaf.rules.params]
        else:
            total = sum((F.col(f"{prefix}{i}_{k}") for k in range(len(leaf.levels))), F.lit(0.0))
            out += [(F.col(f"{prefix}{i}_{k}") / total).alias(f"{prefix}{i}_p_{k}") for k in range(len(leaf.levels))]
    return out


def record_logpdf(record: Record, params: dict[str, Column]) -> Column:
    """Sum of the leaves' log-densities; a null leaf is marginalised (adds 0). Keys: leaf number, '_', parameter."""
    total = F.lit(0.0)
    for i, leaf in enumerate(record):
        if isinstance(leaf, Leaf):
            x = F.col(leaf.column).cast("double")
            ll = leaf.rules.logpdf(x, {k: params[f"{i}_{k}"] for k in leaf.rules.params})
        else:
            x = F.col(leaf.column)
            ll = F.lit(NEG_INF)
            for k, v in enumerate(leaf.levels):
                ll = F.when(x == F.lit(v), log_of(params[f"{i}_{k}"])).otherwise(ll)
        total = total + F.when(x.isNull(), 0.0).otherwise(ll)
    return total


def fit_conditional(df: DataFrame, key: str, record: Record) -> DataFrame:
    """One record model per key, in one aggregation: key, its share, and the leaves' parameters."""
    sums = df.groupBy(key).agg(F.count("*").alias("n"), *record_sums(record, F.lit(1.0), "m"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return sums.select(key, "n", share.alias("share"), *record_params(record, "m"))


def score_conditional(df: DataFrame, model: DataFrame, key: str, record: Record, name: str = "ll") -> DataFrame:
    """Log-density of each row given its key; keys that the model lacks get -infinity. The model has a row per key.

    Up to `SENT_KEYS` keys go to the rows, so that a frequent key's rows are not gathered in one task.
    """
    model = written(model)
    if model.count() <= SENT_KEYS:
        model = F.broadcast(model)
    cols = {f"{i}_{k}": F.col(f"m{i}_p_{k}") for i, leaf in enumerate(record) for k in (leaf.rules.params if isinstance(leaf, Leaf) else range(len(leaf.levels)))}
    joined = df.join(model.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left")
    return joined.withColumn(name, F.when(F.col("_key").isNull(), F.lit(NEG_INF)).otherwise(record_logpdf(record, cols))).select(*df.columns, name)


@dataclass
class Mixture:
    """Weights and, per component, parameters keyed by leaf number, '_', parameter."""

    record: Record
    weights: list[float]
    params: list[dict[str, float]]

    def component_terms(self) -> list[Column]:
        return [F.lit(math.log(w) if w > 0 else NEG_INF) + record_logpdf(self.record, {k: F.lit(v) for k, v in p.items()}) for w, p in zip(self.weights, self.params, strict=True)]

    def score(self, df: DataFrame, name: str = "ll") -> DataFrame:
        return df.withColumn(name, log_sum_exp(*self.component_terms()))

    def posterior(self, df: DataFrame, name: str = "posterior") -> DataFrame:
        """Array of component probabilities; a row impossible under all gets the weights."""
        terms = self.component_terms()
        total = log_sum_exp(*terms)
        probs = [F.when(total == NEG_INF, F.lit(w)).otherwise(F.exp(t - total)) for t, w in zip(terms, self.weights, strict=True)]
        return df.withColumn(name, F.array(*probs))

    def classify(self, df: DataFrame, name: str = "component") -> DataFrame:
        terms = self.component_terms()
        best = F.greatest(*terms)
        pick = F.lit(len(terms) - 1)
        for k in range(len(terms) - 2, -1, -1):
            pick = F.when(terms[k] == best, k).otherwise(pick)
        return df.withColumn(name, pick)


def em_step(df: DataFrame, model: Mixture, how: str = "soft", temperature: float = 1.0) -> tuple[Mixture, float]:
    """One pass: responsibilities, all components' sums and the log-likelihood in a single aggregation.

    how: soft (ordinary), hard (winner takes all) or annealed (terms divided by `temperature`).
    """
    k = len(model.weights)
    terms = model.component_terms()
    named = df.select("*", *[t.alias(f"_t{i}") for i, t in enumerate(terms)])
    cols = [F.col(f"_t{i}") for i in range(k)]
    total = log_sum_exp(*cols)
    if how == "hard":
        best = F.greatest(*cols)
        resp, taken = [], F.lit(False)
        for c in cols:
            resp.append(F.when((c == best) & ~taken, 1.0).otherwise(0.0))
            taken = taken | (c == best)
    else:
        cooled = [c / temperature for c in cols]
        norm = log_sum_exp(*cooled)
        resp = [F.when(norm == NEG_INF, F.lit(w)).otherwise(F.exp(c - norm)) for c, w in zip(cooled, model.weights, strict=True)]
    with_r = named.select("*", total.alias("_ll"), *[r.alias(f"_r{i}") for i, r in enumerate(resp)])
    aggs = [F.sum("_ll").alias("ll")]
    for i in range(k):
        aggs += record_sums(model.record, F.col(f"_r{i}"), f"c{i}_")
    table = with_r.agg(*aggs)
    solved = table.select("ll", *[f"c{i}_w" for i in range(k)], *[c for i in range(k) for c in record_params(model.record, f"c{i}_")]).head().asDict()
    mass = sum(solved[f"c{i}_w"] for i in range(k))
    params = []
    for i in range(k):
        start = f"c{i}_"
        params.append({key[len(start) :].replace("_p_", "_", 1): v for key, v in solved.items() if key.startswith(start) and "_p_" in key})
    return Mixture(model.record, [solved[f"c{i}_w"] / mass for i in range(k)], params), solved["ll"]


def fit_mixture(df: DataFrame, start: Mixture, iterations: int = 20, tolerance: float = 1e-6, how: str = "soft") -> tuple[Mixture, list[float]]:
    """EM from a start model; the data are cached once, every iteration is one aggregation over them."""
    rows = df.cache()
    model, trace = start, []
    for i in range(iterations):
        temperature = max(1.0, 4.0 * 0.7**i) if how == "annealed" else 1.0
        model, ll = em_step(rows, model, how, temperature)
        trace.append(ll)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]) and temperature == 1.0:
            break
    rows.unpersist()
    return model, trace


def optional_logpdf(x: Column, child: Column, p_missing: float | None) -> Column:
    """Missing: ln p (or 0 when the rate isn't modelled); present: child (+ ln(1 - p))."""
    if p_missing is None:
        return F.when(x.isNull(), 0.0).otherwise(child)
    return F.when(x.isNull(), log_of(F.lit(p_missing))).otherwise(child + log_of(F.lit(1 - p_missing)))


def hurdle_logpdf(x: Column, child: Column, child_at_zero: Column, p_zero: Column) -> Column:
    return F.when(x == 0, log_of(p_zero)).otherwise(log_of(1 - p_zero) + child - F.log1p(-F.exp(child_at_zero)))


def zero_inflated_logpdf(x: Column, child: Column, child_at_zero: Column, p_zero: Column) -> Column:
    return F.when(x == 0, log_sum_exp(log_of(p_zero), log_of(1 - p_zero) + child_at_zero)).otherwise(log_of(1 - p_zero) + child)


def truncated(df: DataFrame, level: str, p: str, allowed: list) -> DataFrame:
    """Restrict a table of level probabilities to the allowed levels and renormalise by the kept mass."""
    kept = df.where(F.col(level).isin(allowed))
    total = kept.agg(F.sum(p).alias("_z"))
    return kept.crossJoin(F.broadcast(total)).select(level, (F.col(p) / F.col("_z")).alias(p))


def bernoulli_set(df: DataFrame, key: str, member: str) -> DataFrame:
    """(member, p): share of the keys whose set holds the member."""
    sets = df.select(key, member).distinct()
    total = sets.agg(F.count_distinct(key).alias("_n"))
    return sets.groupBy(member).agg(F.count("*").alias("_c")).crossJoin(F.broadcast(total)).select(member, (F.col("_c") / F.col("_n")).alias("p"))


def bernoulli_set_score(df: DataFrame, model: DataFrame, key: str, member: str) -> DataFrame:
    """(key, ll): sum over all members of ln(1-p), plus log odds of those present."""
    base = model.agg(F.sum(F.when(F.col("p") < 1, F.ln(1 - F.col("p"))).otherwise(0.0)).alias("base"), F.count_if(F.col("p") >= 1).alias("must"))
    odds = F.when(F.col("p") < 1, F.ln(F.col("p") / (1 - F.col("p")))).otherwise(0.0)
    got = df.select(key, member).distinct().join(F.broadcast(model), member).groupBy(key).agg(F.sum(odds).alias("o"), F.count_if(F.col("p") >= 1).alias("have"))
    return got.crossJoin(F.broadcast(base)).select(key, F.when(F.col("have") < F.col("must"), F.lit(NEG_INF)).otherwise(F.col("base") + F.col("o")).alias("ll"))


def markov_chain(df: DataFrame, key: str, order: list[str], state: str) -> tuple[DataFrame, DataFrame]:
    """(state, p) of first states and (prev, state, n, p) of transitions, from rows of sequences."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = df.select(key, F.col(state).alias("state"), F.lag(state).over(w).alias("prev"))
    first = steps.where("prev is null").groupBy("state").agg(F.count("*").alias("n"))
    init = first.select("state", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    moves = steps.where("prev is not null").groupBy("prev", "state").agg(F.count("*").alias("n"))
    return init, moves.select("prev", "state", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("prev"))).alias("p"))


def markov_score(df: DataFrame, init: DataFrame, moves: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(key, n, ll) per sequence; the parameter tables have a row per state or pair of states."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = df.select(key, F.col(state).alias("state"), F.lag(state).over(w).alias("prev"))
    a = init.select(F.col("state").alias("i_state"), F.col("p").alias("pi"))
    b = moves.select(F.col("prev").alias("m_prev"), F.col("state").alias("m_state"), F.col("p").alias("pm"))
    j = steps.join(F.broadcast(a), (F.col("state") == F.col("i_state")) & F.col("prev").isNull(), "left").join(F.broadcast(b), (F.col("prev") == F.col("m_prev")) & (F.col("state") == F.col("m_state")), "left")
    p = F.coalesce(F.when(F.col("prev").isNull(), F.col("pi")).otherwise(F.col("pm")), F.lit(0.0))
    return j.groupBy(key).agg(F.count("*").alias("n"), F.sum(log_of(p)).alias("ll"))


def ctmc_rates(df: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """(state, next, n, dwell, rate): moves over time spent, for paths of (time, state) rows; `time` in seconds."""
    w = Window.partitionBy(key).orderBy(time, state)
    steps = df.select(F.col(state).alias("state"), F.lead(state).over(w).alias("next"), (F.lead(time).over(w) - F.col(time)).alias("dt")).where("next is not null")
    dwell = steps.groupBy("state").agg(F.sum("dt").alias("dwell"))
    moves = steps.where("state <> next").groupBy("state", "next").agg(F.count("*").alias("n"))
    return moves.join(dwell, "state").select("state", "next", "n", "dwell", (F.col("n") / F.col("dwell")).alias("rate"))


def gaps(df: DataFrame, key: str, time: str) -> DataFrame:
    """(key, gap) between successive times of each key."""
    w = Window.partitionBy(key).orderBy(time)
    return df.select(key, (F.col(time) - F.lag(time).over(w)).alias("gap")).where("gap is not null")


#: Maps y -> x of a change of variables, with ln |dy/dx| at x; parameters are a shift and a scale where there are any.
_MAPS = {
    "affine": (lambda x, a, b: (x - a) / b, lambda x, a, b: -F.ln(F.abs(b)), lambda x: F.lit(True)),
    "log": (lambda x, a, b: F.exp(x), lambda x, a, b: x, lambda x: F.lit(True)),
    "exp": (lambda x, a, b: F.ln(x), lambda x, a, b: -F.ln(x), lambda x: x > 0),
    "logistic": (lambda x, a, b: F.ln(x / (1 - x)), lambda x, a, b: -F.ln(x) - F.ln(1 - x), lambda x: (x > 0) & (x < 1)),
}


def transformed_logpdf(x: Column, how: str, child: Callable[[Column], Column], shift: float = 0.0, scale: float = 1.0) -> Column:
    """Log-density of a variable made from the child's by a map (x = a + b y, ln y, exp y or 1 / (1 + exp(-y))); -infinity outside its range."""
    back, jacobian, inside = _MAPS[how]
    a, b = F.lit(float(shift)), F.lit(float(scale))
    safe = F.when(inside(x), x)
    return F.coalesce(child(back(safe, a, b)) + jacobian(safe, a, b), F.lit(float("-inf")))


def tilted(df: DataFrame, level: str, p: str, statistic: Column, theta: float) -> DataFrame:
    """(level, p): a discrete distribution reweighted by exp(theta x statistic) and scaled to 1 again.

    The largest exponent is taken off first, so no weight overflows.
    """
    rows = df.select(F.col(level).alias("level"), (F.ln(F.col(p)) + theta * statistic).alias("_e")).where(F.col("_e") > float("-inf"))
    top = rows.agg(F.max("_e").alias("_top"))
    rows = rows.crossJoin(F.broadcast(top)).select("level", F.exp(F.col("_e") - F.col("_top")).alias("_w"))  # a single row
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("_w").alias("_z")))).select("level", (F.col("_w") / F.col("_z")).alias("p"))
