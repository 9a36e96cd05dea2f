"""Compound and heavy-tailed families, mixtures with partly known components, and paired comparisons with ties."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessel.functions.special import NEG_INF, lgamma, log_sum_exp
from tessel.operators import topics
from tessel.operators.combinators import Mixture, record_params, record_sums
from tessel.sources.shared import written


@F.pandas_udf(DoubleType())
def _rise(count: pd.Series, alpha: pd.Series) -> pd.Series:
    """digamma(count + alpha) - digamma(alpha)."""
    a = alpha.to_numpy(float)
    return pd.Series(topics.digamma(count.to_numpy(float) + a) - topics.digamma(a))


def _bags(df: DataFrame, key: str, level: str, count: str) -> DataFrame:
    rows = df.select(F.col(key).alias("k"), F.col(level).alias("level"), F.col(count).cast("long").alias("c"))
    return rows.where("k IS NOT NULL AND level IS NOT NULL AND c > 0").groupBy("k", "level").agg(F.sum("c").alias("c"))


def fit_dirichlet_multinomial(df: DataFrame, key: str, level: str, count: str, steps: int = 50) -> DataFrame:
    """(level, alpha) of bags (key, level, count), from alpha 1 each, by Minka's fixed point.

    Steps see the bags only through how often each (level, count) and each bag size occurs.
    """
    rows = _bags(df, key, level, count)
    cells = written(rows.groupBy("level", "c").agg(F.count("*").alias("m")))
    sizes = written(rows.groupBy("k").agg(F.sum("c").alias("c")).groupBy("c").agg(F.count("*").alias("m")))
    alpha = written(cells.select("level").distinct().withColumn("alpha", F.lit(1.0)))
    for _ in range(steps):
        whole = alpha.agg(F.sum("alpha")).head()[0]
        if whole is None:
            break
        below = sizes.agg(F.sum(F.col("m") * _rise(F.col("c").cast("double"), F.lit(float(whole))))).head()[0]
        above = cells.join(alpha, "level").groupBy("level").agg(F.sum(F.col("m") * _rise(F.col("c").cast("double"), F.col("alpha"))).alias("up"), F.first("alpha").alias("alpha"))
        alpha = written(above.select("level", (F.col("alpha") * F.col("up") / float(below)).alias("alpha")), instead=alpha)
    return alpha


def score_dirichlet_multinomial(df: DataFrame, key: str, level: str, count: str, alpha: DataFrame) -> DataFrame:
    """(key, n, ll): log-probability of each bag given its size, coefficient included; unknown levels give -infinity."""
    whole = float(alpha.agg(F.sum("alpha")).head()[0] or 0.0)
    met = _bags(df, key, level, count).join(alpha, "level", "left")
    one = F.when(F.col("alpha").isNull(), F.lit(NEG_INF)).otherwise(lgamma(F.col("c") + F.col("alpha")) - lgamma(F.col("alpha")) - lgamma(F.col("c") + 1.0))
    per = met.groupBy("k").agg(F.sum("c").alias("n"), F.sum(one).alias("s"))
    return per.select(F.col("k").alias(key), "n", (F.col("s") + lgamma(F.col("n") + 1.0) + math.lgamma(whole) - lgamma(F.col("n") + whole)).alias("ll"))


def _distance(columns: list[Column], mean: np.ndarray, shape: np.ndarray) -> Column:
    inverse = np.linalg.inv(shape)
    d = [c - float(m) for c, m in zip(columns, mean, strict=True)]
    return sum((float(inverse[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))


def student_t_step(df: DataFrame, columns: list[str], dof: float, mean: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of EM for a multivariate Student t of known degrees of freedom: one aggregation of weighted moments."""
    d, x = len(columns), [F.col(c).cast("double") for c in columns]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).withColumn("_u", (dof + d) / (dof + _distance(x, mean, shape)))
    u, upper = F.col("_u"), [(i, j) for i in range(d) for j in range(i, d)]
    # Moments about the old mean, so large offsets don't cancel.
    e = [c - float(m) for c, m in zip(x, mean, strict=True)]
    s = rows.agg(F.count("*").alias("n"), F.sum(u).alias("u"), *[F.sum(u * c).alias(f"s{i}") for i, c in enumerate(e)], *[F.sum(u * e[i] * e[j]).alias(f"q{i}_{j}") for i, j in upper]).head()
    if not s.n:
        return mean, shape
    move = np.array([s[f"s{i}"] for i in range(d)]) / s.u
    out = np.zeros((d, d))
    for i, j in upper:
        out[i, j] = out[j, i] = (s[f"q{i}_{j}"] - s.u * move[i] * move[j]) / s.n
    return mean + move, out


def fit_student_t(df: DataFrame, columns: list[str], dof: float, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(location, shape matrix), from the rows' mean and covariance on."""
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    s = whole.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"v{i}_{j}") for i, j in pairs]).head()
    mean = np.array([s[f"m{i}"] for i in range(len(columns))], float)
    shape = np.array([s[f"v{i}_{j}"] for i, j in pairs], float).reshape(len(columns), -1)
    for _ in range(steps):
        mean, shape = student_t_step(whole, columns, dof, mean, shape)
    return mean, shape


def student_t_logpdf(columns: list[str], dof: float, mean: np.ndarray, shape: np.ndarray) -> Column:
    d = len(columns)
    constant = math.lgamma((dof + d) / 2) - math.lgamma(dof / 2) - 0.5 * d * math.log(dof * math.pi) - 0.5 * float(np.linalg.slogdet(shape)[1])
    return constant - (dof + d) / 2 * F.log1p(_distance([F.col(c).cast("double") for c in columns], mean, shape) / dof)


def semi_supervised_step(df: DataFrame, model: Mixture, prior: str) -> tuple[Mixture, float]:
    """One step of EM where a row may know its component: `prior` is an array of the components' weights for the row, or null.

    Rows with a prior take it in place of the mixture's weights and leave those alone; all rows inform the components.
    """
    k = len(model.weights)
    own = [F.when(F.col(prior).isNull(), math.log(w) if w > 0 else NEG_INF).when(F.col(prior)[i] > 0, F.ln(F.col(prior)[i])).otherwise(NEG_INF) - (math.log(w) if w > 0 else 0.0) for i, w in enumerate(model.weights)]
    rows = df.select("*", *[(t + o).alias(f"_t{i}") for i, (t, o) in enumerate(zip(model.component_terms(), own, strict=True))])
    rows = rows.withColumn("_z", log_sum_exp(*[F.col(f"_t{i}") for i in range(k)]))
    rows = rows.select("*", *[F.when(F.col("_z") > NEG_INF, F.exp(F.col(f"_t{i}") - F.col("_z"))).otherwise(0.0).alias(f"_r{i}") for i in range(k)])
    wanted = [F.sum("_z").alias("ll"), *[F.sum(F.when(F.col(prior).isNull(), F.col(f"_r{i}")).otherwise(0.0)).alias(f"free{i}") for i in range(k)]]
    for i in range(k):
        wanted += record_sums(model.record, F.col(f"_r{i}"), f"c{i}_")
    got = rows.agg(*wanted).select("ll", *[f"free{i}" for i in range(k)], *[c for i in range(k) for c in record_params(model.record, f"c{i}_")]).head().asDict()
    free = sum(got[f"free{i}"] or 0.0 for i in range(k))
    params = [{key[len(f"c{i}_") :].replace("_p_", "_", 1): v for key, v in got.items() if key.startswith(f"c{i}_") and "_p_" in key} for i in range(k)]
    weights = [got[f"free{i}"] / free for i in range(k)] if free else model.weights
    return Mixture(model.record, weights, params), got["ll"]


def comparisons(rows: DataFrame, first: str, second: str, outcome: str) -> DataFrame:
    """(a, b, won, lost, tied), a < b, from rows that say 1 (first won), -1 (second won) or 0 (tie)."""
    up = F.col(first) < F.col(second)
    o = F.when(up, F.col(outcome)).otherwise(-F.col(outcome))
    met = rows.where(F.col(first) != F.col(second)).select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), o.alias("o"))
    return met.groupBy("a", "b").agg(*[F.count_if(F.col("o") == v).alias(name) for v, name in ((1, "won"), (-1, "lost"), (0, "tied"))])


def _both_ways(met: DataFrame) -> DataFrame:
    """(i, j, won, lost, tied) from either side."""
    return met.select(F.col("a").alias("i"), F.col("b").alias("j"), "won", "lost", "tied").unionByName(met.select(F.col("b").alias("i"), F.col("a").alias("j"), F.col("lost").alias("won"), F.col("won").alias("lost"), "tied"))


def _scaled(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    return written(new.crossJoin(F.broadcast(new.agg(F.sum("u").alias("t")))).select("item", (F.col("u") / F.col("t")).alias("w")), instead=old)


def fit_with_ties(met: DataFrame, kind: str, steps: int = 50, tie: float | None = None) -> tuple[DataFrame, float]:
    """((item, w) summing to 1, tie parameter) from `comparisons`, by minorise-maximise steps from equal worths.

    kind davidson: i beats j in proportion to w_i, they tie to nu sqrt(w_i w_j); rao_kupper: i beats j
    with w_i / (w_i + nu w_j), nu at least 1. Every step raises the likelihood.
    """
    pairs = written(_both_ways(met))
    items = pairs.select(F.col("i").alias("item")).distinct()
    w = _scaled(items.withColumn("u", F.lit(1.0)))
    ties = met.agg(F.coalesce(F.sum("tied"), F.lit(0))).head()[0]
    nu = tie if tie is not None else (1.0 if kind == "davidson" else 1.5)
    for _ in range(steps):
        x = pairs.join(w.select(F.col("item").alias("i"), F.col("w").alias("wi")), "i").join(w.select(F.col("item").alias("j"), F.col("w").alias("wj")), "j")
        wi, wj = F.col("wi"), F.col("wj")
        if kind == "davidson":
            n, root = F.col("won") + F.col("lost") + F.col("tied"), F.sqrt(wi * wj)
            d = wi + wj + nu * root
            new = x.groupBy(F.col("i").alias("item")).agg((F.sum(F.col("won") + F.col("tied") / 2) / F.sum(n * (1 + nu / 2 * F.sqrt(wj / wi)) / d)).alias("u"))
            share = x.agg(F.sum(n * root / d) / 2).head()[0]
            after = ties / share if share else nu
        else:
            s, back = F.col("won") + F.col("tied"), F.col("lost") + F.col("tied")
            new = x.groupBy(F.col("i").alias("item")).agg((F.sum(s) / F.sum(s / (wi + nu * wj) + nu * back / (nu * wi + wj))).alias("u"))
            c = x.agg(F.sum(s * wj / (wi + nu * wj))).head()[0]
            after = ties / c + math.sqrt(1 + (ties / c) ** 2) if c else nu
        w = _scaled(new, w)
        nu = after
    return w, float(nu)


def tie_loglik(met: DataFrame, worths: DataFrame, kind: str, nu: float) -> float:
    """Log-likelihood of all comparisons, given who met whom."""
    x = met.join(worths.select(F.col("item").alias("a"), F.col("w").alias("wi")), "a").join(worths.select(F.col("item").alias("b"), F.col("w").alias("wj")), "b")
    wi, wj = F.col("wi"), F.col("wj")
    if kind == "davidson":
        d = wi + wj + nu * F.sqrt(wi * wj)
        p = (wi / d, wj / d, nu * F.sqrt(wi * wj) / d)
    else:
        p = (wi / (wi + nu * wj), wj / (wj + nu * wi), (nu * nu - 1) * wi * wj / ((wi + nu * wj) * (wj + nu * wi)))
    ll = [F.when(F.col(c) > 0, F.col(c) * F.ln(v)).otherwise(0.0) for c, v in zip(("won", "lost", "tied"), p, strict=True)]
    return float(x.agg(F.sum(ll[0] + ll[1] + ll[2])).head()[0] or 0.0)
