"""Regression and families under censoring: Cox models from risk-set sums, censored maximum likelihood."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.special import log_of
from tessel.operators.running import running
from tessel.sources.shared import scoped, written

#: Events of one time that one task goes through, in Efron's correction.
TIED = 10_000


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


@scoped
def cox_ph(df: DataFrame, time: str, event: str, covariates: list[str], strata: str | None = None, ties: str = "efron", iterations: int = 30, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Coefficients, standard errors, Breslow's partial log-likelihood and the Newton steps taken.

    Every step is one aggregation per distinct time (sums of exp(x'b), x exp(x'b), xx' exp(x'b) over all
    rows and over those with an event), running sums from the latest time back, and one row of totals: the
    gradient and the Hessian. Efron's correction takes l/d of the tied events off for the l-th of d.
    """
    p = len(covariates)
    xs = [F.col(f"x{i}") for i in range(p)]
    keep = F.col(time).isNotNull() & F.col(event).isNotNull()
    for c in covariates:
        keep &= F.col(c).isNotNull()
    rows = written(df.where(keep).select(F.col(time).cast("double").alias("t"), (F.col(event) != 0).alias("e"), (F.col(strata) if strata else F.lit(0)).alias("s"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]))
    tied = rows.where("e").groupBy("s", "t").count().agg(F.max("count")).head()[0] or 0 if ties == "efron" else 0
    beta, loglik, steps = np.zeros(p), float("nan"), 0
    hess = -np.eye(p)
    for steps in range(1, iterations + 1):
        theta = F.exp(sum((float(b) * x for b, x in zip(beta, xs, strict=True)), F.lit(0.0)))
        sums = {"r": F.col("w"), **{f"r{i}": F.col("w") * xs[i] for i in range(p)}, **{f"r{i}_{j}": F.col("w") * xs[i] * xs[j] for i, j in _pairs(p)}}
        died = {f"d{k[1:]}": F.when(F.col("e"), v).otherwise(0.0) for k, v in sums.items()}
        seen = {f"y{i}": F.when(F.col("e"), xs[i]).otherwise(0.0) for i in range(p)}
        seen["lin"] = F.when(F.col("e"), F.ln("w")).otherwise(0.0)
        per = rows.withColumn("w", theta).groupBy("s", "t").agg(F.count_if("e").alias("n_d"), *[F.sum(v).alias(k) for k, v in {**sums, **died, **seen}.items()])
        risk = running(per, ["t"], {f"a{k[1:]}": ("sum", F.col(k), True) for k in sums}, ["s"], descending=True).where("n_d > 0")
        if ties == "efron":
            # One row per event of a tied set, l = 0 .. d - 1; large sets are dealt out in blocks first.
            blocks = risk.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_d") - 1) / TIED))))
            blocks = blocks.repartition("s", "t", "_b") if tied > TIED else blocks
            each = blocks.withColumn("l", F.explode(F.sequence(F.col("_b") * TIED, F.least(F.col("n_d") - 1, F.col("_b") * TIED + TIED - 1))))
            off, times, one = F.col("l") / F.col("n_d"), F.lit(1.0), F.when(F.col("l") == 0, 1.0).otherwise(0.0)
        else:
            each, off, times, one = risk, F.lit(0.0), F.col("n_d").cast("double"), F.lit(1.0)
        at: dict[str, Column] = {k[1:]: F.col(f"a{k[1:]}") - off * F.col(f"d{k[1:]}") for k in sums}
        mean = [at[str(i)] / at[""] for i in range(p)]
        aggs = [F.sum(one * F.col(f"y{i}") - times * mean[i]).alias(f"g{i}") for i in range(p)]
        aggs += [F.sum(times * (at[f"{i}_{j}"] / at[""] - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in _pairs(p)]
        aggs.append(F.sum(one * F.col("lin") - times * F.ln("a")).alias("ll"))
        got = each.agg(*aggs).head()
        if got.ll is None:
            return beta, np.full(p, np.nan), float("nan"), 0
        grad = np.array([got[f"g{i}"] for i in range(p)])
        hess = np.zeros((p, p))
        for i, j in _pairs(p):
            hess[i, j] = hess[j, i] = -got[f"h{i}_{j}"]
        loglik = got.ll
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < tolerance:
            break
    return beta, np.sqrt(np.clip(np.diag(np.linalg.inv(-hess)), 0, None)), float(loglik), steps


def fit_censored_exponential(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """(by, beta): all time over the events."""
    return df.groupBy(*(by or [])).agg((F.sum(F.col(time).cast("double")) / F.count_if(F.col(event) != 0)).alias("beta"))


@scoped
def fit_censored_weibull(df: DataFrame, time: str, event: str, steps: int = 12) -> tuple[float, float]:
    """Shape and scale by Newton steps on the log of the shape, one aggregation each; nulls and times of 0 left out."""
    t = F.col(time).cast("double")
    rows = df.where(F.col(event).isNotNull() & (t > 0)).groupBy(F.ln(t).alias("u")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(event) != 0).cast("double").alias("d"))
    rows = written(rows)
    k = 1.0
    for _ in range(steps):
        w = F.col("n") * F.exp(k * F.col("u"))
        g = rows.agg(F.sum(w).alias("s0"), F.sum(w * F.col("u")).alias("s1"), F.sum(w * F.col("u") * F.col("u")).alias("s2"), F.sum("d").alias("d"), F.sum(F.col("d") * F.col("u")).alias("v")).head()
        if not g.d:
            return float("nan"), float("nan")
        # Profile likelihood of the shape: 1/k + mean ln t of the events - weighted mean ln t of all.
        m = g.s1 / g.s0
        slope = 1 / k + g.v / g.d - m
        curve = -1 / k**2 - (g.s2 / g.s0 - m * m)
        k = max(k - slope / curve, k / 4)
    g = rows.agg(F.sum(F.col("n") * F.exp(k * F.col("u"))).alias("s0"), F.sum("d").alias("d")).head()
    return k, (g.s0 / g.d) ** (1 / k)


def censored_loglik(exact: Column, survival: Column, event: Column) -> Column:
    """Log-density of a row seen to its event, log-survival of one cut off before."""
    return F.when(event != 0, exact).otherwise(log_of(survival))


def baseline_hazard(df: DataFrame, time: str, event: str, covariates: list[str], beta: np.ndarray) -> DataFrame:
    """(t, hazard): Breslow's cumulative baseline hazard at each time with an event."""
    theta = F.exp(sum((float(b) * F.col(c) for b, c in zip(beta, covariates, strict=True)), F.lit(0.0)))
    per = df.groupBy(F.col(time).alias("t")).agg(F.count_if(F.col(event) != 0).alias("d"), F.sum(theta).alias("r"))
    risk = running(per, ["t"], {"a": ("sum", F.col("r"), True)}, descending=True).where("d > 0")
    return running(risk, ["t"], {"hazard": ("sum", F.col("d") / F.col("a"), True)}).select("t", "hazard")
