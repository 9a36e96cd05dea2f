"""Calibration, scoring rules, conformal prediction, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.running import quantiles, running


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y) of equal-width bins [a, b), the last closed; empty bins left out."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """ece (l1), ece2 (l2), mce."""
    r = reliability(df, p, y, bins)
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return r.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("ece2"), F.max(gap).alias("mce"))


def brier_decomposition(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """reliability, resolution, uncertainty, and their sum with signs as `brier` (of the binned forecast)."""
    r = reliability(df, p, y, bins)
    base = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).agg(F.avg(F.col(y).cast("double")).alias("base"))
    j = r.crossJoin(F.broadcast(base))
    n = F.sum("n")
    rel = F.sum(F.col("n") * (F.col("mean_p") - F.col("mean_y")) ** 2) / n
    res = F.sum(F.col("n") * (F.col("mean_y") - F.col("base")) ** 2) / n
    unc = F.max(F.col("base") * (1 - F.col("base")))
    return j.agg(rel.alias("reliability"), res.alias("resolution"), unc.alias("uncertainty"), (rel - res + unc).alias("brier"))


def brier(p: Column, y: Column) -> Column:
    return (p - y) ** 2


def log_score(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def interval_score(lo: Column, hi: Column, y: Column, alpha: float) -> Column:
    return hi - lo + 2 / alpha * (F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0)))


def crps_ensemble(members: Column, y: Column) -> Column:
    """mean |x - y| - half the mean |x - x'| over an array of members, by sorted members."""
    m = F.size(members)
    first = F.aggregate(members, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / m
    ordered = F.transform(F.array_sort(members), lambda x, i: x * (2 * i + 1 - m))
    return first - F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x) / (m * m)


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks (ties count one half)."""
    per = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("x")).agg(F.count("*").alias("t"), F.count_if(F.col(y) == 1).alias("pos"))
    r = running(per, ["x"], {"before": ("sum", F.col("t"), False)})
    s = r.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("t") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum("t").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def conformal_quantile(df: DataFrame, score: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """The ceil((n+1)(1-alpha))-th smallest score, infinity where there are too few; per group for `by`."""
    by = by or []
    per = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_t"))
    n = per.groupBy(*by).agg(F.sum("_t").alias("n"))
    ranked = running(per, ["_s"], {"_before": ("sum", F.col("_t"), False)}, by)
    j = ranked.join(n, by) if by else ranked.crossJoin(F.broadcast(n))
    k = F.ceil((F.col("n") + 1) * (1 - alpha))
    here = (F.col("_before") < k) & (k <= F.col("_before") + F.col("_t"))
    return j.groupBy(*by, "n").agg(F.coalesce(F.max(F.when(here, F.col("_s"))), F.lit(float("inf"))).alias("quantile"))


def weighted_conformal(df: DataFrame, score: str, weight: str, alpha: float, test_weight: float = 1.0) -> DataFrame:
    """First score with cumulative weight / (total + test weight) >= 1 - alpha, else infinity."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(weight).alias("w"))
    total = per.agg((F.sum("w") + test_weight).alias("total"))
    cum = running(per, ["s"], {"c": ("sum", F.col("w"), True)}).crossJoin(F.broadcast(total))
    return cum.agg(F.coalesce(F.min(F.when(F.col("c") / F.col("total") >= 1 - alpha, F.col("s"))), F.lit(float("inf"))).alias("quantile"))


def pit_histogram(df: DataFrame, pit: Column, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(pit * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def psi(df: DataFrame, value: str, is_reference: Column, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's deciles, proportions + 1e-6."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(x.alias("x"), is_reference.alias("r"))
    cuts = quantiles(rows.where("r"), "x", [i / bins for i in range(1, bins)]).select(F.array_distinct("q").alias("cuts"))
    cell = F.aggregate("cuts", F.lit(0), lambda a, c: a + (F.col("x") >= c).cast("int"))
    counts = rows.crossJoin(F.broadcast(cuts)).groupBy(cell.alias("bin")).agg(F.count_if("r").alias("nr"), F.count_if(~F.col("r")).alias("nc"))
    tot = counts.agg(F.sum("nr").alias("tr"), F.sum("nc").alias("tc"))
    r, c = F.col("nr") / F.col("tr") + 1e-6, F.col("nc") / F.col("tc") + 1e-6
    return counts.crossJoin(F.broadcast(tot)).agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def js_divergence(df: DataFrame, value: str, is_reference: Column, bins: int = 20) -> DataFrame:
    """Jensen-Shannon divergence in bits over equal bins of the joint range, counts + 1e-12."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"), is_reference.alias("r"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cell = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(cell.alias("bin")).agg((F.count_if("r") + 1e-12).alias("a"), (F.count_if(~F.col("r")) + 1e-12).alias("b"))
    tot = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    m = (p + q) / 2
    return counts.crossJoin(F.broadcast(tot)).agg((0.5 * F.sum(p * F.log2(p / m)) + 0.5 * F.sum(q * F.log2(q / m))).alias("js_bits"))
