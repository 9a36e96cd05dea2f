"""Hypothesis tests on samples, as windows and aggregates.

Ranks are mid-ranks: rows are first counted per value, so a window runs over distinct values, not
rows, and a popular value is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.special import log_of, normal_cdf_column
from tessel.operators.running import quantiles, running


def _clean(df: DataFrame, group: str | None, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    keep = df.where(x.isNotNull() & ~F.isnan(x))
    return keep.select(*([F.col(group).alias("g")] if group else []), x.alias("x"))


def running_counts(counts: DataFrame, value: str, count: str, by: list[str] | None = None) -> DataFrame:
    """Add `before`, the rows with smaller values, to (value, count) rows; no task sees all values."""
    return running(counts, [value], {"before": ("sum", F.col(count), False)}, by)


def value_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x, c, t, rank): counts of each value per group and in all, and the value's mid-rank."""
    per = _clean(df, group, value).groupBy("g", "x").agg(F.count("*").alias("c"))
    pooled = running_counts(per.groupBy("x").agg(F.sum("c").alias("t")), "x", "t")
    return per.join(pooled.withColumn("rank", F.col("before") + (F.col("t") + 1) / 2).drop("before"), "x")


def mann_whitney_u(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """u1, z, p, cliffs_delta of two groups: mid-ranks, tie-corrected variance, continuity 1/2."""
    r = value_ranks(df.where(F.col(group).isin(first, second)), group, value)
    one = F.col("g") == F.lit(first)
    sums = r.agg(F.sum(F.when(one, F.col("c") * F.col("rank"))).alias("r1"), F.sum(F.when(one, F.col("c")).otherwise(0)).alias("n1"), F.sum(F.when(~one, F.col("c")).otherwise(0)).alias("n2"))
    ties = r.select("x", F.col("t").cast("double").alias("t")).distinct().agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = sums.crossJoin(ties)  # two single rows
    n = F.col("n1") + F.col("n2")
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    d = u1 - F.col("n1") * F.col("n2") / 2
    z = F.when(sd == 0, 0.0).otherwise((d - 0.5 * F.signum(d)) / sd)
    out = s.select("n1", "n2", u1.alias("u1"), z.alias("z"), (2 * u1 / (F.col("n1") * F.col("n2")) - 1).alias("cliffs_delta"))
    return out.withColumn("p", F.least(F.lit(1.0), 2 * (1 - normal_cdf_column(F.abs("z")))))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """k, n, h (tie-corrected), epsilon2."""
    r = value_ranks(df, group, value)
    per = r.groupBy("g").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("n"))
    total = per.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = r.select("x", F.col("t").cast("double").alias("t")).distinct().agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return total.crossJoin(ties).select("k", "n", h.alias("h"), ((h - F.col("k") + 1) / (n - F.col("k"))).alias("epsilon2"))


def ks_2samp(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """d: largest distance of the two right-continuous empirical distribution functions."""
    per = _clean(df.where(F.col(group).isin(first, second)), group, value)
    one = F.col("g") == F.lit(first)
    c = per.groupBy("x").agg(F.count_if(one).alias("c1"), F.count_if(~one).alias("c2"))
    b = running(c, ["x"], {"b1": ("sum", F.col("c1"), False), "b2": ("sum", F.col("c2"), False)})
    n = c.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    gap = F.abs((F.col("b1") + F.col("c1")) / F.col("n1") - (F.col("b2") + F.col("c2")) / F.col("n2"))
    return b.crossJoin(F.broadcast(n)).agg(F.max(gap).alias("d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))


def mood_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group the rows above the grand median and the others, with the chi-squared statistic of the table."""
    rows = _clean(df, group, value)
    med = quantiles(rows, "x", [0.5]).select(F.col("q")[0].alias("m"))
    per = rows.crossJoin(F.broadcast(med)).groupBy("g").agg(F.count_if(F.col("x") > F.col("m")).alias("above"), F.count_if(F.col("x") <= F.col("m")).alias("below"))
    all_ = per.agg(F.sum("above").alias("ta"), F.sum("below").alias("tb"))
    n = F.col("above") + F.col("below")
    ea, eb = n * F.col("ta") / (F.col("ta") + F.col("tb")), n * F.col("tb") / (F.col("ta") + F.col("tb"))
    part = (F.col("above") - ea) ** 2 / ea + (F.col("below") - eb) ** 2 / eb
    return per.crossJoin(F.broadcast(all_)).agg(F.count("*").alias("k"), F.sum("above").alias("above"), F.sum("below").alias("below"), F.sum(part).alias("chi2"))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """Signed-rank test: zeros dropped; n, t (the smaller rank sum), z."""
    rows = _clean(df, None, difference).where("x <> 0").select(F.abs("x").alias("a"), (F.col("x") > 0).alias("up"))
    per = rows.groupBy("a").agg(F.count("*").alias("t"), F.count_if("up").alias("ups"))
    r = running_counts(per, "a", "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    s = r.agg(F.sum("t").alias("n"), F.sum(F.col("ups") * F.col("rank")).alias("plus"), F.sum((F.col("t") - F.col("ups")) * F.col("rank")).alias("minus"), F.sum(t**3 - t).alias("ties"))
    n = F.col("n").cast("double")
    low = F.least("plus", "minus")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * F.col("ties")) / 24)
    return s.select("n", low.alias("t"), F.when(sd > 0, (low - n * (n + 1) / 4) / sd).otherwise(0.0).alias("z"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """chi2 of complete blocks, mid-ranks within a block, tie-corrected."""
    rows = df.select(F.col(block).alias("b"), F.col(treatment).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null")
    w = Window.partitionBy("b").orderBy("x")
    ranked = rows.withColumn("lo", F.rank().over(w)).withColumn("t", F.count("*").over(Window.partitionBy("b", "x"))).withColumn("rank", F.col("lo") + (F.col("t") - 1) / 2)
    per = ranked.groupBy("g").agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    ties = ranked.agg(F.sum(F.col("t").cast("double") ** 2 - 1).alias("ties"))
    tot = per.agg(F.sum(F.col("r") ** 2).alias("s"), F.max("n").alias("n"), F.count("*").alias("k")).crossJoin(ties)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("s") - 3 * n * (k + 1)
    return tot.select("n", "k", (raw / (1 - F.col("ties") / (n * k * (k * k - 1)))).alias("chi2"))


def runs_test(df: DataFrame, order: list[str], value: str, by: str) -> DataFrame:
    """Per series: runs above and below its median (values equal to it dropped), expected runs and z."""
    med = df.groupBy(by).agg(F.median(value).alias("_m"))
    rows = df.join(med, by).where(F.col(value) != F.col("_m")).withColumn("up", F.col(value) > F.col("_m"))
    w = Window.partitionBy(by).orderBy(*order)
    flips = rows.withColumn("new", (F.lag("up").over(w).isNull() | (F.lag("up").over(w) != F.col("up"))).cast("int"))
    s = flips.groupBy(by).agg(F.sum("new").alias("runs"), F.count_if("up").alias("n1"), F.count_if(~F.col("up")).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    mu = 2 * n1 * n2 / n + 1
    var = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    return s.select(by, "n1", "n2", "runs", mu.alias("expected"), F.when(var > 0, (F.col("runs") - mu) / F.sqrt(var)).otherwise(0.0).alias("z"))


def jonckheere(df: DataFrame, group: str, value: str) -> DataFrame:
    """j: pairs of ordered groups with the later value larger, ties one half; its expectation under no trend."""
    per = _clean(df, group, value).groupBy("g", "x").agg(F.count("*").alias("c"))
    n = per.groupBy("g").agg(F.sum("c").alias("n"))
    # For every value: rows of earlier groups with smaller values, by running counts per group over all values.
    levels = per.select("x").distinct().crossJoin(F.broadcast(n.select("g"))).join(per, ["x", "g"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    run = running_counts(levels, "x", "c", ["g"])
    w = Window.partitionBy("x").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    pairs = run.withColumn("less", F.sum(F.col("before") + F.col("c") / 2).over(w))
    j = pairs.agg(F.sum(F.col("c") * F.coalesce("less", F.lit(0.0))).alias("j"))
    e = n.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return j.crossJoin(e).select("j", ((F.col("n") * F.col("n") - F.col("q")) / 4).alias("expected"))


def adjust_p(df: DataFrame, id_column: str, p: str) -> DataFrame:
    """Bonferroni, Holm, Hochberg, Benjamini-Hochberg and Benjamini-Yekutieli adjusted p-values.

    Ranks and running extremes go through ranges of p, and the harmonic number is a sum over the ranks.
    """
    rows = running(df.select(id_column, p).where(F.col(p).isNotNull()), [p, id_column], {"_k": ("sum", F.lit(1), True)})
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_m"), F.sum(1.0 / F.col("_k")).alias("_h"))))
    m, k, one = F.col("_m"), F.col("_k"), F.lit(1.0)
    rows = running(rows, [p, id_column], {"_holm": ("max", (m - k + 1) * F.col(p), True)})
    rows = running(rows, [p, id_column], {"_hochberg": ("min", (m - k + 1) * F.col(p), True), "_bh": ("min", m / k * F.col(p), True)}, descending=True)
    adjusted = {"bonferroni": m * F.col(p), "holm": F.col("_holm"), "hochberg": F.col("_hochberg"), "bh": F.col("_bh"), "by": F.col("_h") * F.col("_bh")}
    out = rows.select(id_column, p, *[F.least(one, c).alias(name) for name, c in adjusted.items()])
    missing = df.where(F.col(p).isNull()).select(id_column, p, *[F.lit(None).cast("double").alias(name) for name in adjusted])
    return out.unionByName(missing)


def fisher_combine(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """statistic -2 sum ln p and its degrees of freedom; Stouffer needs quantiles, Tippett the smallest p."""
    return df.groupBy(*(by or [])).agg((-2 * F.sum(log_of(F.col(p)))).alias("statistic"), (2 * F.count(p)).alias("df"), (1 - F.pow(1 - F.min(p), F.count(p))).alias("tippett"))
