"""Diversity, coverage and extreme-value estimates; rank aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def abundance(df: DataFrame, species: str, by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(species).isNotNull()).groupBy(*(by or []), F.col(species).alias("species")).agg(F.count("*").alias("k"))


def chao1(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bias-corrected richness, and coverage by the share of singletons (Good-Turing)."""
    f1, f2, s = F.count_if(F.col("k") == 1), F.count_if(F.col("k") == 2), F.count_if(F.col("k") > 0)
    return counts.groupBy(*(by or [])).agg(s.alias("observed"), (s + f1 * (f1 - 1) / (2.0 * (f2 + 1))).alias("chao1"), (1 - f1 / F.sum("k")).alias("coverage"))


def chao2(df: DataFrame, sample: str, species: str) -> DataFrame:
    """Richness from incidences over samples."""
    inc = df.select(sample, species).distinct()
    m = inc.agg(F.count_distinct(sample).alias("m"))
    q = inc.groupBy(species).agg(F.count("*").alias("k")).agg(F.count("*").alias("s"), F.count_if(F.col("k") == 1).alias("q1"), F.count_if(F.col("k") == 2).alias("q2"))
    return q.crossJoin(m).select("s", (F.col("s") + (F.col("m") - 1) / F.col("m") * F.col("q1") * (F.col("q1") - 1) / (2.0 * (F.col("q2") + 1))).alias("chao2"))


def ace(counts: DataFrame, rare: int = 10) -> DataFrame:
    """Abundance-based coverage estimator; species of at most `rare` rows are rare."""
    is_rare, k = F.col("k") <= rare, F.col("k")
    s = counts.where("k > 0").agg(F.count_if(~is_rare).alias("sa"), F.count_if(is_rare).alias("sr"), F.sum(F.when(is_rare, k).otherwise(0)).alias("nr"), F.count_if(k == 1).alias("f1"), F.sum(F.when(is_rare, k * (k - 1)).otherwise(0)).alias("ii"))
    c = 1 - F.col("f1") / F.col("nr")
    g = F.greatest(F.col("sr") / c * F.col("ii") / (F.col("nr") * (F.col("nr") - 1)) - 1, F.lit(0.0))
    return s.select((F.col("sa") + F.col("sr") / c + F.col("f1") / c * g).alias("ace"))


def hill_numbers(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """q0, q1 (exponential of the entropy in nats), q2."""
    keys = by or []
    p = counts.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg(F.count("*").cast("double").alias("q0"), F.exp(-F.sum(F.col("p") * F.ln("p"))).alias("q1"), (1 / F.sum(F.col("p") ** 2)).alias("q2"))


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k + 1 largest values, ranked; a top-k, never a full sort."""
    return df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x")).orderBy(F.desc("x")).limit(k + 1).withColumn("r", F.row_number().over(Window.orderBy(F.desc("x"))))


def hill_estimator(df: DataFrame, value: str, k: int) -> DataFrame:
    """hill: mean log of the k largest over the next; moment: the moment estimator of the tail index."""
    t = top_values(df, value, k)
    ref = t.where(F.col("r") == k + 1).select(F.ln("x").alias("lx"))
    d = F.ln("x") - F.col("lx")
    m = t.where(F.col("r") <= k).crossJoin(F.broadcast(ref)).agg(F.avg(d).alias("m1"), F.avg(d * d).alias("m2"))
    return m.select(F.col("m1").alias("hill"), (F.col("m1") + 1 - 0.5 / (1 - F.col("m1") ** 2 / F.col("m2"))).alias("moment"))


def mean_excess(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(u, n, mean_excess) over strict exceedances; NaN where there is none; one pass for all thresholds."""
    rows = df.select(F.col(value).cast("double").alias("x"), F.explode(F.array(*[F.lit(float(u)) for u in thresholds])).alias("u"))
    return rows.groupBy("u").agg(F.count_if(F.col("x") > F.col("u")).alias("n"), F.coalesce(F.avg(F.when(F.col("x") > F.col("u"), F.col("x") - F.col("u"))), F.lit(float("nan"))).alias("mean_excess"))


def record_times(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows that exceed everything before them in their series; the first is a record."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = Window.partitionBy(by).orderBy(*order)
    best = F.max(value).over(w)
    return df.select(by, F.row_number().over(at).alias("position"), value, best.alias("_b")).where(F.col("_b").isNull() | (F.col(value) > F.col("_b"))).drop("_b")


def borda(df: DataFrame, voter: str, item: str, position: str) -> DataFrame:
    """(item, score): sum of m - 1 - position over voters, m the ranked items of the voter."""
    m = F.count("*").over(Window.partitionBy(voter))
    return df.select(item, (m - 1 - F.col(position)).alias("s")).groupBy(item).agg(F.sum("s").alias("score"))


def preferences(df: DataFrame, voter: str, item: str, position: str) -> DataFrame:
    """(a, b, n): voters who rank a before b. A voter's list is short; pairs are formed within it and summed at once."""
    lists = df.groupBy(voter).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(item).alias("i")))).alias("l"))
    rows = lists.select("l", F.posexplode("l").alias("k", "x")).select(F.col("x.i").alias("a"), F.col("x.p").alias("pa"), F.explode(F.expr("slice(l, k + 2, size(l))")).alias("y"))
    return rows.where(F.col("y.p") > F.col("pa")).groupBy("a", F.col("y.i").alias("b")).agg(F.count("*").alias("n"))


def copeland(df: DataFrame, voter: str, item: str, position: str) -> DataFrame:
    """(item, score): +1 for each item beaten by a majority, -1 for each that beats it."""
    p = preferences(df, voter, item, position)
    both = p.select("a", "b", F.col("n").alias("w"), F.lit(0).cast("long").alias("l")).unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).cast("long").alias("w"), F.col("n").alias("l")))
    duel = both.groupBy("a", "b").agg((F.sum("w") - F.sum("l")).alias("d"))
    return duel.groupBy(F.col("a").alias("item")).agg(F.sum(F.signum("d").cast("long")).alias("score"))
