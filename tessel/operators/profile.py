"""Profiles of unknown tables: column kinds, code lengths, pairwise dependence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, NaN, distinct values (approximate), mean, sd, min, max; one aggregation."""
    aggs, names = [F.count("*").alias("n")], []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)):
            c, num = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
            x = c.cast("double") if num else F.lit(None).cast("double")
            nan = F.count_if(F.isnan(x)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(0).cast("long")
            aggs.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(c.isNull()).alias("nulls"), nan.alias("nans"), F.approx_count_distinct(c).alias("distinct"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most")).alias(f"_{i}"))
            names.append(f"_{i}")
    one = df.agg(*aggs)
    return one.select("n", F.explode(F.array(*names)).alias("c")).select("c.column", "c.type", "n", "c.nulls", "c.nans", "c.distinct", "c.mean", "c.sd", "c.least", "c.most")


def recommend(df: DataFrame) -> DataFrame:
    """(column, kind): the model kind each column suggests, from one pass of counts.

    Booleans and other strings are categorical; near-unique strings (100 rows or more, 95 % distinct)
    are ignored; fractions are gaussian; integers of small range are integer_categorical,
    non-negative ones poisson when the variance is near the mean, else gaussian.
    """
    p = profile_columns(df)
    share = F.col("distinct") / F.greatest(F.col("n") - F.col("nulls"), F.lit(1))
    unique = (F.col("n") >= 100) & (share >= 0.95)
    integer = F.col("type").isin("int", "bigint", "smallint", "tinyint")
    span = F.col("most") - F.col("least")
    kind = (
        F.when(F.col("type") == "boolean", "categorical")
        .when(F.col("type") == "string", F.when(unique, "ignored").otherwise("categorical"))
        .when(integer & unique & (span > 10 * F.col("n")), "ignored")
        .when(integer & (span <= 32) & (F.col("distinct") <= 24), "integer_categorical")
        .when(integer & (F.col("least") >= 0) & (F.col("sd") ** 2 < 4 * F.col("mean")) & (F.col("sd") ** 2 > F.col("mean") / 4), "poisson")
        .otherwise("gaussian")
    )
    return p.select("column", kind.alias("kind"))


def entropy_bits(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, levels, bits, bic_bits): plug-in entropy of each column and its penalised code length; one shuffle of counts."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("v")) for c in columns])).alias("c")).select("c.*")
    counts = cells.groupBy("column", "v").agg(F.count("*").alias("k"))
    n, k = F.sum("k"), F.count("*")
    h = F.log2(n) - F.sum(F.col("k") * F.log2("k")) / n
    return counts.groupBy("column").agg(k.alias("levels"), h.alias("bits"), (h + 0.5 * (k - 1) * F.log2(n) / n).alias("bic_bits"))


def gaussian_bits(variance: Column) -> Column:
    """Differential code length of a Gaussian, floored at 0."""
    return F.greatest(0.5 * F.log2(2 * math.pi * math.e * variance), F.lit(0.0))


def bic_family_choice(df: DataFrame, column: str) -> DataFrame:
    """(family, bits, weight): penalised bits per row of gaussian, lognormal, exponential and laplace-free candidates; smallest first."""
    x = F.col(column).cast("double")
    s = df.where(x.isNotNull() & ~F.isnan(x)).agg(F.count("*").alias("n"), F.var_pop(x).alias("v"), F.avg(x).alias("m"), F.avg(F.ln(F.when(x > 0, x))).alias("ml"), F.var_pop(F.ln(F.when(x > 0, x))).alias("vl"), F.min(x).alias("lo"))
    pen = lambda k: 0.5 * k * F.log2("n") / F.col("n")
    rows = F.array(
        F.struct(F.lit("gaussian").alias("family"), (gaussian_bits(F.col("v")) + pen(2)).alias("bits")),
        F.struct(F.lit("lognormal").alias("family"), F.when(F.col("lo") > 0, F.col("ml") / math.log(2) + gaussian_bits(F.col("vl")) + pen(2)).alias("bits")),
        F.struct(F.lit("exponential").alias("family"), F.when(F.col("lo") >= 0, (1 + F.ln("m")) / math.log(2) + pen(1)).alias("bits")),
    )
    t = s.select("n", F.explode(rows).alias("r")).select("n", "r.*").where("bits is not null")
    best = F.min("bits").over(Window.partitionBy())
    w = F.pow(F.lit(2.0), -F.col("n") * (F.col("bits") - best))
    return t.withColumn("w", w).select("family", "bits", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


def pairwise_mi(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, mi_bits, adjusted_bits, gain_bits) of all pairs of columns, levels as they are (null a level).

    A row gives one cell per pair, counted before the shuffle; joint counts then give the marginals.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("__missing__"))
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), level(a).alias("x"), level(b).alias("y")) for a, b in pairs])).alias("c")).select("c.*")
    joint = cells.groupBy("a", "b", "x", "y").agg(F.count("*").alias("k"))
    side = lambda v: Window.partitionBy("a", "b", v)
    j = joint.withColumn("kx", F.sum("k").over(side("x"))).withColumn("ky", F.sum("k").over(side("y")))
    per = j.groupBy("a", "b").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("sk"), F.sum(F.col("k") * F.log2("kx")).alias("sx"), F.sum(F.col("k") * F.log2("ky")).alias("sy"), F.count("*").alias("cells"), F.count_distinct("x").alias("lx"), F.count_distinct("y").alias("ly"))
    mi = (F.col("sk") - F.col("sx") - F.col("sy")) / F.col("n") + F.log2("n")
    bias = (F.col("cells") - F.col("lx") - F.col("ly") + 1) / (2 * F.col("n") * math.log(2))
    gain = mi - 0.5 * (F.col("lx") - 1) * (F.col("ly") - 1) * F.log2("n") / F.col("n")
    return per.select("a", "b", "n", F.greatest(mi, F.lit(0.0)).alias("mi_bits"), F.greatest(mi - bias, F.lit(0.0)).alias("adjusted_bits"), gain.alias("gain_bits"))


def dependency_forest(pairs: DataFrame, least_bits: float = 0.05) -> list[tuple[str, str, float]]:
    """Maximum-weight spanning forest over accepted pairs; as many rows as pairs of columns, so on the driver."""
    edges = pairs.where((F.col("adjusted_bits") >= least_bits) & (F.col("gain_bits") > 0)).orderBy(F.desc("adjusted_bits"), "a", "b").collect()
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for e in edges:
        u, v = find(e.a), find(e.b)
        if u != v:
            root[u] = v
            out.append((e.a, e.b, e.adjusted_bits))
    return out


def dependency_gain(df: DataFrame, key: str, value: str) -> DataFrame:
    """Log-likelihood gain in nats of a Gaussian per level over one Gaussian, less the BIC penalty."""
    per = df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    v = F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2
    ll = lambda n, var: -0.5 * n * (F.ln(2 * math.pi * var) + 1)
    tot = per.agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum(ll(F.col("n"), F.greatest(v, F.lit(1e-8)))).alias("cond"), F.count("*").alias("levels"))
    return tot.select("levels", (F.col("cond") - ll(F.col("n"), v) - 0.5 * (F.col("levels") - 1) * 2 * F.ln("n")).alias("gain"))


def linear_gaussian_edge(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, residual variance and gain (nats) of y on x, from one aggregation."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    slope = F.when(F.col("vx") * F.col("n") <= 1e-12, 0.0).otherwise(F.col("c") / F.col("vx"))
    res = F.col("vy") - slope * F.col("c")
    ll = lambda var: -0.5 * F.col("n") * (F.ln(2 * math.pi * var) + 1)
    return s.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), res.alias("residual_variance"), (ll(res) - ll(F.col("vy")) - 0.5 * F.ln("n")).alias("gain"))


def conditional_mi(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Conditional mutual information of two columns given a third, in nats, at least 0."""
    joint = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")).agg(F.count("*").alias("k"))
    over = lambda *c: F.sum("k").over(Window.partitionBy(*c))
    j = joint.withColumn("kz", over("z")).withColumn("kxz", over("x", "z")).withColumn("kyz", over("y", "z"))
    return j.agg(F.greatest(F.sum(F.col("k") * F.ln(F.col("k") * F.col("kz") / (F.col("kxz") * F.col("kyz")))) / F.sum("k"), F.lit(0.0)).alias("cmi"))
