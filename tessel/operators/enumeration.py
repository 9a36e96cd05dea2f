"""Enumeration of supports in order of probability, conjugate posteriors, relations and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_support(levels: DataFrame, level: str = "level", p: str = "p") -> DataFrame:
    """(level, p, rank, cumulative) of a finite support, likeliest first."""
    w = Window.orderBy(F.desc(p), level)
    return levels.select(level, p, F.row_number().over(w).alias("rank"), F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def nucleus(levels: DataFrame, mass: float, level: str = "level", p: str = "p") -> DataFrame:
    """The smallest set of likeliest levels that holds `mass`."""
    r = ranked_support(levels, level, p)
    return r.where(F.col("cumulative") - F.col(p) < mass)


def product_topk(tables: list[DataFrame], k: int) -> DataFrame:
    """(v0, v1, ..., logp): likeliest combinations of independent finite supports.

    A combination among the k best has its every part among the k best of its own support, so each
    support is cut to k before the next is joined, and the join's result is cut to k again.
    """
    out = None
    for i, t in enumerate(tables):
        part = t.where("p > 0").select(F.col("level").alias(f"v{i}"), F.ln("p").alias("l")).orderBy(F.desc("l"), f"v{i}").limit(k)
        if out is None:
            out = part.withColumnRenamed("l", "logp")
        else:
            cols = [f"v{j}" for j in range(i + 1)]
            out = out.crossJoin(F.broadcast(part)).select(*cols, (F.col("logp") + F.col("l")).alias("logp")).orderBy(F.desc("logp"), *cols).limit(k)
    return out


def _posterior(kind: str, s: Column, n: Column, prior: tuple[float, ...]) -> dict[str, Column]:
    """Parameters of one conjugate posterior from the sum and the count of its data."""
    if kind == "beta":
        a, b = prior
        return {"a": s + a, "b": n - s + b, "mean": (s + a) / (n + a + b)}
    if kind == "gamma":
        shape, rate = prior
        return {"shape": s + shape, "rate": n + rate, "mean": (s + shape) / (n + rate)}
    mu, tau2, sigma2 = prior
    precision = 1 / tau2 + n / sigma2
    return {"mean": (mu / tau2 + s / sigma2) / precision, "variance": 1 / precision}


def posteriors(df: DataFrame, by: list[str], models: dict[str, tuple[str, str, tuple[float, ...]]]) -> DataFrame:
    """(by, <name>_<parameter>) of several conjugate models name -> (beta, gamma or normal, column, prior), in one aggregation."""
    sums = [x for name, (_, column, _) in models.items() for x in (F.sum(F.col(column).cast("double")).alias(f"_s_{name}"), F.count(column).alias(f"_n_{name}"))]
    s = df.groupBy(*by).agg(*sums)
    out = [c.alias(f"{name}_{k}") for name, (kind, _, prior) in models.items() for k, c in _posterior(kind, F.col(f"_s_{name}"), F.col(f"_n_{name}"), prior).items()]
    return s.select(*by, *out)


def _one_posterior(df: DataFrame, by: list[str], kind: str, column: str, prior: tuple[float, ...]) -> DataFrame:
    both = posteriors(df, by, {"p": (kind, column, prior)})
    return both.select(*by, *[F.col(c).alias(c.removeprefix("p_")) for c in both.columns[len(by) :]])


def beta_posterior(df: DataFrame, column: str, by: list[str], a: float = 1.0, b: float = 1.0) -> DataFrame:
    """(by, a, b, mean) of a Beta-Bernoulli posterior; the data are two sums."""
    return _one_posterior(df, by, "beta", column, (a, b))


def gamma_posterior(df: DataFrame, column: str, by: list[str], shape: float = 1.0, rate: float = 1.0) -> DataFrame:
    """(by, shape, rate, mean) of a Poisson-Gamma posterior."""
    return _one_posterior(df, by, "gamma", column, (shape, rate))


def normal_posterior(df: DataFrame, column: str, by: list[str], mu: float, tau2: float, sigma2: float) -> DataFrame:
    """(by, mean, variance) of a normal mean under a normal prior, the variance known."""
    return _one_posterior(df, by, "normal", column, (mu, tau2, sigma2))


def dirichlet_posterior(df: DataFrame, column: str, by: list[str], alpha: float = 1.0) -> DataFrame:
    """(by, level, alpha, mean) over the levels seen."""
    c = df.groupBy(*by, F.col(column).alias("level")).agg((F.count("*") + alpha).alias("alpha"))
    return c.withColumn("mean", F.col("alpha") / F.sum("alpha").over(Window.partitionBy(*by)))


def shortest_paths(edges: DataFrame, source, rounds: int) -> DataFrame:
    """(node, distance) from a node over weighted edges (src, dst, w): one relaxation of all edges per round."""
    best = edges.sparkSession.createDataFrame([(source, 0.0)], f"node {dict(edges.dtypes)['src']}, distance double")
    for _ in range(rounds):
        step = best.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        best = best.unionByName(step).groupBy("node").agg(F.min("distance").alias("distance"))
    return best


def block_model(edges: DataFrame, blocks: DataFrame, n_pairs: DataFrame | None = None) -> DataFrame:
    """(b1, b2, edges) between blocks of nodes: edges (src, dst) joined with (node, block) twice."""
    a = blocks.select(F.col("node").alias("src"), F.col("block").alias("b1"))
    b = blocks.select(F.col("node").alias("dst"), F.col("block").alias("b2"))
    return edges.join(a, "src").join(b, "dst").groupBy("b1", "b2").agg(F.count("*").alias("edges"))


def average_effect(df: DataFrame, treatment: str, outcome: str, confounder: str) -> DataFrame:
    """Back-door adjusted difference of means: strata of the confounder weighted by their share of all rows."""
    s = df.groupBy(F.col(confounder).alias("z")).agg(F.count("*").alias("n"), F.avg(F.when(F.col(treatment) == 1, F.col(outcome))).alias("y1"), F.avg(F.when(F.col(treatment) == 0, F.col(outcome))).alias("y0"))
    ok = s.where("y1 is not null and y0 is not null")
    return ok.agg((F.sum(F.col("n") * (F.col("y1") - F.col("y0"))) / F.sum("n")).alias("effect"), F.count("*").alias("strata"))
