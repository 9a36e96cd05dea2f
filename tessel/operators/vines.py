"""Pair copulas fitted from Kendall's tau, and vines of them: canonical, drawable and regular.

Columns become uniform scores (mean rank over n + 1). A vine is built tree by tree: every allowed
pair of the tree's nodes gets an exact tau, the rule of the vine picks the edges (a star, a path, or
a maximum spanning tree on |tau|), each edge's family is the likeliest of those tau allows, and its
h-functions carry both ends to the next tree. Conditional scores are columns of a table that is
written once per tree; a score of rows is one chain of column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.special import normal_cdf_column
from tessel.operators import kendall
from tessel.operators import multivariate as mv
from tessel.operators.running import running
from tessel.sources.shared import scoped, written

#: Uniform scores are kept this far from 0 and 1.
EDGE = 1e-9


def uniform_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add u_<column>: mean rank / (n + 1); rows with a null in any of the columns are left out."""
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    n = rows.agg(F.count("*").alias("_n"))
    for c in columns:
        per = rows.groupBy(F.col(c).alias("_x")).agg(F.count("*").alias("_t"))
        ranks = running(per, ["_x"], {"_b": ("sum", F.col("_t"), False)}).crossJoin(F.broadcast(n))
        u = ranks.select("_x", ((F.col("_b") + (F.col("_t") + 1) / 2) / (F.col("_n") + 1)).alias(f"u_{c}"))
        rows = rows.join(u, F.col(c) == F.col("_x")).drop("_x")
    return rows


def debye(theta: float) -> float:
    """The mean of t / (e^t - 1) over 0 to theta, by Simpson's rule."""
    if abs(theta) < 1e-8:
        return 1 - theta / 4
    n, f = 2000, lambda t: 1.0 if abs(t) < 1e-12 else t / math.expm1(t)
    h = theta / n
    return (f(0.0) + f(theta) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))) * h / 3 / theta


def frank_parameter(tau: float) -> float:
    """The parameter whose tau, 1 - 4 (1 - D(theta)) / theta, this is."""
    if abs(tau) < 1e-10:
        return 1e-6
    low, high = 1e-6, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - 4 * (1 - debye(mid)) / mid < abs(tau) else (low, mid)
    return math.copysign((low + high) / 2, tau)


def parameters(tau: float) -> dict[str, float]:
    """The parameter of every family that can have this tau."""
    tau = min(max(tau, -0.999), 0.999)
    out = {"gaussian": math.sin(math.pi * tau / 2), "frank": frank_parameter(tau)}
    if tau > 0:
        out |= {"clayton": 2 * tau / (1 - tau), "gumbel": 1 / (1 - tau)}
    return out


def gaussian_logpdf(u: Column, v: Column, rho: float) -> Column:
    x, y, r = mv.probit(u), mv.probit(v), 1 - rho * rho
    return -0.5 * math.log(r) - (rho * rho * (x * x + y * y) - 2 * rho * x * y) / (2 * r)


LOGPDF = {"gaussian": gaussian_logpdf, "clayton": mv.clayton_logpdf, "frank": mv.frank_logpdf, "gumbel": mv.gumbel_logpdf}


def conditional(family: str, u: Column, v: Column, theta: float) -> Column:
    """The probability of being below u given v."""
    if family == "gaussian":
        h = normal_cdf_column((mv.probit(u) - theta * mv.probit(v)) / math.sqrt(1 - theta * theta))
    elif family == "clayton":
        h = F.pow(1 + F.pow(v, F.lit(theta)) * (F.pow(u, F.lit(-theta)) - 1), F.lit(-1 - 1 / theta))
    elif family == "frank":
        a, b = 1 - F.exp(-theta * u), 1 - F.exp(-theta * v)
        h = F.exp(-theta * v) * a / (-math.expm1(-theta) - a * b)
    else:
        x, y = -F.ln(u), -F.ln(v)
        s = F.pow(x, F.lit(theta)) + F.pow(y, F.lit(theta))
        h = F.exp(-F.pow(s, F.lit(1 / theta))) / v * F.pow(y, F.lit(theta - 1)) * F.pow(s, F.lit(1 / theta - 1))
    return F.greatest(F.least(h, F.lit(1 - EDGE)), F.lit(EDGE))


def fit_pair(df: DataFrame, u: str, v: str) -> dict:
    """tau, and of each family that can have it the parameter and the mean log-density: {tau, families: {name: (theta, ll)}}."""
    tau = kendall.counts(df, u, v).head().tau_b or 0.0
    found = parameters(tau)
    means = df.agg(*[F.avg(LOGPDF[f](F.col(u), F.col(v), t)).alias(f) for f, t in found.items()]).head()
    return {"tau": tau, "families": {f: (t, means[f]) for f, t in found.items()}}


@dataclass
class Edge:
    """A pair of columns given others, its family and parameter; `ends` are the score columns of a and b."""

    a: str
    b: str
    given: tuple[str, ...]
    family: str
    theta: float
    tau: float
    ends: tuple[str, str]


@dataclass
class Vine:
    columns: list[str]
    trees: list[list[Edge]] = field(default_factory=list)


def _name(a: str, given: tuple[str, ...]) -> str:
    return f"u_{a}" if not given else f"u_{a}|" + ",".join(sorted(given))


def _pairs(nodes: list[dict]) -> list[tuple[int, int, str, str, tuple[str, ...]]]:
    """(i, j, a, b, given) of the pairs of nodes that share all but one variable each."""
    out = []
    for i, p in enumerate(nodes):
        for j in range(i + 1, len(nodes)):
            common = p["all"] & nodes[j]["all"]
            if len(common) == len(p["all"]) - 1:
                out.append((i, j, next(iter(p["all"] - common)), next(iter(nodes[j]["all"] - common)), tuple(sorted(common))))
    return out


def _chosen(kind: str, count: int, weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Edges of one tree over `count` nodes: heaviest star, path (the nodes in their order) or spanning tree."""
    if kind == "path":
        return [(i, i + 1) for i in range(count - 1)]
    if kind == "star":
        total = [sum(w for pair, w in weights.items() if i in pair) for i in range(count)]
        root = max(range(count), key=lambda i: (total[i], -i))
        return sorted(p for p in weights if root in p)
    of, out = list(range(count)), []
    for i, j in sorted(weights, key=lambda p: (-weights[p], p)):
        if of[i] != of[j]:
            out.append((i, j))
            of = [of[i] if c == of[j] else c for c in of]
    return out


@scoped
def fit(df: DataFrame, columns: list[str], kind: str = "tree", families: tuple[str, ...] = ("gaussian", "clayton", "frank", "gumbel")) -> Vine:
    """A vine on the columns' uniform scores. kind: star (canonical), path (drawable, columns in the order given) or tree (regular)."""
    rows = written(uniform_scores(df.select(*columns), columns).select(*[f"u_{c}" for c in columns]))
    vine = Vine(columns)
    nodes = [{"all": {c}, "score": {c: f"u_{c}"}} for c in columns]
    while len(nodes) > 1:
        found = {(i, j): (a, b, given, nodes[i]["score"][a], nodes[j]["score"][b]) for i, j, a, b, given in _pairs(nodes)}
        wanted = found if kind != "path" else {p: found[p] for p in _chosen(kind, len(nodes), {})}
        tau = {p: kendall.counts(rows, u, v).head().tau_b or 0.0 for p, (_, _, _, u, v) in wanted.items()}
        edges, later, new = [], [], {}
        for p in _chosen(kind, len(nodes), {q: abs(t) for q, t in tau.items()}):
            a, b, given, u, v = wanted[p]
            fits = {f: t for f, t in parameters(tau[p]).items() if f in families}
            cu, cv = F.col(f"`{u}`"), F.col(f"`{v}`")
            means = rows.agg(*[F.avg(LOGPDF[f](cu, cv, t)).alias(f) for f, t in fits.items()]).head()
            best = max(fits, key=lambda f: (means[f], f))
            edges.append(Edge(a, b, given, best, fits[best], tau[p], (u, v)))
            up, down = _name(a, (*given, b)), _name(b, (*given, a))
            new |= {up: conditional(best, cu, cv, fits[best]), down: conditional(best, cv, cu, fits[best])}
            later.append({"all": {a, b, *given}, "score": {a: up, b: down}})
        vine.trees.append(edges)
        nodes = later
        if len(nodes) > 1:
            rows = written(rows.withColumns(new))
    return vine


def score(df: DataFrame, vine: Vine, name: str = "ll") -> DataFrame:
    """Add the log-density of the columns u_<column> of `df`."""
    rows = df.withColumn(name, F.lit(0.0))
    made = []
    for tree in vine.trees:
        terms, new = F.col(name), {}
        for e in tree:
            u, v = (F.col(f"`{c}`") for c in e.ends)
            terms = terms + LOGPDF[e.family](u, v, e.theta)
            new |= {_name(e.a, (*e.given, e.b)): conditional(e.family, u, v, e.theta), _name(e.b, (*e.given, e.a)): conditional(e.family, v, u, e.theta)}
        rows = rows.withColumns({name: terms, **new})
        made += new
    return rows.drop(*made)
