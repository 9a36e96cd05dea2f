"""A truncated Dirichlet-process mixture of records, by variational updates of conjugate posteriors.

Sticks are Beta, each leaf of the record has its own conjugate posterior per component. A step is one
aggregation: responsibilities are column expressions of the expected log-densities, and the weighted
sums of all components and leaves come back in one row. The bound is the sum of the rows' log
normalisers less the divergences of sticks and leaves from their priors; it never falls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.special import digamma, lgamma, log_sum_exp

_LN_2PI = math.log(2 * math.pi)


@dataclass(frozen=True)
class NormalGamma:
    """A real column: mean and precision. Prior: mean m, strength k, shape a, rate b."""

    column: str
    prior: tuple[float, float, float, float]
    sums = ("s1", "s2")

    def stats(self, x: Column, w: Column) -> dict[str, Column]:
        return {"s1": F.sum(w * x), "s2": F.sum(w * x * x)}

    def update(self, n: float, s: dict[str, float]) -> tuple[float, ...]:
        m, k, a, b = self.prior
        if n <= 0:
            return self.prior
        mean = s["s1"] / n
        spread = max(s["s2"] - n * mean * mean, 0.0)
        return ((k * m + s["s1"]) / (k + n), k + n, a + n / 2, b + spread / 2 + k * n * (mean - m) ** 2 / (2 * (k + n)))

    def expected(self, x: Column, q: tuple[float, ...]) -> Column:
        m, k, a, b = q
        return 0.5 * (digamma(a) - math.log(b) - _LN_2PI - 1 / k) - (a / (2 * b)) * (x - m) ** 2

    def divergence(self, q: tuple[float, ...]) -> float:
        (m0, k0, a0, b0), (m, k, a, b) = self.prior, q
        gamma = (a - a0) * digamma(a) - math.lgamma(a) + math.lgamma(a0) + a0 * (math.log(b) - math.log(b0)) + a * (b0 - b) / b
        return gamma + 0.5 * (math.log(k / k0) + k0 / k - 1 + k0 * (m - m0) ** 2 * a / b)


@dataclass(frozen=True)
class GammaRate:
    """A count (Poisson) or a positive real (exponential with a rate). Prior: shape a, rate b."""

    column: str
    prior: tuple[float, float]
    poisson: bool = True
    sums = ("s1",)

    def stats(self, x: Column, w: Column) -> dict[str, Column]:
        return {"s1": F.sum(w * x)}

    def update(self, n: float, s: dict[str, float]) -> tuple[float, ...]:
        a, b = self.prior
        return (a + s["s1"], b + n) if self.poisson else (a + n, b + s["s1"])

    def expected(self, x: Column, q: tuple[float, ...]) -> Column:
        a, b = q
        log = digamma(a) - math.log(b)
        return x * log - a / b - lgamma(x + 1) if self.poisson else log - x * (a / b)

    def divergence(self, q: tuple[float, ...]) -> float:
        (a0, b0), (a, b) = self.prior, q
        return (a - a0) * digamma(a) - math.lgamma(a) + math.lgamma(a0) + a0 * (math.log(b) - math.log(b0)) + a * (b0 - b) / b


@dataclass(frozen=True)
class DirichletLevels:
    """A column of given levels; any other value has density 0. Prior: the same weight for each."""

    column: str
    levels: tuple
    weight: float = 1.0

    @property
    def sums(self) -> tuple[str, ...]:
        return tuple(f"l{i}" for i in range(len(self.levels)))

    def stats(self, x: Column, w: Column) -> dict[str, Column]:
        return {f"l{i}": F.sum(F.when(x == v, w).otherwise(0.0)) for i, v in enumerate(self.levels)}

    def update(self, n: float, s: dict[str, float]) -> tuple[float, ...]:
        return tuple(self.weight + s[f"l{i}"] for i in range(len(self.levels)))

    def expected(self, x: Column, q: tuple[float, ...]) -> Column:
        total, out = digamma(sum(q)), F.lit(float("-inf"))
        for v, a in zip(self.levels, q, strict=True):
            out = F.when(x == v, digamma(a) - total).otherwise(out)
        return out

    def divergence(self, q: tuple[float, ...]) -> float:
        total, k = sum(q), len(q)
        out = math.lgamma(total) - sum(map(math.lgamma, q)) - math.lgamma(k * self.weight) + k * math.lgamma(self.weight)
        return out + sum((a - self.weight) * (digamma(a) - digamma(total)) for a in q)


Leaf = NormalGamma | GammaRate | DirichletLevels


@dataclass
class Mixture:
    """Stick posteriors (a, b) of all components but the last, and the leaves' posteriors of each component."""

    leaves: list[Leaf]
    concentration: float
    sticks: list[tuple[float, float]]
    posteriors: list[list[tuple[float, ...]]]

    def expected_weights(self) -> list[float]:
        """Expected logarithms of the components' weights."""
        out, rest = [], 0.0
        for a, b in self.sticks:
            both = digamma(a + b)
            out.append(rest + digamma(a) - both)
            rest += digamma(b) - both
        return [*out, rest]

    def weights(self) -> list[float]:
        """Expected weights."""
        out, rest = [], 1.0
        for a, b in self.sticks:
            out.append(rest * a / (a + b))
            rest *= b / (a + b)
        return [*out, rest]

    def terms(self) -> list[Column]:
        """Per component the expected log-weight and log-density of a row; a null value of a leaf says nothing."""
        out = []
        for log, mine in zip(self.expected_weights(), self.posteriors, strict=True):
            term = F.lit(log)
            for leaf, q in zip(self.leaves, mine, strict=True):
                x = F.col(leaf.column)
                term = term + F.when(x.isNull(), 0.0).otherwise(leaf.expected(x if isinstance(leaf, DirichletLevels) else x.cast("double"), q))
            out.append(term)
        return out

    def divergence(self) -> float:
        """Of sticks and leaves from their priors."""
        c, out = self.concentration, 0.0
        for a, b in self.sticks:
            out += math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - math.log(c) + (a - 1) * (digamma(a) - digamma(a + b)) + (b - c) * (digamma(b) - digamma(a + b))
        return out + sum(leaf.divergence(q) for mine in self.posteriors for leaf, q in zip(self.leaves, mine, strict=True))


def start(leaves: list[Leaf], concentration: float, components: list[list[dict[str, float] | tuple]], counts: list[float]) -> Mixture:
    """A mixture whose components are as if they had seen `counts` rows with the given sums (a dictionary per leaf)."""
    posteriors = [[leaf.update(n, s) for leaf, s in zip(leaves, mine, strict=True)] for n, mine in zip(counts, components, strict=True)]
    return Mixture(leaves, concentration, _sticks(counts, concentration), posteriors)


def _sticks(counts: list[float], concentration: float) -> list[tuple[float, float]]:
    return [(1 + n, concentration + sum(counts[i + 1 :])) for i, n in enumerate(counts[:-1])]


def step(df: DataFrame, model: Mixture) -> tuple[Mixture, float]:
    """One update of all posteriors, and the bound that the model before it had. Rows that no component can have are left out of both."""
    k, impossible = len(model.posteriors), F.lit(float("-inf"))
    rows = df.select("*", *[t.alias(f"_t{i}") for i, t in enumerate(model.terms())])
    rows = rows.withColumn("_z", log_sum_exp(*[F.col(f"_t{i}") for i in range(k)])).where(F.col("_z") > impossible)
    rows = rows.select("*", *[F.exp(F.col(f"_t{i}") - F.col("_z")).alias(f"_r{i}") for i in range(k)])
    wanted = [F.sum("_z").alias("z")]
    for i in range(k):
        wanted.append(F.sum(f"_r{i}").alias(f"n{i}"))
        for j, leaf in enumerate(model.leaves):
            x = F.col(leaf.column)
            held = F.when(x.isNotNull(), F.col(f"_r{i}")).otherwise(0.0)
            value = x if isinstance(leaf, DirichletLevels) else F.coalesce(x.cast("double"), F.lit(0.0))
            wanted.append(F.sum(held).alias(f"n{i}_{j}"))
            wanted += [c.alias(f"s{i}_{j}_{name}") for name, c in leaf.stats(value, held).items()]
    got = rows.agg(*wanted).head()
    bound = (got.z or 0.0) - model.divergence()
    counts = [got[f"n{i}"] or 0.0 for i in range(k)]
    posteriors = [[leaf.update(got[f"n{i}_{j}"] or 0.0, {s: got[f"s{i}_{j}_{s}"] or 0.0 for s in leaf.sums}) for j, leaf in enumerate(model.leaves)] for i in range(k)]
    return Mixture(model.leaves, model.concentration, _sticks(counts, model.concentration), posteriors), bound


def fit(df: DataFrame, model: Mixture, steps: int = 50, tolerance: float = 1e-8) -> tuple[Mixture, list[float]]:
    """The model after at most `steps` updates, and the bounds before each."""
    trace: list[float] = []
    for _ in range(steps):
        model, bound = step(df, model)
        trace.append(bound)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
            break
    return model, trace


def classify(df: DataFrame, model: Mixture, name: str = "component") -> DataFrame:
    """Add the likeliest component of each row, ties to the smaller; null where none can have it."""
    terms = model.terms()
    best, pick = F.greatest(*terms), F.lit(len(terms) - 1)
    for i in range(len(terms) - 2, -1, -1):
        pick = F.when(terms[i] == best, i).otherwise(pick)
    return df.withColumn(name, F.when(best > float("-inf"), pick))
