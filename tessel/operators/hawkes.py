"""Self-exciting point processes of several event types, by scans over chunks of sequences.

The rate of type i at time t is mu_i + sum_j alpha_ij sum_m w_m sum over past events of type j of
exp(-b_m (t - t_j)). One term (w = 1) is the exponential process, several stand for a power law
(`power_law_terms` gives the error). Along a sequence the decayed sums of each type and term (and the
same weighted by elapsed time, for fits) are all that the future needs, so chunks compose by decay
and addition. Events at the same time excite each other in the order they come in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.chunks import alive, blocks, chunked, over_chunks, padded, rows_of, scan, with_states
from tessel.sources.shared import scoped


@dataclass
class Hawkes:
    """Base rates (D), excitations (D, D; row: the excited type), decay rates and weights of the terms."""

    mu: np.ndarray
    alpha: np.ndarray
    decays: np.ndarray
    weights: np.ndarray

    @property
    def types(self) -> int:
        return len(self.mu)


def exponential(mu, alpha, beta: float) -> Hawkes:
    mu = np.atleast_1d(np.asarray(mu, float))
    return Hawkes(mu, np.asarray(alpha, float).reshape(len(mu), len(mu)), np.array([float(beta)]), np.array([1.0]))


def power_law_terms(c: float, power: float, longest: float, terms: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """Decays and weights whose exponentials add up to (t + c)^-power on [0, longest], and the largest relative error there.

    The kernel is an integral of exponentials over their rates with weight b^(power - 1) e^(-b c); the
    trapezium rule in the logarithm of the rate, with its weights fitted again by least squares.
    """
    rates = np.geomspace(0.01 / (longest + c), 40.0 / c, terms)
    t = np.concatenate([[0.0], np.geomspace(c * 1e-3, longest, 800)])
    want = (t + c) ** -power
    basis = np.exp(-np.outer(t, rates)) / want[:, None]
    from numpy.linalg import lstsq

    weights = lstsq(basis, np.ones(len(t)), rcond=1e-12)[0]
    return rates, weights, float(np.abs(basis @ weights - 1).max())


def power_law(mu, alpha, c: float, power: float, longest: float, terms: int = 40) -> Hawkes:
    """Excitation alpha (t + c)^-power up to the lag `longest`."""
    mu = np.atleast_1d(np.asarray(mu, float))
    decays, weights, _ = power_law_terms(c, power, longest, terms)
    return Hawkes(mu, np.asarray(alpha, float).reshape(len(mu), len(mu)), decays, weights)


def _sequences(df: DataFrame, key: str, time: str, kind: str | None, most: int | None) -> DataFrame:
    rows = df.select(F.col(key), F.col(time).cast("double").alias("t"), (F.col(kind) if kind else F.lit(0)).cast("double").alias("kind"))
    return chunked(rows, key, ["t", "kind"], ["t", "kind"], **({"most": most} if most else {}))


def _compose(size: int, decays: np.ndarray):
    """Payload: last time, decayed sums (types x terms), and the same times elapsed time."""
    d = np.tile(decays, size // len(decays))

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not np.isfinite(a[0]):
            return b
        gap = b[0] - a[0]
        fade = np.exp(-d * gap)
        ra, sa = a[1 : 1 + size], a[1 + size :]
        return np.concatenate([[b[0]], fade * ra + b[1 : 1 + size], fade * (sa + gap * ra) + b[1 + size :]])

    return run


def _run(t: np.ndarray, kind: np.ndarray, n: np.ndarray, enter: np.ndarray, model: Hawkes, visit=None) -> np.ndarray:
    """Carry states (chunks, 1 + 2 size) through padded events; `visit(row, b, types, r, s)` sees the decayed sums before each event."""
    d, terms = model.types, len(model.decays)
    size = d * terms
    at, r, s = enter[:, 0].copy(), enter[:, 1 : 1 + size].reshape(-1, d, terms).copy(), enter[:, 1 + size :].reshape(-1, d, terms).copy()
    for row in range(t.shape[1]):
        b = alive(n, row)
        gap = np.where(np.isfinite(at[:b]), t[:b, row] - np.where(np.isfinite(at[:b]), at[:b], 0.0), 0.0)
        fade = np.exp(-gap[:, None] * model.decays)[:, None, :]
        s[:b] = fade * (s[:b] + gap[:, None, None] * r[:b])
        r[:b] = fade * r[:b]
        types = kind[:b, row].astype(int)
        if visit is not None:
            visit(row, b, types, r[:b], s[:b])
        r[np.arange(b), types] += 1
        at[:b] = t[:b, row]
    return np.concatenate([at[:, None], r.reshape(len(n), size), s.reshape(len(n), size)], axis=1)


def _states(chunks: DataFrame, model: Hawkes) -> tuple[DataFrame, np.ndarray]:
    size = model.types * len(model.decays)
    none = np.concatenate([[np.nan], np.zeros(2 * size)])

    def run(n, starts, arrays, _found):
        out = np.zeros((len(n), 1 + 2 * size))
        for pick in blocks(n, 2 * size):
            t, kind = (padded(a, starts, n, pick) for a in arrays)
            out[pick] = _run(t, kind, n[pick], np.tile(none, (len(pick), 1)), model)
        return [rows_of(out)]

    payloads = over_chunks(chunks.where("edge"), ["t", "kind"], run, [("payload", "array<double>")], carry=("head",))
    compose = _compose(size, model.decays)
    return scan(payloads, compose, compose, none).withColumnRenamed("state", "enter"), none


def _sums(chunks: DataFrame, model: Hawkes, window: float) -> DataFrame:
    """key, n and per chunk: log, paid (compensator of its events), own (D), kids (D x D), wait (D x D), outside (events not in [0, window])."""
    states, none = _states(chunks, model)
    d, terms = model.types, len(model.decays)
    out_mass = model.alpha.sum(axis=0)

    def run(n, starts, arrays, found):
        enter = np.array([f if f is not None else none for f in found[0]], float).reshape(len(n), len(none))
        log, paid, outside = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
        own, kids, wait = np.zeros((len(n), d)), np.zeros((len(n), d, d)), np.zeros((len(n), d, d))
        for pick in blocks(n, 2 * d * terms):
            t, kind = (padded(a, starts, n, pick) for a in arrays)

            def visit(row, b, types, r, s, t=t, pick=pick):
                here = pick[:b]
                pull, slow = r @ model.weights, s @ model.weights
                rate = model.mu[types] + (model.alpha[types] * pull).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    log[here] += np.log(rate)
                    own[here, types] += model.mu[types] / rate
                    kids[here, types] += model.alpha[types] * pull / rate[:, None]
                    wait[here, types] += model.alpha[types] * slow / rate[:, None]
                left = window - t[:b, row]
                outside[here] += (t[:b, row] < 0) | (left < 0)
                mass = ((1 - np.exp(-np.maximum(left, 0)[:, None] * model.decays)) * model.weights / model.decays).sum(axis=1)
                paid[here] += out_mass[types] * mass

            _run(t, kind, n[pick], enter[pick], model, visit)
        return [pa.array(log), pa.array(paid), pa.array(outside), rows_of(own), rows_of(kids.reshape(len(n), -1)), rows_of(wait.reshape(len(n), -1))]

    fields = [("log", "double"), ("paid", "double"), ("outside", "double"), ("own", "array<double>"), ("kids", "array<double>"), ("wait", "array<double>")]
    return over_chunks(with_states(chunks, states), ["t", "kind"], run, fields, ("enter",), ("n",))


def loglik(df: DataFrame, key: str, time: str, model: Hawkes, window: float, kind: str | None = None, most: int | None = None) -> DataFrame:
    """(key, n, ll) of the events in [0, window]; `kind` holds their types from 0. An event outside makes ll -infinity."""
    per = _sums(_sequences(df, key, time, kind, most), model, window).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("log") - F.col("paid")).alias("ll"), F.sum("outside").alias("_o"))
    ll = F.when(F.col("_o") > 0, F.lit(float("-inf"))).otherwise(F.col("ll") - float(model.mu.sum()) * window)
    return per.select(F.col("key").alias(key), "n", ll.alias("ll"))


@scoped
def fit(df: DataFrame, key: str, time: str, model: Hawkes, window: float, steps: int = 10, kind: str | None = None, most: int | None = None) -> tuple[Hawkes, list[float]]:
    """EM over branching: every event is shared out between the base rate and the events before it.

    Every sequence is one run of length `window`. The decay of a one-term model is refitted from the
    mean delay of shared-out events, terms of a sum are kept. Excitations are what an event of a type
    brings forth within the window (delays cut off by its end count, through the compensator).
    """
    chunks, trace = _sequences(df, key, time, kind, most), []
    d = model.types
    runs = chunks.select("key").distinct().count()
    for _ in range(steps):
        per = _sums(chunks, model, window)
        add = lambda c, m: [F.sum(F.col(c)[i]).alias(f"{c}{i}") for i in range(m)]
        s = per.agg(F.sum(F.col("log") - F.col("paid")).alias("ll"), *add("own", d), *add("kids", d * d), *add("wait", d * d)).head()
        if s.ll is None:
            break
        trace.append(s.ll - float(model.mu.sum()) * window * runs)
        own, kids, wait = (np.array([s[f"{c}{i}"] for i in range(m)]) for c, m in (("own", d), ("kids", d * d), ("wait", d * d)))
        mass = _mass(chunks, model, window)
        alpha = np.divide(kids.reshape(d, d), mass[None, :], out=np.zeros((d, d)), where=mass[None, :] > 0)
        decays = model.decays
        if len(decays) == 1 and wait.sum() > 0:
            # With the decay b the delays average 1 / b; alpha is scaled so that each type's offspring stay the same.
            decays = np.array([kids.sum() / wait.sum()])
            again = _mass(chunks, Hawkes(model.mu, model.alpha, decays, model.weights), window)
            alpha = np.divide(kids.reshape(d, d), again[None, :], out=np.zeros((d, d)), where=again[None, :] > 0)
        model = Hawkes(own / (window * runs), alpha, decays, model.weights)
    return model, trace


@scoped
def fit_by_branching(df: DataFrame, key: str, time: str, window: float, steps: int = 10, start: tuple[float, float, float] = (0.1, 0.1, 1.0), most: int | None = None) -> tuple[float, float, float]:
    """(mu, alpha, beta) of one type: the branching ratio is the share of events that others brought forth, without a correction for the window's end."""
    chunks = _sequences(df, key, time, None, most)
    mu, alpha, beta = start
    runs = chunks.select("key").distinct().count()
    for _ in range(steps):
        s = _sums(chunks, exponential(mu, alpha, beta), window).agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[0]).alias(c) for c in ("own", "kids", "wait")]).head()
        if not s.n:
            break
        mu = s.own / (window * runs)
        beta = s.kids / s.wait if s.wait > 0 else beta
        alpha = beta * min(max(s.kids / s.n, 1e-6), 0.999)
    return float(mu), float(alpha), float(beta)


def _mass(chunks: DataFrame, model: Hawkes, window: float) -> np.ndarray:
    """For each type, the integral of the kernel from its events to the end of the window."""
    event = F.explode(F.arrays_zip("t", "kind"))
    left = F.greatest(F.lit(0.0), window - F.col("z.t"))
    each = sum(((1 - F.exp(-left * float(b))) * float(w / b) for b, w in zip(model.decays, model.weights, strict=True)), F.lit(0.0))
    got = chunks.select(event.alias("z")).groupBy(F.col("z.kind").cast("int").alias("kind")).agg(F.sum(each).alias("m")).where(f"kind < {model.types}").collect()
    out = np.zeros(model.types)
    for r in got:
        out[r.kind] = r.m
    return out
