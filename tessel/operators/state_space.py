"""Linear Gaussian state spaces: filter, smoother, forecasts and EM, by scans over chunks of series.

States follow x_t = F x_{t-1} + w with w ~ N(0, Q), observations y_t = H x_t + v with v ~ N(0, R);
before the first row x ~ N(m, P). A chunk's map of the predicted state (A, b, C and the information
eta, J of its observations about where it began) composes with the next chunk's, so a long series is
filtered in as many tasks as it has partitions. The smoother runs the same way back, over affine maps.
A null or NaN observation is a row without information.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.chunks import alive, blocks, chunked, entries, lists_of, over_chunks, padded, rows_of, scan, with_states
from tessel.sources.shared import scoped, written


@dataclass(frozen=True)
class StateSpace:
    move: np.ndarray
    noise: np.ndarray
    see: np.ndarray
    error: float
    mean: np.ndarray
    spread: np.ndarray

    @property
    def size(self) -> int:
        return len(self.mean)


def autoregression(phi: float, q: float, r: float, mean: float, spread: float) -> StateSpace:
    """x_t = phi x_{t-1} + w, seen with noise; the state before the first move is N(mean, spread)."""
    return StateSpace(np.array([[phi]]), np.array([[q]]), np.array([1.0]), r, np.array([phi * mean]), np.array([[phi * phi * spread + q]]))


def local_level(q: float, r: float, mean: float, spread: float) -> StateSpace:
    return autoregression(1.0, q, r, mean, spread)


def structural(q_level: float, q_trend: float, r: float, mean: list[float], spread: float, season: int = 0, q_season: float = 0.0) -> StateSpace:
    """Level and trend, and a seasonal pattern of `season` steps that sums to nearly 0; `mean` is that of (level, trend, season - 1 effects)."""
    k = 2 + max(0, season - 1)
    move, noise, see = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
    move[0, :2], move[1, 1], see[0] = 1.0, 1.0, 1.0
    noise[0, 0], noise[1, 1] = q_level, q_trend
    if season > 1:
        move[2, 2:], see[2], noise[2, 2] = -1.0, 1.0, q_season
        for i in range(3, k):
            move[i, i - 1] = 1.0
    start = np.zeros(k)
    start[: len(mean)] = mean
    return StateSpace(move, noise, see, r, start, np.eye(k) * spread)


def _unpack(payload: np.ndarray, k: int):
    a, b, c, eta, j = np.split(payload, [k * k, k * k + k, 2 * k * k + k, 2 * k * k + 2 * k], axis=-1)
    square = lambda m: m.reshape(*m.shape[:-1], k, k)
    return square(a), b, square(c), eta, square(j)


def _pack(a, b, c, eta, j) -> np.ndarray:
    flat = lambda m: m.reshape(*m.shape[:-2], -1)
    return np.concatenate([flat(a), b, flat(c), eta, flat(j)], axis=-1)


def _join(one, two):
    """The map of `one` followed by `two`; leading axes are chunks."""
    a1, b1, c1, e1, j1 = one
    a2, b2, c2, e2, j2 = two
    t = lambda m: np.swapaxes(m, -1, -2)
    eye = np.eye(a1.shape[-1])
    right = np.linalg.solve(t(eye + c1 @ j2), t(a2))  # (A2 (I + C1 J2)^-1) transposed
    gain = t(right)
    left = t(np.linalg.solve(t(eye + j2 @ c1), a1))  # A1' (I + J2 C1)^-1
    v = lambda m, x: (m @ x[..., None])[..., 0]
    return gain @ a1, v(gain, b1 + v(c1, e2)) + b2, gain @ c1 @ t(a2) + c2, v(left, e2 - v(j2, b1)) + e1, left @ j2 @ a1 + j1


def _element(y: np.ndarray, model: StateSpace):
    """The map of single rows (batch of observations, NaN where there is none)."""
    n, k = len(y), model.size
    seen = np.isfinite(y)
    info = np.where(seen, np.where(seen, y, 0.0) / model.error, 0.0)
    full = lambda m: np.broadcast_to(m, (n, *m.shape)).copy()
    return full(model.move), np.zeros((n, k)), full(model.noise), info[:, None] * model.see, (seen / model.error)[:, None, None] * np.outer(model.see, model.see)


def _through(model: StateSpace):
    k = model.size

    def run(state: np.ndarray, payload: np.ndarray) -> np.ndarray:
        m, p = state[:k], state[k:].reshape(k, k)
        a, b, c, eta, j = _unpack(payload, k)
        gain = a @ np.linalg.inv(np.eye(k) + p @ j)
        return np.concatenate([gain @ (m + p @ eta) + b, (gain @ p @ a.T + c).ravel()])

    return run


def _payloads(chunks: DataFrame, model: StateSpace) -> DataFrame:
    k = model.size

    def run(n, starts, arrays, _states):
        out = np.zeros((len(n), 3 * k * k + 2 * k))
        for pick in blocks(n, 3 * k * k):
            y, m = padded(arrays[0], starts, n, pick), n[pick]
            whole = _element(y[:, 0], model)
            for t in range(1, y.shape[1]):
                b = alive(m, t)
                part = _join(tuple(w[:b] for w in whole), _element(y[:b, t], model))
                for w, p in zip(whole, part, strict=True):
                    w[:b] = p
            out[pick] = _pack(*whole)
        return [rows_of(out)]

    return over_chunks(chunks.where("edge"), ["value"], run, [("payload", "array<double>")], carry=("head",))


def _filtered(y: np.ndarray, n: np.ndarray, model: StateSpace, state: np.ndarray):
    """Filtered means and covariances of every row, log-likelihoods of the chunks, and the last prediction."""
    k = model.size
    m, p = state[:, :k].copy(), state[:, k:].reshape(-1, k, k).copy()
    means, spreads, ll = np.zeros((*y.shape, k)), np.zeros((*y.shape, k, k)), np.zeros(len(n))
    for t in range(y.shape[1]):
        b = alive(n, t)
        seen = np.isfinite(y[:b, t])
        ph = p[:b] @ model.see
        s = ph @ model.see + model.error
        gap = np.where(seen, y[:b, t] - m[:b] @ model.see, 0.0)
        gain = np.where(seen, 1.0, 0.0)[:, None] * ph / s[:, None]
        ll[:b] -= np.where(seen, 0.5 * (np.log(2 * math.pi * s) + gap * gap / s), 0.0)
        means[:b, t] = m[:b] + gain * gap[:, None]
        kept = p[:b] - gain[:, :, None] * ph[:, None, :]
        spreads[:b, t] = (kept + np.swapaxes(kept, 1, 2)) / 2
        m[:b] = means[:b, t] @ model.move.T
        p[:b] = model.move @ spreads[:b, t] @ model.move.T + model.noise
    return means, spreads, ll


def _series(df: DataFrame, key: str, order: list[str], value: str, most: int | None) -> DataFrame:
    rows = df.withColumn("value", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))))
    return chunked(rows, key, order, ["value"], **({"most": most} if most else {}))


def _start(model: StateSpace) -> np.ndarray:
    return np.concatenate([model.mean, model.spread.ravel()])


def _states(found: list, start: np.ndarray) -> np.ndarray:
    return np.array([f if f is not None else start for f in found], float).reshape(len(found), len(start))


def _entered(chunks: DataFrame, model: StateSpace) -> DataFrame:
    k = model.size
    compose = lambda a, b: _pack(*_join(_unpack(a, k), _unpack(b, k)))
    return scan(_payloads(chunks, model), compose, _through(model), _start(model)).withColumnRenamed("state", "enter")


def kalman_filter(df: DataFrame, key: str, order: list[str], value: str, model: StateSpace, most: int | None = None) -> DataFrame:
    """(key, n, ll, mean): rows, log-likelihood and the last filtered state of each series."""
    chunks, start = _series(df, key, order, value, most), _start(model)

    def run(n, starts, arrays, found):
        enter, ll, last = _states(found[0], start), np.zeros(len(n)), np.zeros((len(n), model.size))
        for pick in blocks(n, model.size**2 + model.size):
            means, _, ll[pick] = _filtered(padded(arrays[0], starts, n, pick), n[pick], model, enter[pick])
            last[pick] = means[np.arange(len(pick)), n[pick] - 1]
        return [pa.array(ll), rows_of(last)]

    parts = over_chunks(with_states(chunks, _entered(chunks, model)), ["value"], run, [("ll", "double"), ("last", "array<double>")], ("enter",), ("n",))
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ll").alias("ll"), F.max_by("last", "chunk").alias("mean")).withColumnRenamed("key", key)


def forecast(filtered: DataFrame, model: StateSpace, steps: int) -> DataFrame:
    """Add `forecast`: the expected observations of the next `steps` rows of each series."""
    weights, at = [], np.eye(model.size)
    for _ in range(steps):
        at = model.move @ at
        weights.append(model.see @ at)
    each = [sum((F.col("mean")[i] * float(w[i]) for i in range(model.size)), F.lit(0.0)) for w in weights]
    return filtered.withColumn("forecast", F.array(*each))


def _backward(means: np.ndarray, spreads: np.ndarray, n: np.ndarray, model: StateSpace):
    """Affine maps (E, g, L) from the next row's smoothed state to each row's; those beyond a chunk's end mean nothing."""
    spreads = np.where((np.arange(means.shape[1]) < n[:, None])[:, :, None, None], spreads, np.eye(model.size))
    ahead = model.move @ spreads @ model.move.T + model.noise
    try:
        e = np.swapaxes(np.linalg.solve(ahead, model.move @ spreads), -1, -2)
    except np.linalg.LinAlgError:  # a part of the state that is known for certain
        e = np.swapaxes(np.linalg.pinv(ahead, hermitian=True) @ model.move @ spreads, -1, -2)
    g = means - (e @ (means @ model.move.T)[..., None])[..., 0]
    return e, g, spreads - e @ ahead @ np.swapaxes(e, -1, -2)


def smoothed_chunks(chunks: DataFrame, model: StateSpace) -> DataFrame:
    """key, chunk, edge, ll, x0 (smoothed mean of a series' first row, else null), xs and ps (smoothed means and covariances of the rows), sums.

    `sums` of a chunk, over its rows t that have a row after: E[x' x], E[x x], E[x' x'] (x' is the row
    after, also where it lies in the next chunk) and their number; over rows with an observation:
    E[(y - H x)^2] and their number.
    """
    k, start = model.size, _start(model)
    entered = written(_entered(chunks, model))
    edges = with_states(chunks, entered).where("edge")
    ends = chunks.where("edge").groupBy("key").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    last, first = (ends.select(F.col(c).alias("chunk"), F.lit(True).alias(name)) for c, name in (("b", "last"), ("a", "first")))

    def maps(n, starts, arrays, found):
        enter, out = _states(found[0], start), np.zeros((len(n), 2 * k * k + k))
        final = np.array([bool(v) for v in found[1]])
        for pick in blocks(n, 3 * k * k):
            means, spreads, _ = _filtered(padded(arrays[0], starts, n, pick), n[pick], model, enter[pick])
            e, g, spread = _backward(means, spreads, n[pick], model)
            # The last row of a series is what it was filtered to be.
            rows = np.flatnonzero(final[pick])
            at = n[pick][rows] - 1
            e[rows, at], g[rows, at], spread[rows, at] = 0.0, means[rows, at], spreads[rows, at]
            we, wg, wl = e[:, 0].copy(), g[:, 0].copy(), spread[:, 0].copy()
            for t in range(1, means.shape[1]):
                b = alive(n[pick], t)
                wg[:b] += (we[:b] @ g[:b, t][..., None])[..., 0]
                wl[:b] += we[:b] @ spread[:b, t] @ np.swapaxes(we[:b], 1, 2)
                we[:b] = we[:b] @ e[:b, t]
            out[pick] = np.concatenate([we.reshape(len(pick), -1), wg, wl.reshape(len(pick), -1)], axis=1)
        return [rows_of(out)]

    payloads = over_chunks(edges.join(last, "chunk", "left"), ["value"], maps, [("payload", "array<double>")], ("enter", "last"), ("head",))
    split = lambda p: (p[: k * k].reshape(k, k), p[k * k : k * k + k], p[k * k + k :].reshape(k, k))

    def compose(a, b):
        (ea, ga, la), (eb, gb, lb) = split(a), split(b)
        return np.concatenate([(ea @ eb).ravel(), ea @ gb + ga, (ea @ lb @ ea.T + la).ravel()])

    def back(state, p):
        e, g, spread = split(p)
        return np.concatenate([e @ state[:k] + g, (e @ state[k:].reshape(k, k) @ e.T + spread).ravel()])

    leave = scan(payloads, compose, back, np.zeros(k + k * k), reverse=True).withColumnRenamed("state", "leave")
    states = entered.join(leave, "chunk").join(first, "chunk", "left").join(last, "chunk", "left")

    def run(n, starts, arrays, found):
        alone = np.array([f is None for f in found[0]])
        enter, after = _states(found[0], start), _states(found[1], np.zeros(k + k * k))
        begins, final = (alone | np.array([bool(v) for v in f]) for f in found[2:])
        xs, ps, ll = np.zeros((int(n.sum()), k)), np.zeros((int(n.sum()), k * k)), np.zeros(len(n))
        sums, outer = np.zeros((len(n), 3 * k * k + 3)), lambda u, v: u[:, :, None] * v[:, None, :]
        for pick in blocks(n, 3 * k * k):
            m, y = n[pick], padded(arrays[0], starts, n, pick)
            means, spreads, ll[pick] = _filtered(y, m, model, enter[pick])
            e, g, spread = _backward(means, spreads, n[pick], model)
            x, p = after[pick, :k].copy(), after[pick, k:].reshape(-1, k, k).copy()
            for t in range(means.shape[1] - 1, -1, -1):
                b = alive(m, t)
                end = (m[:b] == t + 1) & final[pick][:b]
                nx = (e[:b, t] @ x[:b][..., None])[..., 0] + g[:b, t]
                np_ = e[:b, t] @ p[:b] @ np.swapaxes(e[:b, t], 1, 2) + spread[:b, t]
                nx[end], np_[end] = means[:b, t][end], spreads[:b, t][end]
                cross = p[:b] @ np.swapaxes(e[:b, t], 1, 2) + outer(x[:b], nx)
                seen = np.isfinite(y[:b, t])
                error = np.where(seen, (np.where(seen, y[:b, t], 0.0) - nx @ model.see) ** 2 + (np_ @ model.see) @ model.see, 0.0)
                pair = np.concatenate([v.reshape(b, -1) for v in (cross, np_ + outer(nx, nx), p[:b] + outer(x[:b], x[:b]), np.ones((b, 1)))], axis=1)
                sums[pick[:b], : 3 * k * k + 1] += np.where(end[:, None], 0.0, pair)
                sums[pick[:b], -2] += error
                sums[pick[:b], -1] += seen
                x[:b], p[:b] = nx, np_
                xs[starts[pick[:b]] + t], ps[starts[pick[:b]] + t] = nx, np_.reshape(-1, k * k)
        firsts = pa.array([xs[s].tolist() if f else None for s, f in zip(starts, begins, strict=True)], pa.list_(pa.float64()))
        return [pa.array(ll), firsts, lists_of(xs, n), lists_of(ps, n), rows_of(sums)]

    fields = [("ll", "double"), ("x0", "array<double>"), ("xs", "array<array<double>>"), ("ps", "array<array<double>>"), ("sums", "array<double>")]
    return over_chunks(with_states(chunks, states), ["value"], run, fields, ("enter", "leave", "first", "last"), ("edge",))


def kalman_smoother(df: DataFrame, key: str, order: list[str], value: str, model: StateSpace, most: int | None = None) -> DataFrame:
    """(key, t, mean, spread): the smoothed state of every row, t from 0; `spread` is its covariance, row by row."""
    chunks = _series(df, key, order, value, most)
    both = smoothed_chunks(chunks, model).withColumn("z", F.arrays_zip("xs", "ps"))
    return entries(both, chunks, key, "z").select(key, "t", F.col("z.xs").alias("mean"), F.col("z.ps").alias("spread"))


@scoped
def fit_autoregression(df: DataFrame, key: str, order: list[str], value: str, phi: float | None = None, steps: int = 20, start: tuple[float, float, float, float] | None = None, most: int | None = None):
    """(phi, q, r, mean, trace of log-likelihoods) of a state shared by all series, by EM; phi given: kept (1: a local level).

    Every step sums the chunks' smoothed second moments. Each series' first state is N(mean, spread);
    `start` is (q, r, mean, spread), by default shares of the values' variance and their mean; the
    spread is kept.
    """
    chunks = _series(df, key, order, value, most)
    moments = chunks.select(F.explode("value").alias("v")).where("NOT isnan(v)").agg(F.var_pop("v").alias("v"), F.avg("v").alias("m")).head()
    variance = max(moments.v or 0.0, 1e-6)
    q, r, mean, spread = start or (0.1 * variance, 0.5 * variance, moments.m or 0.0, variance)
    free, phi, trace = phi is None, 0.5 if phi is None else phi, []
    for _ in range(steps):
        model = replace(autoregression(phi, q, r, mean, spread), mean=np.array([mean]), spread=np.array([[spread]]))
        both = smoothed_chunks(chunks, model)
        s = both.agg(F.sum("ll").alias("ll"), F.avg(F.col("x0")[0]).alias("mean"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(6)]).head()
        if s.ll is None:
            break
        trace.append(s.ll)
        if s.s3:
            phi = s.s0 / s.s1 if free and s.s1 > 0 else phi
            q = max((s.s2 - 2 * phi * s.s0 + phi * phi * s.s1) / s.s3, 1e-8)
        r = max(s.s4 / s.s5, 1e-8) if s.s5 else r
        mean = s.mean
    return phi, q, r, mean, trace
