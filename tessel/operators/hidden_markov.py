"""Hidden Markov models with any leaf family as emissions, by scans over chunks of sequences.

A chunk's transfer matrix carries the predicted state distribution at its first row to that at the
next chunk's first row; each row of it is kept with a scale of its own. Forward probabilities,
posteriors and expected counts then come chunk by chunk from the vectors on both sides; the likeliest
path from max-plus matrices and the states where chunks meet. Rows that no state can emit make their
sequence impossible: its log-likelihood is -infinity, and it adds nothing to expected counts. A
symbol that the model doesn't know is such a row; null values say nothing and are skipped over in
time (every state emits them alike).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.special import NEG_INF
from tessel.operators import families as fam
from tessel.operators.chunks import alive, blocks, chunked, entries, lists_of, over_chunks, padded, rows_of, scan, with_states
from tessel.sources.shared import scoped, written

#: Symbols of a categorical emission that go into expressions; more are joined.
FEW_SYMBOLS = 256


@dataclass
class FamilyEmission:
    """One family of `families.FAMILIES` per state, each with its parameters."""

    family: list[str]
    params: list[dict[str, float]]

    def score(self, x: Column) -> Column:
        """An array of the states' log-densities."""
        x = x.cast("double")
        each = [fam.FAMILIES[f].logpdf(x, {k: F.lit(float(v)) for k, v in p.items()}) for f, p in zip(self.family, self.params, strict=True)]
        return F.array(*[F.when(x.isNull(), 0.0).otherwise(F.coalesce(c, F.lit(NEG_INF))) for c in each])

    def refit(self, rows: DataFrame) -> FamilyEmission:
        """From rows (value, gamma), in one aggregation; a state without weight keeps its parameters."""
        x, aggregates = F.col("value").cast("double"), []
        rules = [fam.FAMILIES[f] for f in self.family]
        names = [list(r.stats(x, F.lit(1.0))) for r in rules]
        for i, r in enumerate(rules):
            aggregates += [c.alias(f"_{i}_{k}") for k, c in r.stats(x, F.col("gamma")[i]).items()]
            aggregates.append(F.sum(F.col("gamma")[i]).alias(f"_{i}_w"))
        sums = rows.where(x.isNotNull()).agg(*aggregates)
        closed = [c.cast("double").alias(f"{i}_{k}") for i, r in enumerate(rules) if r.solve for k, c in r.solve({k: F.col(f"_{i}_{k}") for k in names[i]}).items()]
        got = sums.select("*", *closed).head().asDict()
        out = []
        for i, r in enumerate(rules):
            if not got[f"_{i}_w"]:
                out.append(self.params[i])
            elif r.solve:
                out.append({k: got[f"{i}_{k}"] for k in r.params})
            else:
                out.append(r.solve_on_driver({k: float(got[f"_{i}_{k}"]) for k in names[i]}))
        return FamilyEmission(self.family, out)


@dataclass
class CategoricalEmission:
    """Probabilities of symbols in each state."""

    table: dict[object, list[float]]

    def score(self, x: Column) -> Column:
        states = len(next(iter(self.table.values())))
        logs = F.create_map(*[c for s, p in self.table.items() for c in (F.lit(s), F.array(*[F.lit(float(np.log(v)) if v > 0 else NEG_INF) for v in p]))])
        return F.when(x.isNull(), F.array(*[F.lit(0.0)] * states)).otherwise(F.coalesce(F.try_element_at(logs, x), F.array(*[F.lit(NEG_INF)] * states)))

    def refit(self, rows: DataFrame) -> CategoricalEmission:
        states = len(next(iter(self.table.values())))
        got = rows.where("value IS NOT NULL").groupBy("value").agg(*[F.sum(F.col("gamma")[k]).alias(f"g{k}") for k in range(states)]).limit(FEW_SYMBOLS + 1).collect()
        counts = {s: np.zeros(states) for s in self.table} | {r[0]: np.array(r[1:]) for r in got}
        total = sum(counts.values())
        return CategoricalEmission({s: [float(c[k] / total[k]) if total[k] > 0 else self.table.get(s, [0.0] * states)[k] for k in range(states)] for s, c in counts.items()})


Emission = FamilyEmission | CategoricalEmission


def scores_by_join(df: DataFrame, column: str, table: DataFrame, name: str = "scores") -> DataFrame:
    """Add the log-probabilities of a row's symbol from a table (symbol, p: array of the states' probabilities) of any size."""
    logs = table.select(F.col("symbol").alias("_symbol"), F.transform("p", lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(NEG_INF))).alias("_p"), F.size("p").alias("_k"))
    states = logs.agg(F.max("_k").alias("_states"))
    met = df.join(logs, F.col(column) == F.col("_symbol"), "left").crossJoin(F.broadcast(states))
    same = F.array_repeat(F.when(F.col(column).isNull(), 0.0).otherwise(F.lit(NEG_INF)), F.col("_states"))
    return met.select(*df.columns, F.coalesce("_p", same).alias(name))


def scored_chunks(df: DataFrame, key: str, order: list[str], value: str, emission: Emission | None, most: int | None = None) -> DataFrame:
    """Chunks with the list `scores`; `emission` None: column `value` already holds arrays of log-densities."""
    rows = chunked(df.withColumn("value", F.col(value)), key, order, ["value"], **({"most": most} if most else {}))
    return with_scores(rows, emission)


def with_scores(chunks: DataFrame, emission: Emission | None) -> DataFrame:
    return chunks.withColumn("scores", F.col("value") if emission is None else F.transform("value", emission.score))


def _emitted(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p times the densities exp(e), scaled to sum to 1 over the last axis (0 where impossible), and the logarithm of the sum.

    The scale is that of the states that p allows, so a density far below others' doesn't vanish.
    """
    logs = _log(p) + e
    top = logs.max(axis=-1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.exp(logs - top)
    total = out.sum(axis=-1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0), (_log(total) + top)[..., 0]


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _transfer(e: np.ndarray, n: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Payloads (chunks, K K + K): rows of the transfer matrix that sum to 1 or 0, and the logarithms of their scales."""
    k = len(moves)
    m, s = np.broadcast_to(np.eye(k), (len(n), k, k)).copy(), np.zeros((len(n), k))
    for t in range(e.shape[1]):
        b = alive(n, t)
        step, log = _emitted(m[:b], e[:b, t, None, :])
        m[:b] = step @ moves
        s[:b] += log
    return np.concatenate([m.reshape(len(n), k * k), s], axis=1)


def _mix(weights: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """weights * exp(logs) with its sum scaled to 1, and the logarithm of that sum."""
    live = weights > 0
    if not live.any() or np.max(logs[live]) == -np.inf:
        return np.zeros_like(weights), -np.inf
    top = np.max(logs[live])
    w = np.where(live, weights * np.exp(np.where(live, logs, top) - top), 0.0)
    return w / w.sum(), top + float(np.log(w.sum()))


def _compose(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ma, sa, mb, sb = a[: k * k].reshape(k, k), a[k * k :], b[: k * k].reshape(k, k), b[k * k :]
        m, s = np.zeros((k, k)), np.full(k, -np.inf)
        for i in range(k):
            w, log = _mix(ma[i], sb)
            m[i], s[i] = w @ mb, sa[i] + log
        return np.concatenate([m.ravel(), s])

    return run


def _carry(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(distribution, log scale) through a payload, forwards."""

    def run(state: np.ndarray, payload: np.ndarray) -> np.ndarray:
        w, log = _mix(state[:k], payload[k * k :])
        return np.append(w @ payload[: k * k].reshape(k, k), state[k] + log)

    return run


def _carry_back(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Relative chances of what comes after, for each state, through a payload backwards."""

    def run(state: np.ndarray, payload: np.ndarray) -> np.ndarray:
        ahead = payload[: k * k].reshape(k, k) @ state
        return _mix(ahead, payload[k * k :])[0]

    return run


def _local(e: np.ndarray, n: np.ndarray, moves: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered distributions (chunks, rows, K) and log-likelihoods of the chunks."""
    alpha, ll, p = np.zeros_like(e), np.zeros(len(n)), enter.copy()
    for t in range(e.shape[1]):
        b = alive(n, t)
        alpha[:b, t], log = _emitted(p[:b], e[:b, t])
        ll[:b] += log
        p[:b] = alpha[:b, t] @ moves
    return alpha, ll


def _known(found: list, start: np.ndarray) -> np.ndarray:
    """The state of each chunk from the scan, or that of a sequence's end."""
    return np.array([f if f is not None else start for f in found], float).reshape(len(found), len(start))


def _payloads(chunks: DataFrame, moves: np.ndarray, kernel=_transfer) -> DataFrame:
    """(key, chunk, head, payload) of the chunks that a scan needs."""
    k = len(moves)

    def run(n, starts, arrays, _states):
        out = np.zeros((len(n), k * k + k))
        for pick in blocks(n, k * k):
            out[pick] = kernel(padded(arrays[0], starts, n, pick), n[pick], moves)
        return [rows_of(out)]

    return over_chunks(chunks.where("edge"), ["scores"], run, [("payload", "array<double>")], carry=("head",))


def forward(df: DataFrame, key: str, order: list[str], value: str, emission: Emission | None, init: np.ndarray, moves: np.ndarray, most: int | None = None) -> DataFrame:
    """(key, n, ll): log-likelihood of each sequence."""
    init, moves = np.asarray(init, float), np.asarray(moves, float)
    chunks, k = scored_chunks(df, key, order, value, emission, most), len(init)
    states = scan(_payloads(chunks, moves), _compose(k), _carry(k), np.append(init, 0.0))

    def run(n, starts, arrays, found):
        enter, ll = _known(found[0], np.append(init, 0.0))[:, :k], np.zeros(len(n))
        for pick in blocks(n, k):
            ll[pick] = _local(padded(arrays[0], starts, n, pick), n[pick], moves, enter[pick])[1]
        return [pa.array(ll)]

    parts = over_chunks(with_states(chunks, states.withColumnRenamed("state", "enter")), ["scores"], run, [("ll", "double")], ("enter",), ("n",))
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ll").alias("ll")).withColumnRenamed("key", key)


def _both_sides(chunks: DataFrame, init: np.ndarray, moves: np.ndarray) -> DataFrame:
    """Chunks with `enter` (predicted states at the first row), `leave` (chances of what follows), `first` and `last`; null for whole sequences."""
    k = len(init)
    payloads = written(_payloads(chunks, moves))
    enter = scan(payloads, _compose(k), _carry(k), np.append(init, 0.0)).withColumnRenamed("state", "enter")
    leave = scan(payloads, _compose(k), _carry_back(k), np.ones(k) / k, reverse=True).withColumnRenamed("state", "leave")
    ends = payloads.groupBy("key").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    first, last = ends.select(F.col("a").alias("chunk"), F.lit(True).alias("first")), ends.select(F.col("b").alias("chunk"), F.lit(True).alias("last"))
    return with_states(chunks, enter.join(leave, "chunk").join(first, "chunk", "left").join(last, "chunk", "left"))


def _counts(e, n, moves, enter, leave, final):
    """Posteriors (chunks, rows, K), expected transitions (chunks, K, K) and log-likelihoods."""
    k = len(moves)
    alpha, ll = _local(e, n, moves, enter)
    gamma, xi = np.zeros_like(alpha), np.zeros((len(n), k, k))
    beta = np.zeros((len(n), k))
    ahead = np.zeros((len(n), k))
    for t in range(e.shape[1] - 1, -1, -1):
        b = alive(n, t)
        end = n[:b] == t + 1
        ahead[:b][end] = leave[:b][end]
        beta[:b] = ahead[:b] @ moves.T
        g = alpha[:b, t] * beta[:b]
        total = g.sum(axis=1)
        scale = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
        gamma[:b, t] = g * scale[:, None]
        move = alpha[:b, t, :, None] * moves * ahead[:b, None, :] * scale[:, None, None]
        move[end & final[:b]] = 0
        xi[:b] += move
        ahead[:b] = _emitted(beta[:b], e[:b, t])[0]
    return gamma, xi, ll


def posteriors(chunks: DataFrame, init: np.ndarray, moves: np.ndarray) -> DataFrame:
    """key, chunk, edge, value, ll, first, gamma (list of posteriors), xi (expected transitions) of every chunk."""
    k = len(init)

    def run(n, starts, arrays, found):
        alone = np.array([f is None for f in found[0]])
        enter, leave = _known(found[0], np.append(init, 0.0))[:, :k], _known(found[1], np.ones(k))
        first, final = (alone | np.array([bool(v) for v in f]) for f in found[2:])
        flat, xi, ll = np.zeros((int(n.sum()), k)), np.zeros((len(n), k * k)), np.zeros(len(n))
        for pick in blocks(n, k * k):
            g, x, ll[pick] = _counts(padded(arrays[0], starts, n, pick), n[pick], moves, enter[pick], leave[pick], final[pick])
            xi[pick] = x.reshape(len(pick), -1)
            live = np.arange(g.shape[1])[None, :] < n[pick][:, None]
            flat[(starts[pick][:, None] + np.arange(g.shape[1])[None, :])[live]] = g[live]
        # Where nothing possible follows, the sequence is impossible.
        ll[leave.sum(axis=1) <= 0] = -np.inf
        return [pa.array(ll), pa.array(first), lists_of(flat, n), rows_of(xi)]

    fields = [("ll", "double"), ("begins", "boolean"), ("gamma", "array<array<double>>"), ("xi", "array<double>")]
    return over_chunks(_both_sides(chunks, init, moves), ["scores"], run, fields, ("enter", "leave", "first", "last"), ("edge", "value"))


def smooth(df: DataFrame, key: str, order: list[str], value: str, emission: Emission | None, init: np.ndarray, moves: np.ndarray, most: int | None = None) -> DataFrame:
    """(key, t, gamma): the posterior of the states at every row, t from 0."""
    chunks = scored_chunks(df, key, order, value, emission, most)
    return entries(posteriors(chunks, np.asarray(init, float), np.asarray(moves, float)), chunks, key, "gamma")


@scoped
def baum_welch(df: DataFrame, key: str, order: list[str], value: str, emission: Emission, init: np.ndarray, moves: np.ndarray, steps: int = 5, most: int | None = None):
    """(emission, init, moves, trace of log-likelihoods of the possible sequences) after `steps` of EM.

    A state that nothing starts in or leaves keeps its row. Sequences that are impossible as a whole
    count for nothing; they are -infinity to `forward`.
    """
    init, moves = np.asarray(init, float), np.asarray(moves, float)
    raw = chunked(df.withColumn("value", F.col(value)), key, order, ["value"], **({"most": most} if most else {}))
    k, trace, parts = len(init), [], None
    for _ in range(steps):
        parts = written(posteriors(with_scores(raw, emission), init, moves), instead=parts)
        possible = F.col("ll") > F.lit(NEG_INF)
        start = F.when(F.col("begins"), F.col("gamma")[0])
        sums = parts.agg(
            F.sum(F.when(possible, F.col("ll"))).alias("ll"),
            F.array(*[F.coalesce(F.sum(start[i]), F.lit(0.0)) for i in range(k)]).alias("init"),
            F.array(*[F.coalesce(F.sum(F.col("xi")[i]), F.lit(0.0)) for i in range(k * k)]).alias("moves"),
        ).head()
        trace.append(float(sums.ll) if sums.ll is not None else NEG_INF)
        emission = emission.refit(parts.select(F.explode(F.arrays_zip("value", "gamma")).alias("z")).select("z.value", "z.gamma"))
        got = np.array(sums.init)
        init = got / got.sum() if got.sum() > 0 else init
        counts = np.array(sums.moves).reshape(k, k)
        total = counts.sum(axis=1, keepdims=True)
        moves = np.where(total > 0, np.divide(counts, total, out=np.zeros_like(counts), where=total > 0), moves)
    return emission, init, moves, trace


def _longest(e: np.ndarray, n: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Max-plus payloads (chunks, K K + K): best scores from the first row's state to the next chunk's, and to the chunk's end."""
    k, lm = len(moves), _log(moves)
    m = np.where(np.eye(k) > 0, 0.0, -np.inf) * np.ones((len(n), 1, 1))
    ends = np.zeros((len(n), k))
    for t in range(e.shape[1]):
        b = alive(n, t)
        here = m[:b] + e[:b, t, None, :]
        ends[:b] = here.max(axis=2)
        m[:b] = (here[:, :, :, None] + lm[None, None]).max(axis=2)
    return np.concatenate([m.reshape(len(n), k * k), ends], axis=1)


def viterbi(df: DataFrame, key: str, order: list[str], value: str, emission: Emission | None, init: np.ndarray, moves: np.ndarray, most: int | None = None) -> DataFrame:
    """(key, t, state): the likeliest state path of each sequence, ties to the smaller state; state null where a sequence is impossible."""
    init, moves = np.asarray(init, float), np.asarray(moves, float)
    chunks, k = scored_chunks(df, key, order, value, emission, most), len(init)
    payloads = written(_payloads(chunks, moves, _longest))
    li, lm = _log(init), _log(moves)

    def compose(a, b):
        ma, mb = a[: k * k].reshape(k, k), b[: k * k].reshape(k, k)
        return np.concatenate([(ma[:, :, None] + mb[None]).max(axis=1).ravel(), (ma + b[None, k * k :]).max(axis=1)])

    enter = scan(payloads, compose, lambda s, p: (s[:, None] + p[: k * k].reshape(k, k)).max(axis=0), li)

    # With the scores that a chunk begins with, the state it begins in follows from the one that the next begins in.
    def pointers(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s, p = np.array(batch.column("state").to_pylist()), np.array(batch.column("payload").to_pylist())
            choice = (s[:, :, None] + p[:, : k * k].reshape(-1, k, k)).argmax(axis=1)
            end = (s + p[:, k * k :]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), batch.column("head"), rows_of(np.concatenate([choice, end[:, None]], axis=1))], ["key", "chunk", "head", "payload"])

    kind = dict(chunks.dtypes)["key"]
    maps = written(payloads.join(enter, "chunk").select("key", "chunk", "head", "payload", "state").mapInArrow(pointers, f"key {kind}, chunk long, head long, payload array<double>"))
    # -1 stands for the end of a sequence, for which the last entry of a map counts.
    leave = scan(maps, lambda a, b: np.array([a[int(x)] for x in b]), lambda s, p: np.array([p[int(s[0])]]), np.array([-1.0]), reverse=True)
    leave = leave.select("chunk", F.col("state")[0].cast("int").alias("leave"))
    own = F.col("payload")[F.when(F.col("leave") < 0, F.lit(k)).otherwise(F.col("leave"))].cast("int")
    states = maps.join(leave, "chunk").select("chunk", "leave", own.alias("begin"))

    def run(n, starts, arrays, found):
        flat, lost_rows = np.zeros(int(n.sum()), np.int32), np.zeros(len(n), bool)
        final = np.array([-1 if f is None else f for f in found[0]])
        begin = np.array([li if f is None else np.where(np.arange(k) == f, 0.0, -np.inf) for f in found[1]])
        for pick in blocks(n, k * k):
            e, m = padded(arrays[0], starts, n, pick), n[pick]
            d, back = begin[pick].copy(), np.zeros((len(pick), e.shape[1], k), np.int32)
            tail = np.zeros((len(pick), k))
            for t in range(e.shape[1]):
                b = alive(m, t)
                tail[:b] = d[:b] + e[:b, t]
                onward = tail[:b, :, None] + lm
                back[:b, t] = onward.argmax(axis=1)
                d[:b] = onward.max(axis=1)
            # The state at a chunk's last row: by what follows, or the best there is.
            rows = np.arange(len(pick))
            state = np.where(final[pick] >= 0, back[rows, m - 1, np.maximum(final[pick], 0)], tail.argmax(axis=1))
            lost_rows[pick] = ~np.isfinite(tail.max(axis=1))
            for t in range(e.shape[1] - 1, -1, -1):
                b = alive(m, t)
                inner = np.flatnonzero(m[:b] > t + 1)
                state[inner] = back[inner, t, state[inner]]
                flat[starts[pick[:b]] + t] = state[:b]
        return [pa.array(lost_rows), lists_of(flat, n)]

    out = over_chunks(with_states(chunks, states), ["scores"], run, [("lost", "boolean"), ("state", "array<int>")], ("leave", "begin"), ("edge",))
    # One impossible chunk leaves the whole sequence without a path.
    lost = out.where("lost").select(F.col("key").alias("_k")).distinct().withColumn("_lost", F.lit(True))
    rows = entries(out, chunks, key, "state").join(lost, F.col(key).eqNullSafe(F.col("_k")), "left")
    return rows.select(key, "t", F.when(F.col("_lost").isNull(), F.col("state")).alias("state"))
