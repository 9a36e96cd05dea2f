"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's evidence are binned figures of the line itself and of
its neighbours (share of capitals, signs, bars, digits; repeated words; distinct words; length of
words and of the line); the chain adds one weight per pair of neighbouring labels. The forward-
backward recursions give each line's marginal probability of being good; weighted by the lines'
bytes they add up to the document's, which a logistic curve fitted on the same labelled sample
turns into a score.

Training takes a bounded sample of labelled documents (lines take their document's label) and
maximises the conditional likelihood on the driver in numpy; its result has a few hundred numbers.
Texts are read in tasks: the driver gets each line's bins and bytes, 13 bytes a line, and goes
through them in blocks of documents.

Results for odd input: null and empty texts are one empty line; without labels of both kinds every
score is 1 (nothing is rejected); repeated rows give one row each; doc_id may be null; of
contradictory labels of one doc_id the smallest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import crc_mod, lean, small_batches, table
from tessel.llm.words import batches_by_bytes, words

#: Labelled documents learned from: of each kind at most so many, those of smallest hash.
PER_KIND = 1500
#: Bins of a figure, from 0 to 1. Bin 0 stands for exactly none, the last for a neighbour that is missing.
BINS = 8
WIDTH, MISSING = BINS + 2, BINS + 1
#: Lines of a block in training; a longer document is a block of its own.
BLOCK = 1 << 16
#: Byte classes counted per line.
UPPER, OTHER, DIGIT, SPACE, SIGN, BAR, BANG, STOP = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            out[b] = OTHER
        elif "A" <= c <= "Z":
            out[b] = UPPER
        elif c.isdigit():
            out[b] = DIGIT
        elif c.isspace():
            out[b] = SPACE
    for c, k in (("|", BAR), ("!", BANG), (".", STOP), (",", STOP)):
        out[ord(c)] = k
    return out


_CLASS = _classes()
FIGURES = 9


def line_figures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures in 0..1 (line, figure), the bytes of each line, and the lines of each text."""
    buffer = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends)
    of = np.repeat(np.arange(n, dtype=np.int64), ends - starts + 1)
    count = np.bincount(of * 8 + _CLASS[raw], minlength=n * 8).reshape(n, 8).astype(np.float64)
    count[:, SPACE] -= 1  # its own end
    size = (ends - starts).astype(np.float64)
    ink = np.maximum(size - count[:, SPACE], 1)
    w_start, w_end, key = words(buffer)
    line = of[w_start]
    n_words = np.bincount(line, minlength=n).astype(np.float64)
    again = np.bincount(line[1:][(key[1:] == key[:-1]) & (line[1:] == line[:-1])], minlength=n) if len(key) > 1 else np.zeros(n)
    order = np.lexsort((key, line))
    k2, l2 = key[order], line[order]
    fresh = np.ones(len(k2), bool)
    fresh[1:] = (k2[1:] != k2[:-1]) | (l2[1:] != l2[:-1])
    distinct = np.bincount(l2[fresh], minlength=n)
    least = np.maximum(n_words, 1)
    letters = np.maximum(count[:, UPPER] + count[:, OTHER], 1)
    figures = np.stack(
        [
            count[:, UPPER] / letters,
            np.minimum(2 * count[:, SIGN] / ink, 1),
            np.minimum(4 * count[:, BAR] / least, 1) ** 0.5,
            np.minimum(count[:, BANG] / least, 1),
            count[:, DIGIT] / ink,
            np.minimum(count[:, STOP] / least, 1),
            again / least,
            1 - distinct / least,
            np.minimum(np.log1p(size) / 10, 1),
        ],
        axis=1,
    )
    figures[n_words == 0, 5:8] = 0
    return figures, size, np.array([t.count(b"\n") + 1 for t in texts])


def bins(figures: np.ndarray) -> np.ndarray:
    """Bin of each figure of each line (figure, line)."""
    own = np.where(figures <= 0, 0, 1 + np.minimum((figures * BINS).astype(np.int64), BINS - 1))
    return np.ascontiguousarray(own.T, np.uint8)


N_WEIGHTS = 3 * FIGURES * WIDTH


def _ends(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and the last line of each text."""
    last = np.cumsum(lines) - 1
    return last - lines + 1, last


def line_evidence(weights: np.ndarray, own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Sum of the weights of each line: one for each of its own bins, of the line's before it and of the line's after it."""
    w = weights.reshape(3, FIGURES, WIDTH)
    out, before, after = (sum(w[k, f][own[f]] for f in range(FIGURES)) for k in range(3))
    first, last = _ends(lines)
    before, after = np.roll(before, 1), np.roll(after, -1)
    before[first], after[last] = w[1, :, MISSING].sum(), w[2, :, MISSING].sum()
    return out + before + after


def gathered(rest: np.ndarray, own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Of each weight, the sum of `rest` over the lines that have it."""
    first, last = _ends(lines)
    following, previous = np.roll(rest, -1), np.roll(rest, 1)
    following[last], previous[first] = 0, 0
    out = np.array([[np.bincount(own[f], r, WIDTH) for f in range(FIGURES)] for r in (rest, following, previous)])
    out[1, :, MISSING] += rest[first].sum()
    out[2, :, MISSING] += rest[last].sum()
    return out.ravel()


def chain(evidence: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good per line, expected label pairs (2, 2), and the sum of log partition values.

    Texts of all lengths run side by side: step t handles the t-th line of every text that has one.
    """
    n_docs = len(lines)
    order = np.argsort(-lines, kind="stable")
    long = lines[order]
    first = (np.cumsum(lines) - lines)[order]
    deepest = int(long[0]) if n_docs else 0
    alive = np.searchsorted(-long, -np.arange(1, deepest + 1), side="right")
    score = np.stack([np.zeros_like(evidence), evidence], axis=1)  # bad, good
    alpha = np.empty_like(score)
    beta = np.zeros_like(score)
    for t in range(deepest):
        k = first[: alive[t]] + t
        alpha[k] = score[k] if t == 0 else score[k] + np.logaddexp(alpha[k - 1, :1] + trans[0], alpha[k - 1, 1:] + trans[1])
    for t in range(deepest - 2, -1, -1):
        k = first[: alive[t + 1]] + t
        nxt = score[k + 1] + beta[k + 1]
        beta[k] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    ends = first + long - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.empty(n_docs)
    z[order] = log_z
    of = np.repeat(np.arange(n_docs), lines)
    marginal = np.exp(np.minimum(alpha + beta - z[of][:, None], 0))
    inner = np.ones(len(evidence), bool)
    inner[np.cumsum(lines) - lines] = False
    k = np.flatnonzero(inner)
    rest = z[of[k]]
    pairs = np.array([[np.exp(np.minimum(alpha[k - 1, a] + trans[a, b] + (score[k, b] + beta[k, b]) - rest, 0)).sum() for b in (0, 1)] for a in (0, 1)])
    return marginal[:, 1], pairs, float(log_z.sum())


class LineField:
    """weights of evidence for good, label-pair weights, and the logistic curve of the score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.trans, self.slope, self.offset = weights, trans, slope, offset

    def marginals(self, own: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Probability of good per line, from its bins."""
        return chain(line_evidence(self.weights, own, lines), lines, self.trans)[0]

    def means(self, own: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Probability of good of each text, the mean of its lines' by their bytes."""
        of = np.repeat(np.arange(len(lines)), lines)
        weight = np.maximum(size, 1)
        return np.bincount(of, self.marginals(own, lines) * weight, len(lines)) / np.bincount(of, weight, len(lines))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        figures, size, lines = line_figures(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.means(bins(figures), size, lines) + self.offset, -30, 30)))


def blocks(lines: np.ndarray, good: np.ndarray, most: int):
    """(first, last) of runs of documents of one kind that have about `most` lines together."""
    at = 0
    while at < len(lines):
        end, total = at, 0
        while end < len(lines) and good[end] == good[at] and (end == at or total + lines[end] <= most):
            total += lines[end]
            end += 1
        yield at, end
        at = end


def train(own: np.ndarray, size: np.ndarray, lines: np.ndarray, good: np.ndarray, steps: int = 120, ridge: float = 1e-3, rate: float = 0.15, block: int = BLOCK) -> LineField:
    """Adam on the conditional log-likelihood of line labels; either kind of document weighs the same.

    Takes bins (figure, line), bytes of each line, lines and label of each document. Documents of one
    kind and like length lie together, those of equal ones in the order given.
    """
    starts = np.cumsum(lines) - lines
    order = np.lexsort((-lines, good))
    at = np.concatenate([np.arange(starts[d], starts[d] + lines[d]) for d in order])
    own, size, lines, good = own[:, at], size[at], lines[order], good[order]
    starts = np.cumsum(lines) - lines
    del at
    parts = [(int(good[lo]), lines[lo:hi], slice(int(starts[lo]), int(starts[hi - 1] + lines[hi - 1]))) for lo, hi in blocks(lines, good, block)]
    share = [0.5 / max(1, lines[good == g].sum()) for g in (0, 1)]
    weights, trans = np.zeros(N_WEIGHTS), np.zeros((2, 2))
    m, v = np.zeros(N_WEIGHTS + 4), np.zeros(N_WEIGHTS + 4)
    for step in range(1, steps + 1):
        grad_w, grad_t = -ridge * weights, -ridge * trans
        for g, n, rows in parts:
            p, pairs, _ = chain(line_evidence(weights, own[:, rows], n), n, trans)
            grad_w = grad_w + gathered((g - p) * share[g], own[:, rows], n)
            seen = np.zeros((2, 2))
            seen[g, g] = (n - 1).sum()
            grad_t = grad_t + (seen - pairs) * share[g]
        grad = np.concatenate([grad_w, grad_t.ravel()])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, trans = weights + move[:N_WEIGHTS], trans + move[N_WEIGHTS:].reshape(2, 2)
        trans = np.clip(trans, -2, 2)
    field = LineField(weights, trans)
    means = np.concatenate([field.means(own[:, rows], size[rows], n) for _, n, rows in parts])
    field.slope, field.offset = _logistic(means, good.astype(np.float64))
    return field


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression, both kinds weighing the same."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2), a.T @ (w * (y - p)) - 1e-4 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def with_bins(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The columns in `carry`, and of each line of the text its bins (figure, line) as bytes and its bytes as 32-bit integers."""
    small_batches(docs.sparkSession)
    keep = list(carry)

    def apply(batches):
        for batch in batches:
            texts, own, size = [t.encode() for t in batch.column(len(keep)).to_pylist()], [], []
            for lo, hi in batches_by_bytes(texts):
                figures, n_bytes, lines = line_figures(texts[lo:hi])
                at, last = bins(figures), np.cumsum(lines)
                for a, b in zip(last - lines, last, strict=True):
                    own.append(at[:, a:b].tobytes())
                    size.append(n_bytes[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(own, pa.binary()), pa.array(size, pa.binary())], [*keep, "bins", "bytes"])

    return docs.select(*keep, "text").mapInArrow(lean(apply), docs.select(*keep).schema.add("bins", "binary").add("bytes", "binary"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_kind: int = PER_KIND) -> LineField | None:
    """A field from the `per_kind` labelled documents of smallest hash of either kind; at most twice as many rows, though ids may repeat."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    few = None
    for kind in (0, 1):
        part = marked.where((F.col("y") > 0) == F.lit(bool(kind))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_kind)
        few = part if few is None else few.unionByName(part)
    known = docs.join(F.broadcast(few.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id")).where("text is not null").select("text", (F.col("y") > 0).cast("int").alias("y"), "doc_id", F.sha2("text", 256).alias("digest"))
    rows = with_bins(known, ("y", "doc_id", "digest")).orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(2 * per_kind).collect()
    rows.sort(key=lambda r: (r.doc_id, r.digest))
    good = np.array([r.y for r in rows])
    if not 0 < good.sum() < len(good):
        return None
    own = np.concatenate([np.frombuffer(r.bins, np.uint8).reshape(FIGURES, -1) for r in rows], axis=1)
    size = np.concatenate([np.frombuffer(r.bytes, "<u4") for r in rows])
    lines = np.array([len(r.bytes) // 4 for r in rows])
    del rows
    return train(own, size, lines, good)


def score(docs: DataFrame, field: LineField | None, carry: tuple[str, ...] = ("doc_id",), score_column: str = "score") -> DataFrame:
    """The columns in `carry` and the quality of the whole text, 0 to 1."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    keep = list(carry)

    def apply(batches):
        model = shared.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(len(keep)).to_pylist()]
            out = np.ones(len(texts))
            if model is not None:
                for lo, hi in batches_by_bytes(texts):
                    out[lo:hi] = model.scores(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out)], [*keep, score_column])

    return docs.select(*keep, F.col("text").alias("_text of carry")).mapInArrow(lean(apply), docs.select(*keep).schema.add(score_column, "double"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    learn = ~held_out
    field = fit(docs.where(learn).select("doc_id", "text"), labels.where(learn))
    return score(docs.select("doc_id", "text"), field).withColumn("held_out", held_out).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
