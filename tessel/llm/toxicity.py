"""Toxicity by a support vector machine over a gapped subsequence kernel.

Units of text (words, runs of single letters, windows of long words) are compared by the string
subsequence kernel: all subsequences of `ORDER` characters, gaps allowed, each occurrence weighted
by DECAY to the power of its span. Inserted characters lengthen spans but keep subsequences, so
gapped insults stay close to plain ones. Nystroem landmarks (units drawn from the labelled
sentences) give every unit an explicit feature vector; a linear SVM with squared hinge loss is
trained on it, with multiple-instance rounds: of each toxic sentence the unit of highest margin is
the witness, all units of other sentences are negative. Units that are far commoner in toxic
documents stay positive throughout; positives are also shown with a letter inserted, doubled or left
out.

The trained function is a sum over landmarks of coefficient x kernel value. As the kernel is an
inner product over subsequences, that sum folds into one coefficient per subsequence, so scoring a
unit needs its own subsequences alone; each process remembers the margins of units it has seen. A
sentence's margin is its largest unit's, a document's its largest sentence's; a logistic curve
fitted on the labelled sample turns it into a score.

Results for odd input: null and empty texts have no unit and get the score of a text without any
toxic unit; without labels of both kinds all scores are 0; repeated rows give one row each; doc_id
may be null; labels repeated or contradictory for one doc_id count as toxic if any row says so.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import crc_mod, small_batches, table

#: Length of subsequences, decay per spanned character, characters of a window and its step.
ORDER, DECAY, SPAN, STEP = 4, 0.7, 14, 7
#: Characters fall into this many classes.
ALPHABET = 32
#: Labelled documents learned from: of each kind at most so many, those of smallest hash.
PER_KIND = 1500
LANDMARKS, ROUNDS, KEEP = 320, 5, 1 << 19
#: Documents that a unit must be in, and times its odds must be those in other documents, to count as toxic by itself.
SURE = 12
#: Least odds of a witness and least evidence (toxic documents times log-odds) that it isn't there by chance.
LEAST_ODDS, LEAST_EVIDENCE = 4, 6

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def char_class(c: str) -> int:
    """1-26 letters without case, 27-31 other letters, 0 anything else (left out)."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 5 if c.isalpha() else 0


def units(text: str) -> list[str]:
    """Lower-case words, and joined runs of words of at most two characters (spelled-out words)."""
    words = text.lower().split()
    out, run = words[:], []
    if " " in text:
        for w in words:
            if len(w) <= 2:
                run.append(w)
            else:
                if len(run) >= 4:
                    out += _runs(run)
                run = []
        if len(run) >= 4:
            out += _runs(run)
    return out


def _runs(run: list[str]) -> list[str]:
    return ["".join(run[i : i + SPAN]) for i in range(0, max(1, len(run) - STEP), STEP)]


def encode(unit: str) -> list[tuple[int, ...]]:
    """Class codes of a unit without its signs and digits, cut into windows of SPAN where it is longer."""
    codes = [k for c in unit if (k := char_class(c))]
    if len(codes) <= SPAN:
        return [tuple(codes)]
    return [tuple(codes[i : i + SPAN]) for i in range(0, len(codes) - SPAN + STEP, STEP)]


@lru_cache(maxsize=64)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of a word of `length` (place, order) and their weights."""
    from itertools import combinations

    at = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32) if len(at) else np.zeros(0, np.float32)


_RADIX = ALPHABET ** np.arange(ORDER - 1, -1, -1, dtype=np.int64)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (word, subsequence) of words of one length, and the weights, not yet joined by feature."""
    at, weight = _places(codes.shape[1])
    return codes.astype(np.int64)[:, at] @ _RADIX, weight


def norms(codes: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel with itself, by the kernel's recursion."""
    b, n = codes.shape
    same = codes[:, :, None] == codes[:, None, :]
    inner = np.ones((b, n + 1, n + 1), np.float32)
    for _ in range(ORDER - 1):
        nxt = np.zeros_like(inner)
        for i in range(1, n + 1):
            row = np.zeros(b, np.float32)
            for j in range(1, n + 1):
                row = DECAY * row + np.where(same[:, i - 1, j - 1], DECAY * DECAY * inner[:, i - 1, j - 1], 0)
                nxt[:, i, j] = DECAY * nxt[:, i - 1, j] + row
        inner = nxt
    return np.sqrt((same * inner[:, :n, :n]).sum(axis=(1, 2)) * DECAY * DECAY)


def by_length(unit_list: list[str]):
    """(numbers of units, codes) of all windows, by length; windows too short for a subsequence are left out."""
    groups: dict[int, tuple[list[int], list[tuple[int, ...]]]] = {}
    for k, u in enumerate(unit_list):
        for codes in encode(u):
            if len(codes) >= ORDER:
                at = groups.setdefault(len(codes), ([], []))
                at[0].append(k)
                at[1].append(codes)
    for length in sorted(groups):
        of, codes = groups[length]
        for lo in range(0, len(of), 2048):
            yield np.array(of[lo : lo + 2048]), np.array(codes[lo : lo + 2048], np.int16)


class Machine:
    """weights: one coefficient per subsequence; bias; slope and offset of the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def margins(self, unit_list: list[str]) -> np.ndarray:
        out = np.full(len(unit_list), self.bias)
        for of, codes in by_length(unit_list):
            feature, weight = subsequences(codes)
            value = self.weights[feature] @ weight / np.maximum(norms(codes), 1e-9) + self.bias
            np.maximum.at(out, of, value)
        return out

    def remember(self, unit_set: set[str]) -> None:
        if len(self.known) > KEEP:
            self.known.clear()
        fresh = [u for u in unit_set - self.known.keys() if len(u) <= 64]
        self.known.update(zip(fresh, self.margins(fresh).tolist(), strict=True))

    def document(self, unit_set: set[str]) -> float:
        """The largest margin of a text's units (its sentences' largest)."""
        known, best, long = self.known, self.bias, []
        for u in unit_set:
            m = known.get(u)
            if m is None:
                long.append(u)
            elif m > best:
                best = m
        return max(best, float(self.margins(long).max())) if long else best

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def kernel_features(unit_list: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, feature, value) of normalised feature vectors; of a long unit its first window."""
    rows, cols, vals = [], [], []
    for of, codes in by_length([u[:SPAN] for u in unit_list]):
        feature, weight = subsequences(codes)
        norm = np.maximum(norms(codes), 1e-9)
        rows.append(np.repeat(of, feature.shape[1]))
        cols.append(feature.ravel())
        vals.append((weight[None] / norm[:, None]).ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def with_landmarks(unit_list: list[str], table_: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Kernel values (unit, landmark); table_ has a row per subsequence that some landmark has, slot its number or 0."""
    out = np.zeros((len(unit_list), table_.shape[1]), np.float32)
    for of, codes in by_length([u[:SPAN] for u in unit_list]):
        feature, weight = subsequences(codes)
        norm = np.maximum(norms(codes), 1e-9)
        for lo in range(0, len(of), 64):
            rows = table_[slot[feature[lo : lo + 64]]]
            out[of[lo : lo + 64]] = np.einsum("bsl,s->bl", rows, weight) / norm[lo : lo + 64, None]
    return out


def garbled(unit: str, rng: np.random.Generator) -> list[str]:
    """A unit with a letter inserted, doubled and, where enough are left, left out."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    a, b, c = rng.integers(1, len(unit), 3)
    out = [unit[:a] + letters[rng.integers(26)] + unit[a:], unit[:b] + unit[b - 1] + unit[b:]]
    return out + ([unit[:c] + unit[c + 1 :]] if len(unit) > ORDER + 1 else [])


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear SVM by Newton steps on the rows inside the margin."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    w = np.zeros(x1.shape[1])
    reg = np.full(x1.shape[1], ridge * weight.sum())
    reg[-1] = 1e-6
    for _ in range(steps):
        act = y * (x1 @ w) < 1
        a, s = x1[act], weight[act]
        new = np.linalg.solve((a * s[:, None]).T @ a + np.diag(reg), (a * (s * y[act])[:, None]).sum(axis=0))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def train(sentences: list[tuple[int, str]], toxic: dict[int, int], landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 0) -> Machine:
    """sentences: (document, sentence); toxic: label of each document, which its sentences share."""
    rng = np.random.default_rng(seed)
    bags: dict[int, set[str]] = {}
    for d, s in sentences:
        bags.setdefault(d, set()).update(u for u in units(s) if ORDER <= len(u) <= 64)
    n1 = max(1, sum(toxic[d] for d in bags))
    n0 = max(1, len(bags) - n1)
    df: dict[str, list[int]] = {}
    for d, bag in bags.items():
        for u in bag:
            df.setdefault(u, [0, 0])[toxic[d]] += 1
    names = sorted(df)
    number = {u: i for i, u in enumerate(names)}
    count = np.array([df[u] for u in names], np.float64)
    lift = np.log((count[:, 1] + 0.5) / (n1 + 1)) - np.log((count[:, 0] + 0.5) / (n0 + 1))
    told = count[:, 1] * np.maximum(lift, 0)
    half = landmarks // 2
    chosen = np.argsort(-told, kind="stable")[:half]
    common = np.argsort(-count[:, 0], kind="stable")[: 20 * half]
    rest = rng.permutation(np.setdiff1d(common, chosen))[: landmarks - len(chosen)]
    marks = [names[i] for i in np.concatenate([chosen, rest])]
    rows, cols, vals = kernel_features(marks)
    used, place = np.unique(cols, return_inverse=True)
    table_ = np.zeros((len(used) + 1, len(marks)), np.float32)
    np.add.at(table_, (place + 1, rows), vals)
    slot = np.zeros(ALPHABET**ORDER, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    between = with_landmarks(marks, table_, slot).astype(np.float64)
    value, vector = np.linalg.eigh((between + between.T) / 2)
    good = value > 1e-4
    root = vector[:, good] / np.sqrt(value[good])

    toxic_bags = [np.array([number[u] for u in bag]) for d, bag in bags.items() if toxic[d] and bag]
    negative = np.flatnonzero(count[:, 0] > 0)
    order = np.lexsort((negative, -count[negative, 0]))
    pool = negative[order][:6000]
    witness = {int(b[np.argmax(told[b])]) for b in toxic_bags}
    # Units so common in toxic documents alone that chance is ruled out are positive throughout.
    sure = set(np.flatnonzero((count[:, 1] >= SURE) & (lift >= np.log(SURE))).tolist())
    # A word of the language is commoner in toxic documents by chance alone; it is no witness while others are.
    telling = (lift >= np.log(LEAST_ODDS)) & (told >= LEAST_EVIDENCE)
    if not telling.any():
        telling = lift > 0
    machine = Machine(np.zeros(ALPHABET**ORDER, np.float32), -1.0)
    for _ in range(rounds):
        pos = np.array(sorted(sure | {w for w in witness if telling[w]}), np.int64)
        neg = np.setdiff1d(pool, pos)
        shown = [names[i] for i in pos] + [v for i in pos for v in garbled(names[i], rng)]
        x = with_landmarks(shown + [names[i] for i in neg], table_, slot) @ root
        y = np.concatenate([np.ones(len(shown)), -np.ones(len(neg))])
        mass = np.sqrt(count[pos, 1])
        mass = np.concatenate([mass, 0.3 * np.repeat(mass, [len(garbled(names[i], rng)) for i in pos])])
        s = np.concatenate([0.5 * mass / max(1.0, mass.sum()), np.full(len(neg), 0.5 / max(1, len(neg)))])
        w, bias = squared_hinge(x, y, s)
        beta = root @ w
        weights = np.zeros(ALPHABET**ORDER, np.float32)
        weights[used] = table_[1:] @ beta
        machine = Machine(weights, bias)
        margin = machine.margins(names)
        witness = {int(b[np.argmax(margin[b])]) for b in toxic_bags}
        hard = negative[np.argsort(-margin[negative], kind="stable")[:1500]]
        pool = np.union1d(pool, hard)
    top = np.array([max((margin[number[u]] for u in bag), default=machine.bias) for bag in bags.values()])
    label = np.array([toxic[d] for d in bags], np.float64)
    machine.slope, machine.offset = logistic(top, label)
    return machine


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression on one variable, both labels weighing the same."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2), a.T @ (w * (y - p)) - 1e-4 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def labelled_sentences(docs: DataFrame, labels: DataFrame, label: str, per_kind: int = PER_KIND) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """Sentences of the `per_kind` documents of smallest hash of either label, at most twice as many rows; their labels."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    few = None
    for kind in (0, 1):
        part = marked.where((F.col("y") > 0) == F.lit(bool(kind))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_kind)
        few = part if few is None else few.unionByName(part)
    rows = docs.join(F.broadcast(few.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id")).where("text is not null").select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_kind).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [(r.doc_id, s) for r in rows for s in _SENTENCE.split(r.text) if s], {r.doc_id: r.y for r in rows}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_kind: int = PER_KIND) -> Machine | None:
    sentences, kinds = labelled_sentences(docs, labels, label, per_kind)
    return train(sentences, kinds) if len(set(kinds.values())) == 2 else None


def score(docs: DataFrame, machine: Machine | None, carry: tuple[str, ...] = ("doc_id",), score_column: str = "score") -> DataFrame:
    """The columns in `carry` and the score of the whole text, 0 to 1."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    keep = list(carry)

    def apply(batches):
        model = shared.value
        for batch in batches:
            texts, out = batch.column(len(keep)).to_pylist(), []
            for lo in range(0, len(texts), 64):
                sets = [set(units(t or "")) for t in texts[lo : lo + 64]]
                if model is None:
                    out += [0.0] * len(sets)
                    continue
                model.remember(set().union(*sets))
                out += [float(model.score(model.document(s))) for s in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.float64())], [*keep, score_column])

    return docs.select(*keep, F.col("text").alias("_text of carry")).mapInArrow(apply, docs.select(*keep).schema.add(score_column, "double"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    learn = ~held_out
    machine = fit(docs.where(learn).select("doc_id", "text"), labels.where(learn))
    return score(docs.select("doc_id", "text"), machine).withColumn("held_out", held_out).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
