"""Language identification by a byte convolutional network.

Texts are cut into windows of a fixed number of bytes (all of the text, the last window padded).
Filters of several widths slide over the bytes; each filter's largest response in a window, floored
at zero, feeds a softmax over the learned languages, and a document's logits are the mean of its
windows' logits weighted by their bytes. The network is trained in numpy on the driver from a
bounded, documented sample of labelled excerpts; in tasks a filter is a sum of table look-ups, as
the response to one-hot bytes is linear.

Results for odd input: null, empty and letterless texts give `und` with score 0; a null lang is
never learned from; repeated rows give one row each, doc_id may be null; without one labelled row
every text is `und`; other columns of `docs` are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, crc_mod, lean, small_batches, table

#: Bytes of a window; labelled excerpts learned from per language; bytes of an excerpt.
WINDOW, PER_LANG, EXCERPT = 256, 1500, 512
WIDTHS, FILTERS, CLASSES = (2, 3, 4), 16, 160
#: Languages up to which their counts are broadcast; with more, rows are shuffled to them.
BROADCAST_LANGS = 10_000

_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 padding, letters without case, digits, space, signs, and each byte above 127."""
    out = np.full(256, 4, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 32 + b - 128
        elif c.isalpha():
            out[b] = 5 + ord(c.lower()) - ord("a")
        elif c.isdigit():
            out[b] = 3
        elif c.isspace():
            out[b] = 2
    out[0] = 0
    return out


_CLASS = byte_classes()


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text)


def windows(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes (window, byte), and of each window the text's number and its bytes."""
    counts = np.array([max(1, -(-len(t) // length)) for t in texts], np.int64)
    flat = b"".join([t + b"\0" * (n * length - len(t)) for t, n in zip(texts, counts.tolist(), strict=True)])
    of = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    size = np.minimum(np.array([len(t) for t in texts])[of] - (np.arange(len(of)) - first[of]) * length, length)
    return _CLASS[np.frombuffer(flat, np.uint8)].reshape(-1, length), of, np.maximum(size, 0)


class ByteNet:
    """filters: per width an array (width, class, filter); out: (features, languages), bias: (languages)."""

    def __init__(self, langs: list[str], filters: list[np.ndarray], out: np.ndarray, bias: np.ndarray):
        self.langs, self.filters, self.out, self.bias = langs, filters, out, bias

    def features(self, x: np.ndarray) -> np.ndarray:
        """Largest responses (window, feature)."""
        got = []
        for lo in range(0, len(x), 64):
            part, row = x[lo : lo + 64], []
            for f in self.filters:
                w = len(f)
                n = part.shape[1] - w + 1
                total = np.take(f[0], part[:, :n], axis=0)
                for j in range(1, w):
                    total += np.take(f[j], part[:, j : j + n], axis=0)
                row.append(np.maximum(total.max(axis=1), 0))
            got.append(np.concatenate(row, axis=1))
        return np.concatenate(got) if got else np.zeros((0, self.out.shape[0]), np.float32)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(text, language)."""
        x, of, size = windows(texts)
        logits = self.features(x) @ self.out + self.bias
        weight = size / np.maximum(np.bincount(of, size, len(texts)), 1)[of]
        mean = np.zeros((len(texts), len(self.langs)))
        np.add.at(mean, of, logits * weight[:, None])
        mean -= mean.max(axis=1, keepdims=True)
        p = np.exp(mean)
        return p / p.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, seed: int = 0, rate: float = 0.01, least_steps: int = 700) -> ByteNet:
    """Adam on cross-entropy with dropout; the gradient of a largest response goes to the bytes where it was."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    x, of, size = windows(texts)
    keep = size >= 16
    x, y = x[keep], np.array([langs.index(v) for v in labels])[of][keep]
    # Half of the windows are cut short, as short texts are padded too.
    cut = rng.integers(16, WINDOW, len(x))
    x = np.where((rng.random(len(x)) < 0.4)[:, None] & (np.arange(WINDOW) >= cut[:, None]), 0, x).astype(np.uint8)
    filters = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = 0
    net = ByteNet(langs, filters, rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*net.filters, net.out, net.bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(epochs, -(-least_steps * 128 // max(1, len(x))))
    for done in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            pick = order[lo : lo + 128]
            part, n = x[pick], len(pick)
            feats, where = [], []
            for f in net.filters:
                w = len(f)
                k = WINDOW - w + 1
                total = sum(np.take(f[j], part[:, j : j + k], axis=0) for j in range(w))
                at = total.argmax(axis=1)
                where.append(at)
                feats.append(np.take_along_axis(total, at[:, None], axis=1)[:, 0])
            raw = np.concatenate(feats, axis=1)
            drop = (rng.random(raw.shape) < 0.7) / np.float32(0.7)
            h = np.maximum(raw, 0) * drop
            logits = h @ net.out + net.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[pick]] -= 1
            p /= n
            back = (p @ net.out.T) * (raw > 0) * drop
            grads = []
            for k, f in enumerate(net.filters):
                g, at, b = np.zeros_like(f), where[k], back[:, k * FILTERS : (k + 1) * FILTERS]
                cols = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(len(f)):
                    np.add.at(g[j], (np.take_along_axis(part, at + j, axis=1), cols), b)
                g[:, 0] = 0
                grads.append(g)
            grads += [h.T @ p + 1e-4 * net.out, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= (rate / (1 + 6 * done / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(labelled: DataFrame, per_lang: int = PER_LANG, excerpt: int = EXCERPT) -> ByteNet | None:
    """A network from rows (doc_id, text, lang): per language the `per_lang` rows of smallest hash, an excerpt of each.

    Languages are counted first; of each about twice the rows wanted pass by their hash, so only those
    are shuffled and ranked, however many rows one language has.
    """
    own = labelled.where("text is not null and lang is not null")
    # Texts aren't looked at for the counts; a language with many null texts gives fewer rows.
    counts = checkpoint(labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("rows")).select(F.col("lang").alias("c_lang"), "rows"))
    if counts.count() <= BROADCAST_LANGS:
        counts = F.broadcast(counts)
    start = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - excerpt, F.lit(1))).cast("int") + 1
    # The text goes into the hash, so rows without a doc_id, or with one and the same, differ.
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    near = own.join(counts, F.col("lang") == F.col("c_lang")).where(h <= 2.0 * per_lang / F.col("rows") * (1 << 30))
    cut = near.select("lang", F.substring("text", start, F.lit(excerpt)).alias("cut"), h.alias("h"))
    top = cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "cut"))).where(F.col("k") <= per_lang)
    rows = [(r.cut, r.lang) for r in top.orderBy("lang", "k").collect() if has_letter(r.cut)]
    return train([t.encode() for t, _ in rows], [lang for _, lang in rows]) if rows else None


def predict(docs: DataFrame, net: ByteNet | None, carry: tuple[str, ...] = ("doc_id",), lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """The columns in `carry`, the likeliest language of the whole text and its probability."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    keep = list(carry)
    schema = docs.select(*keep).schema.add(lang_column, "string").add(score_column, "double")

    def apply(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
            at = 0
            while at < len(known):  # some MB of text at a time
                end, size = at, 0
                while end < len(known) and (size := size + len(texts[known[end]])) < 1 << 20 or end == at:
                    end += 1
                for i, p in zip(known[at:end], model.probabilities([texts[i].encode() for i in known[at:end]]), strict=True):
                    best = int(p.argmax())
                    langs[i], scores[i] = model.langs[best], float(p[best])
                at = end
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, lang_column, score_column])

    return docs.select(*keep, F.col("text").alias("_text of carry")).mapInArrow(lean(apply), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    net = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), net).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
