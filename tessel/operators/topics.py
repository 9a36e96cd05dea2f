"""Topic models of bags of words: latent Dirichlet allocation, its labelled form, and probabilistic latent semantic indexing.

Bags are rows (doc, word, n), or texts' words. Each document's words are gathered into one row, written once
in buckets by document, so that what a step finds for documents reaches them where they lie;
every EM step of LDA runs the variational fixed point of whole documents inside Arrow batches and sums
expected counts by word in Spark. Within a batch documents of about one size go through their rounds
together, as many as fit into a processor's cache. The `SENT_WORDS` likeliest words of the table of
topics are sent to the tasks; a larger table's other words are joined by word, and the documents take
in what was found for theirs. For PLSI words reach the documents in the same way, whose
own factor is joined to them; a step moves sums by word and documents, not counts. Words, documents and counts are never capped. Rows with a
null doc, word or count, and counts of zero and less, say nothing and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.shared import discard, written, written_by

#: Words of a table of topics up to which it is sent to every task.
SENT_WORDS = 200_000
#: Relative change of a document's parameters that ends its fixed point, and the most rounds of it.
CLOSE, ROUNDS = 1e-8, 500
#: Arguments of the series for ln gamma and its derivatives are at least this.
LIFT = 13
#: Words of documents that go through their rounds together, and that have responsibilities at once; a larger document goes alone.
TOGETHER, AT_ONCE = 65_536, 262_144


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of ln gamma, for positive x: moved up by its recurrence, then by its asymptotic series."""
    x = np.asarray(x, float)
    low = 1 / x
    for i in range(1, 8):
        low += 1 / (x + i)
    x = x + 8
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760))))) - low


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(LIFT):
        low = x < LIFT
        out += np.where(low, 1 / (x * x), 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def lgamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(LIFT):
        low = x < LIFT
        out -= np.where(low, np.log(x), 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


@dataclass
class Topics:
    """Dirichlet weights of the topics and the table (word, p: array of the topics' probabilities)."""

    alpha: np.ndarray
    table: DataFrame


def bags(counts: DataFrame, doc: str, word: str, n: str, prior: str | None = None) -> DataFrame:
    """(doc, words, n, prior) of each document, written: its words, their counts, and its own Dirichlet weights if there are any."""
    rows = counts.select(F.col(doc).alias("doc"), F.col(word).alias("word"), F.col(n).cast("double").alias("n"), (F.col(prior) if prior else F.lit(None)).cast("array<double>").alias("prior"))
    rows = rows.where("doc IS NOT NULL AND word IS NOT NULL AND n > 0").groupBy("doc", "word").agg(F.sum("n").alias("n"), F.first("prior").alias("prior"))
    per = rows.groupBy("doc").agg(F.collect_list(F.struct("word", "n")).alias("b"), F.first("prior").alias("prior"))
    return written_by(per.select("doc", "b.word", "b.n", "prior").withColumnRenamed("word", "words"), "doc")


def _counted(batches):
    """(doc, words, n) of Arrow batches (doc, words) or (doc, words, n): each row's different words and their counts; rows without any are left out."""
    for batch in batches:
        words, kind = batch.column("words"), batch.schema.field("words").type.value_type
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        flat = words.flatten()
        of, real = np.repeat(np.arange(batch.num_rows), sizes), pc.is_valid(flat).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        width = max(1, len(coded.dictionary))
        pairs, at = of[real] * width + coded.indices.drop_null().to_numpy(), None
        if "n" in batch.schema.names:
            pairs, at = np.unique(pairs, return_inverse=True)
            n = np.bincount(at, batch.column("n").flatten().to_numpy()[real], len(pairs))
        else:
            pairs, n = np.unique(pairs, return_counts=True)
        of = pairs // width
        some, first = np.unique(of, return_index=True)
        ends = pa.array(np.append(first, len(pairs)).astype(np.int32))
        found = coded.dictionary.take(pa.array(pairs % width)).cast(kind)
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(some)), pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(n.astype(float)))], ["doc", "words", "n"])


def bags_of_words(rows: DataFrame, doc: str, words: Column | str, priors: DataFrame | None = None) -> DataFrame:
    """What `bags` gives, from rows with an array of words: rows move once, as they are, and words are counted where they arrive.

    `words` may be worked out of a text; `rows` should hold little else. `priors`: (doc, prior) of the
    documents to keep, one row each. Null documents and words are left out; the rows of a document that
    has several are put together.
    """
    words = F.col(words) if isinstance(words, str) else words
    rows = rows.where(F.col(doc).isNotNull())
    near = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc).select(F.col(doc).alias("doc"), words.alias("words"))
    kind = ", ".join(f"{c} {t}" for c, t in near.dtypes) + ", n array<double>"
    counted, dealt = near.mapInArrow(_counted, kind), True
    several = rows.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("c")).where("c > 1").select("doc")
    if several.head():
        met = counted.join(several, "doc", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("words", "n")).alias("b"))
        merged = met.select("doc", F.flatten("b.words").alias("words"), F.flatten("b.n").alias("n")).mapInArrow(_counted, kind)
        counted, dealt = counted.join(several, "doc", "left_anti").unionByName(merged), False
    if priors is not None:
        counted, dealt = counted.join(priors.select("doc", "prior"), "doc"), False
    else:
        counted = counted.withColumn("prior", F.lit(None).cast("array<double>"))
    return written_by(counted.select("doc", "words", "n", "prior"), "doc", dealt)


def _rounds(at: np.ndarray, alpha, allowed, beta, n, start, sizes, gamma, close: float, rounds: int) -> None:
    """Puts into `gamma` the fixed points of the documents `at`, which are about equally long; shorter ones are filled up with words of no count."""
    # Each document's own topics come first, so those that none may have cost nothing.
    own = np.argsort(~allowed[at], axis=1, kind="stable")[:, : max(1, allowed[at].sum(axis=1).max())]
    place = np.arange(sizes[at].max())
    real = place < sizes[at][:, None]
    spot = np.where(real, start[at][:, None] + place, 0)
    b = np.where(real[:, None, :], beta[spot[:, None, :], own[:, :, None]], 0.0)
    m = np.where(real, n[spot], 0.0)[:, None, :]
    rows = at[:, None]
    a, g, ok = alpha[rows, own], gamma[rows, own], allowed[rows, own]
    live, began, before, safe, least = np.ones(len(at), bool), g, g, g, np.full(len(at), np.inf)
    for i in range(rounds):
        e = np.exp(digamma(g)) * ok
        share = np.matmul(e[:, None, :], b)
        share[share == 0] = np.inf
        np.divide(m, share, out=share)
        new = np.where(ok, a + e * np.matmul(share, b.transpose(0, 2, 1))[:, 0], 1.0)
        gap = np.abs(new - g).sum(axis=1)
        moved = gap > close * np.abs(new).sum(axis=1)
        if i % 2:
            # Two rounds tell where the next ones would lead (squared extrapolation).
            r, v = g - began, new - 2 * g + began
            far = np.sqrt((r * r).sum(axis=1) / np.maximum((v * v).sum(axis=1), 1e-300)).clip(1, 1e6)[:, None]
            before, safe, least = g, new, gap
            then = np.maximum(began + far * (2 * r + far * v), a)
        else:
            # Where that moves a document more than the rounds before did, they go on from where they were.
            back = (moved & (gap > least))[:, None]
            began, then = np.where(back, before, g), np.where(back, safe, new)
        g = np.where(live[:, None], np.where(moved[:, None], then, new), g)
        live &= moved
        left = live.sum()
        if 2 * left <= len(live):
            gamma[at[:, None], own] = g
            if not left:
                return
            at, own, a, g, ok, b, m, began, before, safe, least = (x[live] for x in (at, own, a, g, ok, b, m, began, before, safe, least))
            live = np.ones(len(at), bool)
    # A document that the rounds end in an extrapolation keeps the last round's outcome.
    gamma[at[:, None], own] = np.where(live[:, None], safe if rounds and not rounds % 2 else g, g)


def fixed_point(alpha: np.ndarray, logp: np.ndarray, n: np.ndarray, start: np.ndarray, close: float = CLOSE, rounds: int = ROUNDS):
    """(gamma, responsibilities, bound) of documents laid end to end.

    alpha: weights of each document's topics (docs, K; 0: a topic it can't have); logp: (words, K);
    `start`: where each document's words begin. A word that no allowed topic has makes the bound -infinity
    and gives no responsibilities.
    """
    docs, k = alpha.shape
    of = np.repeat(np.arange(docs), np.diff(np.append(start, len(n))))
    allowed = alpha > 0
    logp = np.where(allowed[of], logp, -np.inf)
    top = logp.max(axis=1, keepdims=True)
    lost = ~np.isfinite(top[:, 0])
    beta = np.where(lost[:, None], 0.0, np.exp(np.where(lost[:, None], 0.0, logp - np.where(lost[:, None], 0.0, top))))
    safe = np.where(allowed, alpha, 1.0)
    gamma = np.where(allowed, alpha + np.add.reduceat(n, start)[:, None] / np.maximum(1, allowed.sum(axis=1, keepdims=True)), 1.0)
    sizes = np.diff(np.append(start, len(n)))
    by_size, first = np.argsort(sizes, kind="stable"), 0
    while first < docs:
        last = first + 1
        while last < docs and (last + 1 - first) * sizes[by_size[last]] <= TOGETHER:
            last += 1
        _rounds(by_size[first:last], alpha, allowed, beta, n, start, sizes, gamma, close, rounds)
        first = last
    mean_log = np.where(allowed, digamma(gamma) - digamma(np.where(allowed, gamma, 0.0).sum(axis=1, keepdims=True)), 0.0)
    phi = beta * np.exp(mean_log)[of] * allowed[of]
    total = phi.sum(axis=1, keepdims=True)
    phi = np.divide(phi, total, out=np.zeros_like(phi), where=total > 0)
    # With the responsibilities at their best, a word's share is the logarithm of its normaliser.
    with np.errstate(divide="ignore"):
        words = n * np.where(lost, -np.inf, np.log(total[:, 0]) + np.where(lost, 0.0, top[:, 0]))
    each = lambda a: np.where(allowed, lgamma(np.where(allowed, a, 1.0)), 0.0).sum(axis=1)
    whole = lambda a: lgamma(np.where(allowed, a, 0.0).sum(axis=1))
    bound = np.add.reduceat(words, start) + whole(safe) - each(safe) - whole(gamma) + each(gamma) + (np.where(allowed, alpha - gamma, 0.0) * mean_log).sum(axis=1)
    return np.where(allowed, gamma, 0.0), phi, bound, mean_log


def _logs(p: Column) -> Column:
    return F.transform(p, lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(float("-inf"))))


def _documents(docs: DataFrame, words: DataFrame, k: int, value=_logs, none: float = -np.inf):
    """The documents, and a function that looks up their words' log-probabilities (or another `value` of p; `none`: of a word not in the table) in a task.

    Of a table with more than `SENT_WORDS` words the likeliest are sent; the documents then have `rest`,
    the places of other words and their log-probabilities.
    """
    size, few, logp = words.count(), None, value(F.col("p")).alias("logp")
    if size > SENT_WORDS:
        likely = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
        least = words.agg(F.percentile_approx(likely, 1 - SENT_WORDS / size, 10_000)).head()[0]
        few = likely > least
    sent = (words if few is None else words.where(few)).select("word", logp).toArrow()
    rows = sent["logp"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    shared = docs.sparkSession.sparkContext.broadcast((sent["word"].combine_chunks(), np.vstack([rows, np.full((1, k), none)])))

    def places(met):
        known, values = shared.value
        at = pc.index_in(met, value_set=known.cast(met.type))
        return at.fill_null(len(known)).to_numpy(), values

    def look(batch):
        at, values = places(batch.column("words").flatten())
        out = values[at]
        if "rest" in batch.schema.names:
            rest = batch.column("rest")
            sizes = pc.list_value_length(batch.column("words")).to_numpy()
            begin = np.repeat(np.cumsum(sizes) - sizes, pc.fill_null(pc.list_value_length(rest), 0).to_numpy())
            flat = rest.flatten()
            out[begin + flat.field("at").to_numpy()] = flat.field("logp").flatten().to_numpy().reshape(-1, k)
        return out

    if few is None:
        return docs, look
    kinds = dict(docs.dtypes)

    def others(batches):
        for batch in batches:
            at, values = places(batch.column("words").flatten())
            sizes = pc.list_value_length(batch.column("words")).to_numpy()
            rest = np.flatnonzero(at == len(values) - 1)
            of = np.repeat(np.arange(batch.num_rows), sizes)[rest]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(of)), pa.array((rest - (np.cumsum(sizes) - sizes)[of]).astype(np.int32)), batch.column("words").flatten().take(pa.array(rest))], ["doc", "at", "word"])

    pairs = docs.select("doc", "words").mapInArrow(others, f"doc {kinds['doc']}, at int, word {kinds['words'][6:-1]}")
    met = pairs.join(words.where(~few).select("word", logp), "word")
    rest = met.groupBy("doc").agg(F.collect_list(F.struct("at", "logp")).alias("rest"))
    return docs.join(rest, "doc", "left"), look


def _batches(batch, look, alpha: np.ndarray, close: float, rounds: int):
    """Of each part of a batch, whole documents of about `AT_ONCE` words: its rows, what `fixed_point` gives, counts and sizes."""
    ends = np.cumsum(pc.list_value_length(batch.column("n")).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        part = batch.slice(first, last - first)
        n = part.column("n").flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(ends[first:last], prepend=before)
        weights = np.array([alpha if p is None else p for p in part.column("prior").to_pylist()], float).reshape(-1, len(alpha))
        yield part, fixed_point(weights, look(part), n, np.cumsum(sizes) - sizes, close, rounds), n, sizes
        first = last


def score(docs: DataFrame, model: Topics, close: float = CLOSE, rounds: int = ROUNDS) -> DataFrame:
    """(doc, n, bound, gamma): words, the variational bound of the log-likelihood, and the posterior weights of each document of `bags`."""
    rows, look = _documents(docs, model.table, len(model.alpha))
    alpha = model.alpha

    def run(batches):
        for batch in batches:
            for part, (gamma, _, bound, _), n, sizes in _batches(batch, look, alpha, close, rounds):
                total = np.add.reduceat(n, np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(total), pa.array(bound), pa.array(gamma.tolist(), pa.list_(pa.float64()))], ["doc", "n", "bound", "gamma"])

    return rows.mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, n double, bound double, gamma array<double>")


def _rows_of(words: pa.Array, sums: np.ndarray, figures: np.ndarray) -> pa.RecordBatch:
    """(word, -, its sums) of each word and (-, part, figures) of each row of `figures`."""
    values = np.concatenate([sums, figures])
    ends = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
    parts = pa.concat_arrays([pa.nulls(len(words), pa.int32()), pa.array(np.arange(len(figures), dtype=np.int32))])
    return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(len(figures), words.type)]), parts, pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], ["word", "part", "v"])


def em_step(docs: DataFrame, model: Topics, fit_alpha: bool = True, close: float = CLOSE, rounds: int = ROUNDS) -> tuple[Topics, float]:
    """One step, and the bound that the model before it had. Documents with weights of their own leave alpha as it is."""
    rows, look = _documents(docs, model.table, len(model.alpha))
    alpha, k = model.alpha, len(model.alpha)
    size = 2 * k + 2
    kind = docs.schema["words"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("words").flatten().dictionary_encode()
            codes, sums, figures, done = coded.indices.to_numpy(), np.zeros((len(coded.dictionary), k)), np.zeros(-(-size // k) * k), 0
            for part, (_, phi, bound, mean_log), n, _ in _batches(batch, look, alpha, close, rounds):
                mine = codes[done : done + len(n)]
                done += len(n)
                seen, at = np.unique(mine, return_inverse=True)
                for i in range(k):
                    sums[seen, i] += np.bincount(at, phi[:, i] * n)
                ok = np.isfinite(bound)
                plain = np.array([p is None for p in part.column("prior").to_pylist()]) & ok
                figures[: k + 2] += np.concatenate([[bound[ok].sum(), plain.sum()], mean_log[plain].sum(axis=0)])
            figures[k + 2 : size] = sums.sum(axis=0)
            yield _rows_of(coded.dictionary, sums, figures.reshape(-1, k))

    met = rows.mapInArrow(run, f"word {kind}, part int, v array<double>").groupBy("word", "part")
    sums = written(met.agg(*[F.sum(F.get("v", i)).alias(f"v{i}") for i in range(k)]))
    seen = np.array([list(r)[2:] for r in sorted(sums.where("word IS NULL").collect(), key=lambda r: r.part)], float).ravel()
    if not len(seen):
        discard(sums)
        return model, 0.0
    totals = seen[k + 2 : size]
    table = sums.where("word IS NOT NULL").select("word", F.array(*[F.col(f"v{i}") / float(t) if t > 0 else F.lit(0.0) for i, t in enumerate(totals)]).alias("p"))
    table._written_to = sums._written_to
    if fit_alpha and seen[1] > 0:
        alpha = fit_dirichlet(seen[2 : k + 2] / seen[1], alpha)
    return Topics(alpha, table), float(seen[0])


def fit_dirichlet(mean_log: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The Dirichlet weights that make the given mean logarithms likeliest, by Newton's method with halved steps."""
    value = lambda a: lgamma(a.sum()) - lgamma(a).sum() + ((a - 1) * mean_log).sum()
    for _ in range(200):
        g = digamma(alpha.sum()) - digamma(alpha) + mean_log
        q, z = -trigamma(alpha), trigamma(alpha.sum())
        step = (g - (g / q).sum() / (1 / z + (1 / q).sum())) / q
        size = 1.0
        while size > 1e-12 and ((alpha - size * step <= 0).any() or value(alpha - size * step) < value(alpha)):
            size /= 2
        if size <= 1e-12:
            break
        alpha = alpha - size * step
        if np.abs(size * step).max() < 1e-12 * alpha.max():
            break
    return alpha


def start_topics(docs: DataFrame, k: int, seed: int = 0, alpha: float = 1.0) -> Topics:
    """Topics near the words' overall frequencies, each word leaning to some by a hash of the word."""
    words = docs.select(F.explode(F.arrays_zip("words", "n")).alias("b")).groupBy(F.col("b.words").alias("word")).agg(F.sum("b.n").alias("n"))
    lean = [F.col("n") * (0.5 + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("word")), F.lit(1000)) / 1000.0) for i in range(k)]
    words = written(words.select("word", *[c.alias(f"l{i}") for i, c in enumerate(lean)]))
    totals = words.agg(*[F.sum(f"l{i}") for i in range(k)]).head()
    return Topics(np.full(k, alpha), words.select("word", F.array(*[F.col(f"l{i}") / float(t or 1) for i, t in enumerate(totals)]).alias("p")))


def fit(docs: DataFrame, start: Topics, steps: int = 20, fit_alpha: bool = True) -> tuple[Topics, list[float]]:
    """The model after `steps` of EM and the bounds before each of them."""
    model, trace = start, []
    for _ in range(steps):
        before = model
        model, bound = em_step(docs, model, fit_alpha)
        if len(trace) and model is not before:
            discard(before.table)
        trace.append(bound)
    return model, trace


def label_priors(labels: DataFrame, doc: str, label: str, weights: dict[object, list[float]]) -> DataFrame:
    """(doc, prior): the mean of the weights of a document's labels (each a list over topics; 0: a topic the label doesn't have)."""
    known = F.create_map(*[c for k, v in weights.items() for c in (F.lit(k), F.array(*[F.lit(float(x)) for x in v]))])
    size = len(next(iter(weights.values())))
    rows = labels.select(F.col(doc).alias("doc"), F.try_element_at(known, F.col(label)).alias("w")).where("w IS NOT NULL")
    return rows.groupBy("doc").agg(F.array(*[F.avg(F.col("w")[i]) for i in range(size)]).alias("prior"))


def plsi(counts: DataFrame, doc: str, word: str | None, n: str, k: int, lean: list[Column], steps: int = 10) -> tuple[DataFrame, DataFrame, list[float]]:
    """(word table (word, p), document table (doc, p, share), log-likelihoods of words given documents before each step) of PLSI.

    p of a word: its probability in each topic; p of a document: the topics' in it; share: the
    document's part of all counts. `lean` are positive columns over (word) that the topics start from.
    Where `word` is None, `counts` are documents that `bags` gave.
    """
    docs = bags(counts, doc, word, n) if word else counts
    each = docs.select(F.explode(F.arrays_zip("words", "n")).alias("b")).groupBy(F.col("b.words").alias("word")).agg(F.sum("b.n").alias("n"))
    factors, trace, sums = None, [], None
    kinds = docs.schema["doc"].dataType.simpleString(), docs.schema["words"].dataType.elementType.simpleString()

    def normal(table: DataFrame) -> DataFrame:
        totals = table.agg(*[F.sum(f"v{i}") for i in range(k)]).head()
        return table.select("word", F.array(*[F.col(f"v{i}") / float(t) if t else F.lit(0.0) for i, t in enumerate(totals)]).alias("p"))

    start = written(each.select("word", "n", *[(F.col("n") * c).alias(f"v{i}") for i, c in enumerate(lean)]))
    whole, words = start.agg(F.sum("n")).head()[0] or 0.0, normal(start)
    for _ in range(steps):
        rows, look = _documents(docs, words, k, lambda p: p, 0.0)
        rows = rows.join(factors.select("doc", F.col("p").alias("q")), "doc", "left") if factors is not None else rows.withColumn("q", F.array(*[F.lit(1.0 / k)] * k))
        met = rows.mapInArrow(_plsi_shares(look, k), f"word {kinds[1]}, doc {kinds[0]}, v array<double>")
        sums = written(met.groupBy("word", "doc").agg(*[F.sum(F.get("v", i)).alias(f"v{i}") for i in range(k + 1)]), instead=sums)
        seen = sums.where("word IS NULL AND doc IS NULL").head()
        trace.append(seen.v0 if seen else None)
        words = normal(sums.where("word IS NOT NULL"))
        factors = sums.where("doc IS NOT NULL").select("doc", F.array(*[F.col(f"v{i}") for i in range(k)]).alias("p"), (F.col(f"v{k}") / (whole or 1.0)).alias("share"))
    if factors is None:
        factors = docs.select("doc", F.array(*[F.lit(1.0 / k)] * k).alias("p"), (F.aggregate("n", F.lit(0.0), lambda a, v: a + v) / (whole or 1.0)).alias("share"))
    return words, factors, trace


def _parts(batch, look, k: int):
    """Of each part of a batch as in `_batches`: its rows, counts, which document each is of, where documents start, and p times q."""
    ends = np.cumsum(pc.list_value_length(batch.column("n")).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        part = batch.slice(first, last - first)
        sizes = np.diff(ends[first:last], prepend=before)
        of = np.repeat(np.arange(len(sizes)), sizes)
        q = np.array([[0.0] * k if v is None else v for v in part.column("q").to_pylist()], float).reshape(-1, k)
        yield part, part.column("n").flatten().to_numpy(), of, np.cumsum(sizes) - sizes, look(part) * q[of]
        first = last


def _plsi_shares(look, k: int):
    """A function over Arrow batches: (word, -, its parts by topic), (-, document, its shares by topic and its count), (-, -, log-likelihood)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("words").flatten().dictionary_encode()
            codes, done, likely, shares = coded.indices.to_numpy(), 0, 0.0, []
            sums = np.zeros((len(coded.dictionary), k))
            for _, n, of, start, joint in _parts(batch, look, k):
                total = joint.sum(axis=1)
                with np.errstate(divide="ignore"):
                    likely += float((n * np.log(total)).sum())
                r = joint * np.divide(n, total, out=np.zeros_like(n), where=total > 0)[:, None]
                seen, at = np.unique(codes[done : done + len(n)], return_inverse=True)
                done += len(n)
                for i in range(k):
                    sums[seen, i] += np.bincount(at, r[:, i])
                mine = np.add.reduceat(r, start, axis=0)
                size = mine.sum(axis=1, keepdims=True)
                shares.append(np.hstack([np.divide(mine, size, out=np.zeros_like(mine), where=size > 0), np.add.reduceat(n, start)[:, None]]))
            words, docs = coded.dictionary, batch.column("doc")
            ends = np.concatenate([np.arange(len(words)) * k, len(words) * k + np.arange(len(docs) + 1) * (k + 1), [len(words) * k + len(docs) * (k + 1) + 1]])
            values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([sums.ravel(), np.vstack(shares).ravel(), [likely]])))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(len(docs) + 1, words.type)]), pa.concat_arrays([pa.nulls(len(words), docs.type), docs, pa.nulls(1, docs.type)]), values], ["word", "doc", "v"])

    return run


def plsi_score(counts: DataFrame, doc: str, word: str | None, n: str, words: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, ll): ln of the document's share plus the counts' log-probabilities; -infinity where a word or the document is unknown.

    Where `word` is None, `counts` are documents that `bags` gave.
    """
    mine = bags(counts, doc, word, n) if word else counts
    first = words.head()
    k = len(first.p) if first else 1
    rows, look = _documents(mine, words, k, lambda p: p, 0.0)
    rows = rows.join(docs.select("doc", F.col("p").alias("q"), "share"), "doc", "left")

    def run(batches):
        for batch in batches:
            for part, n, _, start, joint in _parts(batch, look, k):
                share = np.array([v or 0.0 for v in part.column("share").to_pylist()])
                with np.errstate(divide="ignore"):
                    yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.log(share) + np.add.reduceat(n * np.log(joint.sum(axis=1)), start))], ["doc", "ll"])

    return rows.mapInArrow(run, f"doc {mine.schema['doc'].dataType.simpleString()}, ll double")
