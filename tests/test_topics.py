"""Topic models against numpy, document by document, and as their bounds must behave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import topics as tp

VOCABULARY = list("abcdef")
BETA = np.array([[0.5, 0.2, 0.1, 0.1, 0.05, 0.05], [0.1, 0.1, 0.3, 0.3, 0.1, 0.1], [0.05, 0.05, 0.1, 0.1, 0.3, 0.4]])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    counts = np.array([rng.multinomial(int(rng.integers(5, 40)), rng.dirichlet([0.6, 0.3, 0.4]) @ BETA) for _ in range(40)])
    rows = [(d, w, int(c)) for d, row in enumerate(counts) for w, c in zip(VOCABULARY, row, strict=True) if c]
    rows += [(None, "a", 3), (1, None, 4), (2, "a", 0), (3, "b", None)]
    return counts, spark.createDataFrame(rows, "doc int, word string, n int")


def table(spark, beta):
    return spark.createDataFrame([(w, [float(v) for v in beta[:, i]]) for i, w in enumerate(VOCABULARY)], "word string, p array<double>")


def plain(counts, alpha, beta):
    """One document after the other, one word after the other."""
    sums, logs, bounds, gammas = np.zeros_like(beta), np.zeros(len(alpha)), [], []
    for row in counts:
        gamma = alpha + row.sum() / len(alpha)
        for _ in range(20_000):
            phi = beta.T * np.exp(tp.digamma(gamma))
            phi /= phi.sum(axis=1, keepdims=True)
            new = alpha + row @ phi
            gamma, old = new, gamma
            if np.abs(gamma - old).max() < 1e-13:
                break
        e = tp.digamma(gamma) - tp.digamma(gamma.sum())
        phi = beta.T * np.exp(e)
        phi /= phi.sum(axis=1, keepdims=True)
        bound = tp.lgamma(alpha.sum()) - tp.lgamma(alpha).sum() + ((alpha - 1) * e).sum() - tp.lgamma(gamma.sum()) + tp.lgamma(gamma).sum() - ((gamma - 1) * e).sum()
        bound += (row[:, None] * phi * (e + np.log(beta.T) - np.log(phi))).sum()
        sums, logs = sums + (row[:, None] * phi).T, logs + e
        bounds.append(bound)
        gammas.append(gamma)
    return sums, logs, np.array(bounds), np.array(gammas)


def test_special_functions():
    import math

    for x in (1e-4, 0.3, 1.0, 2.5, 7.9, 8.1, 40.0, 1e6):
        assert np.isclose(tp.lgamma(np.array([x]))[0], math.lgamma(x), rtol=1e-12, atol=1e-12)
        h = x * 1e-5
        assert np.isclose(tp.digamma(np.array([x]))[0], (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rtol=1e-5, atol=1e-5)
        assert np.isclose(tp.trigamma(np.array([x]))[0], (tp.digamma(np.array(x + h)) - tp.digamma(np.array(x - h))) / (2 * h), rtol=1e-5)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_lda_step_and_score_equal_numpy(spark, corpus, monkeypatch, sent):
    monkeypatch.setattr(tp, "SENT_WORDS", sent)
    counts, rows = corpus
    docs, alpha = tp.bags(rows, "doc", "word", "n"), np.array([0.7, 0.4, 1.1])
    sums, logs, bounds, gammas = plain(counts, alpha, BETA)
    model = tp.Topics(alpha, table(spark, BETA))
    got = {r.doc: r for r in tp.score(docs, model, 1e-14, 20_000).collect()}
    assert len(got) == 40
    for d in range(40):
        assert np.isclose(got[d].bound, bounds[d], atol=1e-7) and np.allclose(got[d].gamma, gammas[d], atol=1e-6) and got[d].n == counts[d].sum()
    new, bound = tp.em_step(docs, model, True, 1e-14, 20_000)
    assert np.isclose(bound, bounds.sum(), atol=1e-6)
    want = sums / sums.sum(axis=1, keepdims=True)
    assert all(np.allclose(r.p, want[:, VOCABULARY.index(r.word)], atol=1e-8) for r in new.table.collect())
    # The new weights make the mean logarithms likeliest.
    assert np.allclose(tp.digamma(new.alpha) - tp.digamma(new.alpha.sum()), logs / 40, atol=1e-7)


def test_lda_bound_rises(spark, corpus):
    docs = tp.bags(corpus[1], "doc", "word", "n")
    model, trace = tp.fit(docs, tp.start_topics(docs, 3), 8)
    assert all(b >= a - 1e-7 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] > trace[0] + 1
    assert np.isclose(model.table.agg(F.sum(F.col("p")[0])).head()[0], 1)


def test_labels_allow_topics_and_unknown_words_are_impossible(spark):
    rows = spark.createDataFrame([(1, "a", 3, "x"), (1, "c", 1, "x"), (2, "a", 2, "y"), (2, "f", 2, "y"), (3, "zzz", 1, "x")], "doc int, word string, n int, label string")
    priors = tp.label_priors(rows.select("doc", "label").distinct(), "doc", "label", {"x": [1.0, 0.5, 0.0], "y": [0.0, 0.0, 2.0]})
    docs = tp.bags(rows.join(priors, "doc"), "doc", "word", "n", "prior")
    got = {r.doc: r for r in tp.score(docs, tp.Topics(np.ones(3), table(spark, BETA))).collect()}
    assert got[1].gamma[2] == 0 and got[2].gamma == [0.0, 0.0, 6.0] and got[3].bound == -np.inf
    assert np.isclose(got[2].bound, 2 * np.log(0.05) + 2 * np.log(0.4))
    sub = plain(np.array([[3, 0, 1, 0, 0, 0]]), np.array([1.0, 0.5]), BETA[:2])
    assert np.isclose(got[1].bound, sub[2][0], atol=1e-7)
    model, bound = tp.em_step(docs, tp.Topics(np.ones(3), table(spark, BETA)))
    assert np.isfinite(bound) and np.allclose(model.alpha, 1)


def test_plsi_climbs_and_scores(spark, corpus):
    counts, rows = corpus
    lean = [1 + F.ascii("word") % 3, 1 + F.ascii("word") % 2, 1 + F.ascii("word") % 5]
    words, docs, trace = tp.plsi(rows, "doc", "word", "n", 3, lean, 6)
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:], strict=False))
    p = {r.word: np.array(r.p) for r in words.collect()}
    assert np.allclose(sum(p.values()), 1)
    theta = {r.doc: (np.array(r.p), r.share) for r in docs.collect()}
    score = {r.doc: r.ll for r in tp.plsi_score(rows, "doc", "word", "n", words, docs).collect()}
    for d, row in enumerate(counts):
        q, share = theta[d]
        assert np.isclose(q.sum(), 1) and np.isclose(score[d], np.log(share) + sum(c * np.log(q @ p[w]) for w, c in zip(VOCABULARY, row, strict=True) if c))


def test_only_unlikely_words_of_a_large_table_are_joined(spark, corpus, monkeypatch):
    monkeypatch.setattr(tp, "SENT_WORDS", 3)
    counts, rows = corpus
    docs, alpha = tp.bags(rows, "doc", "word", "n"), np.array([0.6, 0.3, 0.4])
    model = tp.Topics(alpha, table(spark, BETA))
    met, _ = tp._documents(docs, model.table, 3)
    assert "logp" not in met.columns
    said = {r.doc: {r.words[x.at]: x.logp for x in r.rest or []} for r in met.collect()}
    assert 0 < sum(map(len, said.values())) < (counts > 0).sum() and not {w for d in said.values() for w in d} & {"a", "f"}
    got = {r.doc: r for r in tp.score(docs, model).collect()}
    _, _, bounds, gammas = plain(counts, alpha, BETA)
    assert np.allclose([got[d].bound for d in range(len(counts))], bounds, atol=1e-6)
    assert np.allclose([got[d].gamma for d in range(len(counts))], gammas, rtol=1e-4)


def test_documents_of_unlike_sizes_and_topics_go_together(monkeypatch):
    """Blocks of several sizes, topics that a document can't have and words that none of its topics has."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 50)
    start, alpha = np.cumsum(sizes) - sizes, np.where(rng.random((50, 4)) < 0.4, 0.0, 0.7)
    alpha[:, 1] = 0.5
    logp, n = np.log(rng.dirichlet(np.ones(4), sizes.sum())), rng.integers(1, 9, sizes.sum()).astype(float)
    logp[7] = -np.inf
    monkeypatch.setattr(tp, "TOGETHER", 200)
    gamma, phi, bound, _ = tp.fixed_point(alpha, logp, n, start)
    for d in range(50):
        at = slice(start[d], start[d] + sizes[d])
        alone = tp.fixed_point(alpha[d : d + 1], logp[at], n[at], np.array([0]))
        assert np.allclose(gamma[d], alone[0][0], atol=1e-9) and np.allclose(phi[at], alone[1], atol=1e-9)
        assert bound[d] == alone[2][0] or np.isclose(bound[d], alone[2][0])
        assert (gamma[d][alpha[d] == 0] == 0).all()


def test_plsi_takes_documents_written_once(spark, corpus, monkeypatch):
    """Bags in place of counts give the same, also where some words are joined; a document of another corpus has no share."""
    _, rows = corpus
    lean = [1 + F.ascii("word") % 3, 1 + F.ascii("word") % 2]
    words, docs, trace = tp.plsi(rows, "doc", "word", "n", 2, lean, 3)
    score = {r.doc: r.ll for r in tp.plsi_score(rows, "doc", "word", "n", words, docs).collect()}
    monkeypatch.setattr(tp, "SENT_WORDS", 3)
    bags = tp.bags(rows, "doc", "word", "n")
    again, others, trace2 = tp.plsi(bags, "doc", None, "n", 2, lean, 3)
    assert np.allclose(trace, trace2, rtol=1e-12)
    p = {r.word: r.p for r in words.collect()}
    assert all(np.allclose(r.p, p[r.word], rtol=1e-10) for r in again.collect())
    got = {r.doc: r.ll for r in tp.plsi_score(bags, "doc", None, "n", again, others.where("doc <> 0")).collect()}
    assert got.pop(0) == -np.inf and all(np.isclose(v, score[d], rtol=1e-10) for d, v in got.items())


def test_bags_of_words_equal_bags_of_counts_and_stay_where_they_are(spark):
    """Rows of one document meet, nulls and empty lists go, and a join by document doesn't move the documents."""
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c", None, "c"]), (1, ["a", "d"]), (3, []), (4, None), (None, ["a"]), (5, ["zé"] * 3)], "doc int, words array<string>")
    said = {r.doc: dict(zip(r.words, r.n, strict=True)) for r in tp.bags_of_words(rows, "doc", "words").collect()}
    assert said == {1: {"a": 3, "b": 1, "d": 1}, 2: {"c": 2}, 5: {"zé": 3}}
    priors = spark.createDataFrame([(1, [0.5, 0.0]), (9, [1.0, 1.0])], "doc int, prior array<double>")
    docs = tp.bags_of_words(rows.where("doc <> 2"), "doc", "words", priors)
    assert [(r.doc, r.prior, sum(r.n)) for r in docs.collect()] == [(1, [0.5, 0.0], 5)]
    for docs in (docs, tp.bags(rows.select("doc", F.explode("words").alias("word"), F.lit(1).alias("n")), "doc", "word", "n")):
        other = spark.range(5).groupBy(F.col("id").cast("int").alias("doc")).agg(F.collect_list("id").alias("x"))
        plan = docs.join(other.hint("merge"), "doc", "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    assert not spark.catalog.listTables()


def test_slow_documents_reach_their_fixed_point():
    """Topics that hardly differ: plain rounds take thousands, extrapolated ones end well within `ROUNDS`, at the same point."""
    rng = np.random.default_rng(5)
    beta = rng.dirichlet(np.ones(60))[:, None] * (1 + 0.2 * rng.random((60, 4)))
    logp, n, start = np.log(np.tile(beta, (20, 1))), rng.integers(1, 9, 1200).astype(float), np.arange(20) * 60
    gamma, _, bound, _ = tp.fixed_point(np.ones((20, 4)), logp, n, start)
    for d in range(20):
        at = slice(start[d], start[d] + 60)
        g = 1 + np.full(4, n[at].sum() / 4)
        for _ in range(30_000):
            phi = np.exp(logp[at]) * np.exp(tp.digamma(g))
            g = 1 + n[at] @ (phi / phi.sum(axis=1, keepdims=True))
        assert np.allclose(gamma[d], g, rtol=1e-5)
    assert (tp.fixed_point(np.ones((20, 4)), logp, n, start, rounds=300)[2] >= bound - 1e-6).all()
    for rounds in (1, 2, 3, 4):
        some = tp.fixed_point(np.ones((20, 4)), logp, n, start, rounds=rounds)[0]
        assert (some >= 1).all() and np.allclose(some.sum(axis=1), gamma.sum(axis=1))
