"""Learned operators: their recursions against brute force, and accuracy on rows held out."""

import tracemalloc
from itertools import combinations, product

import numpy as np
import pytest

from tessel.llm import language_id, line_quality, registry, toxicity

MID, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(score, label):
    s, y = np.array(score, float), np.array(label) > 0
    wins = (s[y][:, None] > s[~y][None]).sum() + 0.5 * (s[y][:, None] == s[~y][None]).sum()
    return wins / (y.sum() * (~y).sum())


def test_chain_equals_all_labellings():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 3])
    evidence, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, pairs, log_z = line_quality.chain(evidence, lines, trans)
    at, want, want_pairs, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in lines:
        e = evidence[at : at + n]
        at += n
        total, good, moved = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            good += w * np.array(y)
            for i in range(n - 1):
                moved[y[i], y[i + 1]] += w
        want += (good / total).tolist()
        want_pairs += moved / total
        want_z += np.log(total)
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def random_lines(rng, lines):
    return rng.integers(0, line_quality.BINS + 1, (line_quality.FIGURES, lines.sum())).astype(np.uint8), rng.integers(0, 90, lines.sum())


def test_evidence_and_its_gradient_equal_plain_sums():
    rng = np.random.default_rng(3)
    lines = np.array([1, 4, 1, 3])
    own, _ = random_lines(rng, lines)
    weights, rest = rng.normal(size=(3, line_quality.FIGURES, line_quality.WIDTH)), rng.normal(size=lines.sum())
    want, want_sums, at = np.zeros(lines.sum()), np.zeros_like(weights), 0
    for n in lines:
        for i in range(n):
            for k, j in enumerate((i, i - 1, i + 1)):
                for f in range(line_quality.FIGURES):
                    part = own[f, at + j] if 0 <= j < n else line_quality.MISSING
                    want[at + i] += weights[k, f, part]
                    want_sums[k, f, part] += rest[at + i]
        at += n
    assert np.allclose(line_quality.line_evidence(weights.ravel(), own, lines), want)
    assert np.allclose(line_quality.gathered(rest, own, lines), want_sums.ravel())


def test_training_in_blocks_equals_training_in_one():
    rng = np.random.default_rng(4)
    lines, good = rng.integers(1, 9, 40), rng.integers(0, 2, 40)
    own, size = random_lines(rng, lines)
    own[0, np.repeat(good, lines) > 0] //= 2
    one, many = (line_quality.train(own, size, lines, good, steps=20, block=block) for block in (1 << 16, 11))
    assert np.allclose(one.weights, many.weights) and np.allclose(one.trans, many.trans)
    assert np.allclose([one.slope, one.offset], [many.slope, many.offset])
    assert [b - a for a, b in line_quality.blocks(np.array([3, 20, 2, 2, 2, 5]), np.array([0, 0, 0, 1, 1, 1]), 4)] == [1, 1, 1, 2, 1]


def test_texts_learned_from_stay_in_tasks(spark):
    plain, loud = "some quiet words of a line, ", "BUY! NOW || $$$ 100 "
    docs = spark.range(60).selectExpr("id as doc_id", f"repeat(case when id % 2 = 0 then '{plain}' else '{loud}' end, 6000 + 100 * cast(id as int)) as text")
    labels = spark.range(60).selectExpr("id as doc_id", "cast(1 - id % 2 as int) as quality")
    tracemalloc.start()
    try:
        field = line_quality.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 13 MB of text; the driver only has some numbers of each line.
    assert peak < 4e6
    low, high = field.scores([(t * 8_000).encode() for t in (loud, plain)])
    assert low < 0.3 < 0.7 < high


def test_kernel_norms_equal_all_subsequences():
    for word in ("abcab", "aaaa", "badidea", "sentences"):
        codes = toxicity.encode(word)[0]
        sums = {}
        for at in combinations(range(len(codes)), toxicity.ORDER):
            key = tuple(codes[i] for i in at)
            sums[key] = sums.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        want = np.sqrt(sum(v * v for v in sums.values()))
        assert np.isclose(toxicity.norms(np.array([codes]))[0], want, rtol=1e-4)


def plain_kernel(a, b):
    """The normalised kernel of two words, over all their subsequences."""
    sums = []
    for word in (a, b):
        (codes,) = toxicity.encode(word)
        one = {}
        for at in combinations(range(len(codes)), toxicity.ORDER):
            key = tuple(codes[i] for i in at)
            one[key] = one.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        sums.append(one)
    dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
    return dot(*sums) / np.sqrt(dot(sums[0], sums[0]) * dot(sums[1], sums[1]))


def test_landmark_sum_folds_into_subsequence_weights():
    marks, words = ["blockhead", "sentence", "abcabcab", "wordings"], ["blxockhead", "sentences", "bcabca", "zzzzqq", "head", "wordwords"]
    rows, cols, vals = toxicity.kernel_features(marks)
    used, place = np.unique(cols, return_inverse=True)
    table = np.zeros((len(used) + 1, len(marks)), np.float32)
    np.add.at(table, (place + 1, rows), vals)
    slot = np.zeros(toxicity.ALPHABET**toxicity.ORDER, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    want = np.array([[plain_kernel(w, m) for m in marks] for w in words])
    assert np.allclose(toxicity.with_landmarks(words, table, slot), want, atol=1e-5)
    beta = np.array([1.5, -0.7, 0.3, 2.0])
    weights = np.zeros(toxicity.ALPHABET**toxicity.ORDER, np.float32)
    weights[used] = table[1:] @ beta
    # A margin is never below the bias, that of a text without any unit.
    assert np.allclose(toxicity.Machine(weights, -1.0).margins(words), np.maximum(want @ beta, 0) - 1.0, atol=1e-5)


def test_network_equals_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = language_id.ByteNet(["a", "b"], [rng.normal(size=(w, language_id.CLASSES, 3)) for w in (2, 3)], rng.normal(size=(6, 2)), np.zeros(2))
    x = language_id.windows([b"some words of a text"])[0]
    want = []
    for f in net.filters:
        w = len(f)
        best = [max(0.0, max(sum(f[j, x[0, i + j], c] for j in range(w)) for i in range(x.shape[1] - w + 1))) for c in range(3)]
        want += best
    assert np.allclose(net.features(x)[0], want)


@pytest.mark.parametrize(("name", "label"), [("op2_line_quality", "quality"), ("op3_toxicity", "toxic")])
def test_held_out_order(spark, name, label):
    got = registry.QUERIES[name](spark, LARGE).where("held_out")
    rows = got.join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").select("score", label).collect()
    assert len({r[1] for r in rows}) == 2 and auc([r[0] for r in rows], [r[1] for r in rows]) >= 0.9


def test_few_labels_leave_clean_documents_alone(spark):
    got = registry.QUERIES["op3_toxicity"](spark, MID).where("held_out")
    rows = got.join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").where("toxic = 0").select("predicted").collect()
    assert np.mean([r.predicted for r in rows]) <= 0.1


def test_gapped_insults_stay_close():
    sentences, kinds = [], {}
    rng = np.random.default_rng(0)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]
    for d in range(120):
        kinds[d] = int(d % 3 == 0)
        words = list(rng.choice(plain, 8)) + (["blockhead"] if kinds[d] else [])
        sentences.append((d, " ".join(words)))
    model = toxicity.train(sentences, kinds)
    for text in ("blockhead", "blxockhead", "bl0ck-head", "b l o c k h e a d"):
        assert model.document({u for u in toxicity.units(text)} if not model.remember(set(toxicity.units(text))) else set()) > model.bias
        assert model.score(model.document(set(toxicity.units(text)))) >= 0.5


def test_language_held_out(spark):
    got = registry.QUERIES["op8_language_id"](spark, MID).where("held_out")
    rows = got.join(spark.read.parquet(f"{MID}/documents.parquet").where("lang is not null and length(text) >= 200").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.lang_pred == r.lang for r in rows]) >= 0.9


def test_odd_texts_have_defined_scores(spark, odd):
    for name in ("op2_line_quality", "op3_toxicity"):
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out in (True, False) for r in registry.QUERIES[name](spark, odd).collect())
    for r in registry.QUERIES["op8_language_id"](spark, odd).collect():
        if r.doc_id in (1, 2, 3, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred == "en" and 0 <= r.score <= 1


def test_without_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a text", "x"), (None, None, "y")], "doc_id long, text string, score string")
    assert [r.s for r in line_quality.score(docs, None, ("doc_id", "score"), "s").collect()] == [1.0, 1.0]
    assert [r.s for r in toxicity.score(docs, None, ("doc_id", "score"), "s").collect()] == [0.0, 0.0]
    assert [r.l for r in language_id.predict(docs, None, ("doc_id", "score"), "l", "s").collect()] == ["und", "und"]
