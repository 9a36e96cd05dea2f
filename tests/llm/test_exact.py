"""Operators whose results are fixed to the last row: against the libraries, SQL and brute force."""

import hashlib
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import decontamination, jaccard_join, nearest, piece_encoding, registry, sharding, token_counts, warc
from tests.llm.conftest import TEXTS


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def tokens_by_library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.default_tokenizer())
    tok.no_truncation()
    tok.no_padding()
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_op1_equals_the_library(spark, sf, odd):
    for folder in (sf, odd):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        texts = [r.text or "" for r in docs]
        want = sorted((repr(r.doc_id), len(t.encode()), n, n > 2048) for r, t, n in zip(docs, texts, tokens_by_library(texts), strict=True))
        got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in registry.QUERIES["op1_token_counts"](spark, folder).collect())
        assert got == want


def test_op1_table_of_frequent_pretokens_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(token_counts.count_tokens(docs, hot_pretokens=5)) == rows_of(token_counts.count_tokens(docs))


def test_op4_equals_the_library(spark, sf, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model())
    for folder in (sf, odd):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = []
        for r in docs:
            ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
            want.append((repr(r.doc_id), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
        got = [(repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op4_piece_encoding"](spark, folder).collect()]
        assert sorted(got) == sorted(want)


def test_op4_spans_cover_the_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(t for _, t in TEXTS if t)], "doc_id long, text string")
    for r in piece_encoding.encode_documents(rows, carry=("text",)).collect():
        data = r.text.encode()
        spans = np.frombuffer(r.spans, "<u4").reshape(-1, 2).astype(int)
        assert len(spans) * 4 == len(r.ids) and spans[0].tolist() == [0, 0] and spans[-1].tolist() == [len(data)] * 2
        inner = spans[1:-1]
        assert (inner[1:, 0] == inner[:-1, 1]).all() and inner[0, 0] == 0 and inner[-1, 1] == len(data)
        assert b"".join(data[a:b] for a, b in inner) == data


def sharded(rows, limit):
    """Brute force: a trie over hashes, split where it is too large."""
    hashed = []
    for i, t in rows:
        inner = hashlib.md5((t or "").encode()).hexdigest()
        key = hashlib.md5(f"{'' if i is None else i}:{inner}".encode()).hexdigest()
        hashed.append((i, len((t or "").encode()), format(int(key[:15], 16), "060b")))
    out = []

    def split(group, depth):
        total = sum(n for _, n, _ in group)
        if total <= limit or len({h for _, _, h in group}) == 1 or depth == 60:
            out.extend((i, n, depth, h[:depth], total, total > limit) for i, n, h in group)
            return
        for bit in "01":
            part = [g for g in group if g[2][depth] == bit]
            if part:
                split(part, depth + 1)

    split(hashed, 0)
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10, 2_000, 100_000, 1 << 30])
def test_op5_equals_a_trie(spark, sf, limit):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + TEXTS
    got = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), limit)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sharded(docs, limit)


@pytest.mark.parametrize("name", ["op5_sharding", "op7_warc", "op10_jaccard_join"])
def test_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = registry.QUERIES[name](spark, sf)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(got.columns)]
    assert rows_of(got) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


QUESTION = "A farmer in the valley had 12 sheep and bought 7 more at the market before he sold 3 of them to Martin last week. How many sheep were left"


def found_in(spark, texts, items=(QUESTION,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id for r in decontamination.contaminated(docs, bench).collect()}


def test_op6_finds_copies_and_changed_parameters(spark):
    other = QUESTION.replace("12", "30").replace("7", "9").replace("3 of", "5 of").replace("Martin", "Oliver")
    texts = [QUESTION, f"Some words stand before it. {other}. And others after it.", "A farmer had sheep, and no question at all was asked about them in this text of some length.", "", None]
    assert found_in(spark, texts) == {0, 1}


def test_op6_slots_must_be_consistent(spark):
    item = "compare 5 with 5 and then 5 with 5 again until 5 is the sum of all 5 parts of it"
    good = item.replace("5", "8")
    values = iter(["1", "2", "3", "4", "6", "7"])
    bad = "".join(next(values) if c == "5" else c for c in item)
    assert found_in(spark, [good, bad], (item,)) == {0}


def test_op6_copies_beside_variants_are_found(spark):
    variant = lambda a, b, c, name: QUESTION.replace("12", a).replace("7", b).replace("3 of", f"{c} of").replace("Martin", name)
    oliver, paul = variant("30", "9", "5", "Oliver"), variant("41", "8", "6", "Paul")
    longer = QUESTION.replace("the market", "the big old market")
    texts = [f"{QUESTION}? {oliver}?", f"{oliver}? {paul}? {variant('52', '4', '2', 'Simon')}?", f"{longer}? {oliver}?", "nothing of that kind is asked here at all in so many words"]
    assert found_in(spark, texts) == {0, 1, 2}
    assert found_in(spark, [f"{QUESTION}? {oliver}?"], (QUESTION, oliver)) == {0}
    # Rows of one doc_id are judged alone, each by its own text.
    docs = spark.createDataFrame([(1, QUESTION), (1, "some other text"), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, QUESTION)], "item_id long, text string")
    assert [(r.doc_id, r["items"]) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 1)]


def test_op6_rows_without_an_id_or_with_one_and_the_same_are_judged_by_their_texts(spark, monkeypatch, tmp_path):
    """1,000 rows of each kind, of which three and two hold an item: those alone are found, with and without a broadcast."""
    from tessel.llm.pipeline import decontaminate

    clean = lambda k: f"a clean text of number {k} with some words that no benchmark has in it"
    rows = [(None, QUESTION if k < 3 else clean(k), "x") for k in range(1000)] + [(5, f"{QUESTION} {k}" if k < 2 else clean(k), "x") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d_text string")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for most in (decontamination.BROADCAST_TEXTS, -1):
        monkeypatch.setattr(decontamination, "BROADCAST_TEXTS", most)
        kept = decontaminate(spark, docs, str(tmp_path)).collect()
        assert len(kept) == 1995 and not any(QUESTION in r.text for r in kept) and kept[0].d_text == "x"
        got = decontamination.contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
        assert sorted(str(r.doc_id) for r in got) == ["5"] * 2 + ["None"] * 3


def test_op1_tells_texts_of_equal_length_and_crc_apart(spark):
    import zlib

    texts = ["221e0h 20fg hg3f gd1gd0c", "bdbe03c3f2f0acbd3 fgd1e2"]
    assert len({zlib.crc32(t.encode()) for t in texts}) == 1
    docs = spark.createDataFrame([(None, t) for t in texts * 3], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts.count_tokens(docs).collect()) == sorted(tokens_by_library(texts * 3))


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 5, lambda k: k])
def test_op10_moves_as_many_texts_whatever_their_ids(spark, monkeypatch, ids):
    """Rows that meet a class stay in proportion to the rows, also if none has an id or all have one."""
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(words[7 * k : 7 * k + 60] + ([f"x{j}"] if j else [])) for k in range(100) for j in range(2)]
    docs = spark.createDataFrame([(ids(k), t) for k, t in enumerate(texts)], "doc_id long, text string")
    seen = []

    def counted(docs, wanted, size, real=jaccard_join.class_texts):
        found = real(docs, wanted, size)
        seen.append(docs.select(jaccard_join.named(docs).alias("key"), F.xxhash64("text").alias("t")).join(wanted, ["key", "t"]).count())
        return found

    monkeypatch.setattr(jaccard_join, "class_texts", counted)
    got = jaccard_join.similar_components(docs)
    assert got.count() == 200 and seen and max(seen) <= 200
    if ids(3) == 3:
        assert got.select("component_id").distinct().count() == 100


def test_op6_dense_items_and_other_case_are_found(spark):
    dense = "Add 12 7 31 4 55 18 and 9 2 6 3 14 15 and 16 8 19 1 77 20 in all"
    people = "when Anna met Boris and Clara saw Dmitri with Elena near Felix while Greta took Hans to Irma"
    other = "Add 13 7 32 5 56 19 and 8 3 7 4 15 16 and 17 9 20 2 78 21 in all"
    texts = [f"some words {dense} and more", f"it was {people.lower()} they said", f"It was, {people.upper()}", f"so {QUESTION.lower()}", QUESTION.title(), other, "a text that has no such words in it at all"]
    assert found_in(spark, texts, (dense, people, QUESTION)) == {0, 1, 2, 3, 4}


def test_op6_without_a_broadcast_finds_the_same(spark, monkeypatch, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    few = rows_of(decontamination.contaminated(docs, bench))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", -1)
    assert few and rows_of(decontamination.contaminated(docs, bench)) == few


def test_op6_planted_items_equal_brute_force(spark, sf):
    """Every document that holds an item's words unbroken is found."""
    import re

    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i for i, t in docs if any(x in t for x in items if len(x.split()) >= 8)}
    found = {r.doc_id for r in registry.QUERIES["op6_decontamination"](spark, sf).where("contaminated").collect()}
    assert held and held <= found


def test_op6_uses_no_python(spark, sf):
    plan = registry.QUERIES["op6_decontamination"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_op7_segments_and_faults(spark, tmp_path):
    pages = spark.createDataFrame([(i, "ab\r\n0\r\n\r\n" * (i * 900)) for i in range(1, 9)], "page_id long, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(warc.with_revisits(pages), path, segment_bytes=3000)
    records = warc.read_records(spark, path).cache()
    assert records.where("record_type = 'continuation'").count() > 8
    whole = {r.page_id: r for r in warc.read_payloads(spark, path).collect()}
    for r in pages.collect():
        assert whole[r.page_id].payload_digest == hashlib.sha1(r.html.encode()).hexdigest() and whole[r.page_id].error is None
    third = records.where("target like '%:page:3:%'").first().origin
    torn = warc.reassemble(records.where(f"not (segment = 2 and origin = '{third}')"))
    bad = {r.target: r.error for r in torn.where("error is not null").collect()}
    assert len(bad) == 1 and "a segment is missing" in bad.popitem()[1]
    doubled = warc.reassemble(records.unionByName(records.where("record_type = 'continuation'")))
    assert doubled.where("error is not null").isEmpty()


def test_op7_odd_rows(spark, odd):
    got = registry.QUERIES["op7_warc"](spark, odd)
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes, r.error))
    assert by[1] == [("revisit", 2, 2000, None)] and by[3] == by[4] == [("response", None, 5, None)] and by[5] == [("response", None, 0, None)]
    assert by[6][0][:2] == ("revisit", 7) and by[7][0][0] == "response" and got.count() == 10
    assert sorted(by[None], key=repr) == [("response", None, 0, None), ("revisit", 2, 2000, None)]


def test_op7_rows_that_share_an_id_keep_their_own_records(spark, tmp_path):
    long, other = "a" * 150_000, "b" * 150_000
    rows = [(None, long + "1"), (None, long + "2"), (5, long), (5, other), (5, other), (4, other), (3, long + "1")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["op7_warc"](spark, str(tmp_path))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(None, sha(long + "1"), "revisit", 3), (None, sha(long + "2"), "response", None), (5, sha(long), "response", None), (5, sha(other), "response", None), (5, sha(other), "response", None), (4, sha(other), "revisit", 5), (3, sha(long + "1"), "response", None)]
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert got.where("error is not null").isEmpty() and got.where("payload_bytes < 150000").isEmpty()


def exact_near(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    most = max((len(v) for v in good.values()), key=[len(v) for v in good.values()].count)
    good = {i: v for i, v in good.items() if len(v) == most}
    return {q: sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:k] for q in good if q % every == 0}


def test_op9_recall_and_distances(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact_near(rows, 10, 100)
    got = {}
    for r in registry.QUERIES["op9_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want) and all(len(x) == 10 and x == sorted(x) for x in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_op9_odd_rows_ties_and_blocks(spark, odd, odd_rows):
    want = exact_near([r[:2] for r in odd_rows["embeddings"]], 10, 100)
    got = {}
    for r in registry.QUERIES["op9_nearest"](spark, odd).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == want
    rng = np.random.default_rng(0)
    many = [(i, [float(x) for x in rng.integers(0, 2, 4)]) for i in range(600)]
    table = spark.createDataFrame(many, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest(table, window=64, part=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == exact_near(many, 10, 100)


def clusters(n, size, dim, rng):
    """n vectors in groups of `size` around centres that are far apart."""
    centres = rng.normal(size=(n // size, dim))
    return (np.repeat(centres, size, axis=0) + 0.1 * rng.normal(size=(n // size * size, dim))).astype(np.float32)


def test_op9_recall_at_production_settings_over_many_segments(spark, capsys):
    """Vectors in groups and vectors without structure: recall against brute force, and how many vectors a query meets."""
    rng = np.random.default_rng(5)
    for name, x, most in (("groups", clusters(20_000, 50, 64, rng), 0.25), ("isotropic", rng.normal(size=(20_000, 64)).astype(np.float32), 1.3)):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        index = nearest.Curves(x[: nearest.SAMPLE].astype(float))
        side = index.fit_window(x[: nearest.SAMPLE].astype(float), 11, len(x))
        met = nearest.CURVES * min(1.0, (2 * side + 1) / index.segments)
        got = {}
        for r in nearest.nearest(table).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall = []
        for q in range(0, len(x), 100):
            d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
            d[q] = np.inf
            recall.append(len(got[q] & set(np.argsort(d)[:10].tolist())) / 10)
        with capsys.disabled():
            print(f"\n{name}: recall {np.mean(recall):.3f}, {side} segments of {index.segments} on each side, {met:.2f} x the table met a query")
        assert index.segments >= 20 and np.mean(recall) >= 0.9 and met <= most


def linked(rows, size, percent):
    """Brute force over all pairs: the smallest doc_id that links reach."""
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    name = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            name[find(i)] = min(doc, name.get(find(i), doc))
    return sorted(((d, len(s), name.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_op10_equals_brute_force(spark, size, percent):
    rng = np.random.default_rng(size)
    rows, base = list(TEXTS), [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (5, 9, 30, 30, 120, 400)]
    for i in range(150):
        words = base[i % len(base)].split()
        for _ in range(rng.integers(0, 1 + len(words) // 12)):
            words[rng.integers(len(words))] = f"w{rng.integers(0, 40)}"
        rows.append((100 + i, " ".join(words[: len(words) - int(rng.integers(0, 3))])))
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), size, percent)
    want = linked(rows, size, percent)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == want
    assert len({c for _, _, c in want}) < len(want) - 20


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"pipeline"}))
def test_no_rows_in_none_out(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 60])
def test_op10_similar_sets_share_a_signature_whatever_is_common(percent):
    rng = np.random.default_rng(percent)
    pool = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 15, 16, 31, 40, 63, 64, 127, 200, 500, 1023, 3000):
        first = np.unique(rng.choice(pool, n, replace=False))
        sets = [first]
        for _ in range(12):
            out = rng.integers(0, max(1, int(len(first) * (100 - percent) / 100)) + 1)
            kept = rng.permutation(first)[out:]
            sets.append(np.unique(np.concatenate([kept, rng.choice(pool, rng.integers(0, out + 1))])))
        values, counts = np.concatenate(sets), np.array([len(s) for s in sets])
        _, every = jaccard_join.signatures(values, counts, percent, None)
        some = rng.permutation(np.unique(every))[: len(every) // 3]
        for common in (jaccard_join.Common(np.zeros(0, np.int64), np.zeros(0, np.int64)), jaccard_join.Common(some, rng.integers(6, 1000, len(some)))):
            who, sig = jaccard_join.signatures(values, counts, percent, common)
            given = [set(sig[who == i].tolist()) for i in range(len(sets))]
            for i in range(len(sets)):
                for j in range(i):
                    shared = len(np.intersect1d(sets[i], sets[j]))
                    union = len(sets[i]) + len(sets[j]) - shared
                    if 100 * shared >= percent * union and shared < union:
                        assert given[i] & given[j], (n, i, j)


def test_op10_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for n in (4, 30, 100, 700, 5000):
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))]
        for _ in range(6):
            sets.append(np.unique(np.concatenate([rng.permutation(sets[0])[: int(n * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1)).astype(np.uint64)])))
        values, counts = np.concatenate(sets), np.array([len(s) for s in sets])
        own, up = jaccard_join.sketches(values, counts, 80)
        bands = jaccard_join.band_of(counts)
        for i in range(len(sets)):
            for j in range(i):
                for band in {bands[i], bands[j]}:
                    x, y = ((own if bands[k] == band else up if bands[k] + 1 == band else [None] * len(sets))[k] for k in (i, j))
                    if x is not None and y is not None:
                        differ = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
                        assert differ <= len(np.setxor1d(sets[i], sets[j]))


def test_op10_large_groups_in_blocks_equal_brute_force(spark, monkeypatch):
    """Many texts around one, in buckets far larger than a block, and a passage that unlike texts share."""
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 100_000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for i in range(150):
        text = base[:]
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            text[at] = word()
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join([*[word() for _ in range(rng.integers(5, 40))], *passage])) for i in range(120)]
    plain = jaccard_join.likely_pairs
    monkeypatch.setattr(jaccard_join, "likely_pairs", lambda *a: plain(*a, block_bytes=700))
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == linked(rows, 4, 85)


@pytest.mark.parametrize("name", ["op2_line_quality", "op3_toxicity", "op5_sharding", "op6_decontamination", "op8_language_id", "op10_jaccard_join"])
def test_odd_rows_give_a_row_each(spark, odd, name):
    got = registry.QUERIES[name](spark, odd)
    want = sorted(repr(i) for i, _ in TEXTS)
    assert sorted(repr(r.doc_id) for r in got.select(F.col("doc_id")).collect()) == want
