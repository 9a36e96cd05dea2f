"""Main text of pages, the audit of filters and whitening: against SQL, plain loops and dense algebra."""

import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tessel.llm import filter_audit, html_text, registry, whitening

PROSE = ["A first paragraph of the article, with enough words to be prose and a comma or two.", "The second one says more about the same thing, and it is as long as the first.", "Short.", "A last paragraph that ends the article with <b>bold</b> words &amp; a sign &lt; another."]
SAID = [*PROSE[:3], "A last paragraph that ends the article with bold words & a sign < another."]
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w} page</a></li>' for w in ("home", "news", "about", "contact")) + "</ul>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title</title>{head}</head><body>{body}</body></html>"


def paragraphs(tag="p"):
    return "".join(f"<{tag}>{p}</{tag}>" for p in PROSE)


LAYOUTS = {
    "article element": (f"<nav>{MENU}</nav><article>{paragraphs()}</article><footer>&copy; someone</footer>", SAID),
    "plain divisions, a menu without a name": (f"<div>{MENU}</div><div><div>{paragraphs()}</div></div><div>{MENU}</div>", SAID),
    "adverts inside": (f'<div id="text"><p>{PROSE[0]}</p><div class="ad-box">Buy this thing now, it is cheap and good and you will like it.</div><p>{PROSE[1]}</p><p>{PROSE[2]}</p><p>{PROSE[3]}</p></div>', SAID),
    "comments and sidebar": (f'<header><h1>Site</h1>{MENU}</header><main>{paragraphs()}</main><div class="sidebar-right"><p>{PROSE[1]}</p></div><section id="comments"><div class="comment"><p>{PROSE[0]} {PROSE[1]} I think so too, and wrote a very long comment about it.</p></div></section>', SAID),
    "notices and forms": (f'<div class="cookie-notice"><p>We use cookies to do many things that you may not like, as all others do.</p></div><div role="main">{paragraphs()}<form><p>Your name, please, and your address.</p><input name="n"></form></div>', SAID),
    "paragraphs not closed": ("<article>" + "".join(f"<p>{p}" for p in PROSE) + "</article>", SAID),
    "header and headings of the article": (f"<article><header><h1>Its name</h1></header>{paragraphs()}</article>", ["Its name", *SAID]),
    "sections of an article": (f"<article><section><h2>One</h2>{paragraphs()}</section><section><h2>Two</h2><p>{PROSE[0]}</p></section></article>", ["One", *SAID, "Two", SAID[0]]),
    "scripts, comments, odd tags": (f"<script>var a='<p>no</p>'</script><!-- <p>no</p> --><article>{paragraphs()}<style>p {{}}</style><noscript><p>no</p></noscript></article>", SAID),
    "links within prose": ('<div><p>' + PROSE[0].replace("article", '<a href="#">article</a>') + f"</p><p>{PROSE[1]}</p></div>", SAID[:2]),
    "lists and tables": (f"<article><p>{PROSE[0]}<ul><li>one thing<li>another thing</ul><table><tr><td>a<td>b</table></article>", [PROSE[0], "one thing", "another thing", "a", "b"]),
    "heading before the text": (f'<div><h1>Heading of it</h1><div class="text">{paragraphs()}</div></div>', ["Heading of it", *SAID]),
    "white space and line breaks": ("<article><p>one\n  two<br>three&nbsp;four</p>\n\n<p> \t </p><p>five &#x41;&#66;&eacute;</p></article>", ["one two three four", "five ABé"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    body, want = LAYOUTS[name]
    assert html_text.main_text(page(body)).split("\n") == want


def test_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text(page(f"<nav>{MENU}</nav>")) == ""
    assert html_text.main_text("no tags & none &amp; more") == "no tags & none & more"
    assert html_text.main_text("a < b > c <d") == "a < b > c <d"
    assert html_text.main_text("<p>open <b>bold <p>next") == "open bold\nnext"
    deep = "<div>" * 50_000 + "inside" + "</div>" * 50_000
    assert html_text.main_text(deep) == "inside"
    long = "<article>" + "<p>words of it</p>" * 200_000 + "</article>"
    assert html_text.main_text(long).count("\n") == 199_999
    assert html_text.main_text("<" * 200_000 + "x").endswith("x")
    assert html_text.main_text('<p title="' * 20_000 + "x") is not None


def test_densities_equal_a_plain_recursion():
    rng = np.random.default_rng(1)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return "".join(rng.choice(["words of it ", '<a href="#">link</a> ', "<b>bold</b> ", "<i>x</i>"], rng.integers(1, 4)))
        return "".join(f"<div>{grow(depth - 1)}</div>" for _ in range(rng.integers(1, 4)))

    def figures(node):
        if node.tag is None:
            return node.chars, node.tags, node.link_chars, node.link_tags
        below = [figures(k) for k in node.kids]
        return sum(b[0] for b in below), max(1, sum(b[1] for b in below) + sum(k.tag is not None for k in node.kids)), sum(b[2] for b in below), sum(b[3] for b in below)

    for _ in range(30):
        top = html_text.parse(page(grow(4)))
        nodes = html_text.measure(top)
        share = top.link_chars / top.chars
        for n in nodes:
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == figures(n)
            assert np.isclose(n.sum, sum(html_text.density(*figures(k), share) for k in n.kids))
        assert sum(html_text.density(10, t, 0, 0, 0.0) for t in (1, 2)) == 15


def test_op11_equals_its_sql_and_keeps_odd_rows(spark, sf, odd, empty):
    assert rows(registry.QUERIES["op11_html_text"](spark, sf)) == by_sql(sf, html_text.OP11_SQL)
    got = registry.QUERIES["op11_html_text"](spark, odd).collect()
    assert sorted((str(r.page_id), r.url, r.n_chars) for r in got) == sorted((str(r.page_id), r.url, len(re.sub(r"\s+", " ", r.html or "").strip())) for r in spark.read.parquet(f"{odd}/pages.parquet").collect())
    assert registry.QUERIES["op11_html_text"](spark, empty).count() == 0


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def by_sql(folder, sql):
    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if __import__('os').path.isdir(path) else ''}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)


def plain_audit(docs, labels):
    """Every order applied to every row, one after the other."""
    least, good, toxic = {}, set(), set()
    for r in docs:
        if r.doc_id is not None:
            t = r.text or ""
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    for r in labels:
        if r.doc_id is not None:
            good |= {r.doc_id} if r.quality == 1 else set()
            toxic |= {r.doc_id} if r.toxic == 1 else set()
    parts = defaultdict(list)
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > least.get(t, r.doc_id)}
        parts[r.lang or ""].append(({k for k, v in fails.items() if v}, r.doc_id in good, r.doc_id in toxic))
    out, whole = [], defaultdict(int)
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone, left = [m for m in left if f in m[0]], [m for m in left if f not in m[0]]
                whole[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in m[0] for m in members) - len(gone), sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)])
    names = ["filter_order", "good_lost", "kept", "part", "redundant", "removed", "shapley", "step", "toxic_lost", "unique_fails"]
    dicts = [dict(zip(["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"], o, strict=True)) for o in out]
    return sorted((tuple((d | {"shapley": whole[d["part"], d["filter_order"][d["step"] - 1]]})[n] for n in names) for d in dicts), key=repr)


def test_op12_equals_its_sql_and_a_plain_loop(spark, sf, odd, empty):
    for folder in (sf, odd):
        got = rows(registry.QUERIES["op12_filter_audit"](spark, folder))
        assert got == plain_audit(spark.read.parquet(f"{folder}/documents.parquet").collect(), spark.read.parquet(f"{folder}/labels.parquet").collect())
        assert got == by_sql(folder, filter_audit.OP12_SQL)
    assert registry.QUERIES["op12_filter_audit"](spark, empty).count() == 0


def test_audit_with_hot_texts_ids_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 10)
    monkeypatch.setattr(filter_audit, "OPEN_PARTS", 7)
    docs = [(i if i % 3 else 1, "a copy" if i % 2 else f"text {i % 50} #", f"l{i % 40}", "x", "y") for i in range(400)] + [(None, "a copy", None, "x", "y")] * 60
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, None), (None, 1, 1), (7, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, bits string, part string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows(filter_audit.audit(d.repartition(3), lab)) == plain_audit(d.collect(), lab.collect())


def test_bitsets_count_as_sets_do():
    rng = np.random.default_rng(2)
    codes, bits = rng.integers(0, 5, 1000), rng.integers(0, 128, 1000)
    got = filter_audit.bitset_counts(codes, bits, 6)
    assert not got[5].any()
    for p in range(5):
        mine = bits[codes == p]
        for i, (s, f) in enumerate(filter_audit.subsets()):
            gone = (mine >> f & 1 > 0) & (mine & s == 0)
            assert got[p, i].tolist() == [int((mine & (s | 1 << f) == 0).sum()), int(gone.sum()), int((mine >> f & 1).sum()), int((mine & 31 == 1 << f).sum()), int((gone & (mine & 32 > 0)).sum()), int((gone & (mine & 64 > 0)).sum())]


def dense(vectors):
    """n, sums, eigenvalues falling, axes, mean of the distinct integer vectors."""
    fit = np.unique(np.floor(64 * np.array(vectors, float)) + 1_000_000, axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    return len(fit), [int(v) for v in fit.sum(axis=0)], values[::-1], axes[:, ::-1], fit.mean(axis=0)


def compare(got, ids, vectors, k):
    n, sums, values, axes, mean = dense(vectors)
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    want = (x - mean) @ axes[:, :k] / np.sqrt(values[:k])
    have = np.zeros((len(ids), k))
    at = {i: j for j, i in enumerate(ids)}
    assert len(got) == len(ids) * k
    for r in got:
        have[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error <= 1e-10
        assert r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(x[at[r.vec_id]], sums, strict=True))
        assert np.isclose(r.explained, values[r.component - 1] / values.sum(), rtol=1e-10)
    sign = np.sign((have * want).sum(axis=0))
    assert np.abs(have - want * sign).max() < 1e-8


def test_op13_equals_dense_algebra(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    sound = [r for r in table if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    compare(registry.QUERIES["op13_whitening"](spark, sf).collect(), [r.vec_id for r in sound], [r.embedding for r in sound], 16)


def test_whitening_of_copies_and_few_dimensions(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 5)) * [9, 5, 3, 2, 1]
    copies = np.vstack([vectors, np.repeat(vectors[:1], 200, axis=0)])
    df = spark.createDataFrame([(i, [float(v) for v in row], "x", "y") for i, row in enumerate(copies)], "vec_id long, embedding array<double>, x string, component string").repartition(3)
    compare(whitening.whiten(df).collect(), list(range(len(copies))), copies, 5)


def test_whitening_of_odd_rows(spark, odd, empty):
    """The eight vectors of length two are used, those of other lengths aren't."""
    got = registry.QUERIES["op13_whitening"](spark, odd).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 2 * 8 and got[0].n == 4
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 0 for r in got) == 4
    assert registry.QUERIES["op13_whitening"](spark, empty).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    far = spark.createDataFrame([(0, [1e9, 1.0]), (1, [-1e9, 2.0]), (2, [1e300, 1.0]), (3, [None, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(far).collect()} == {(0, None), (1, None)}


@pytest.mark.parametrize("d", [3, 16, 40, 90])
def test_block_lanczos(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectra = {"falling": 0.7 ** np.arange(d), "ties": np.repeat([5.0, 2.0, 1.0], d // 3 + 1)[:d], "low rank": np.concatenate([np.arange(min(d, 5), 0, -1.0), np.zeros(max(0, d - 5))]), "flat": 1 + np.linspace(1, 0, d) / 10}
    for values in spectra.values():
        a = (q * values) @ q.T
        k = min(d, 8)
        found, axes, passes = whitening.block_lanczos(lambda b, a=a: a @ b, d, k, 4)
        assert np.allclose(found, np.sort(values)[::-1][:k], atol=1e-12 * values.max())
        assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
        assert np.linalg.norm(a @ axes - axes * found) < 1e-11 * values.max()
        assert passes <= -(-d // 4) + d


def test_block_lanczos_restarts_when_the_start_is_invariant():
    """A start block inside an eigenspace breaks down at once; the largest eigenvalue lies elsewhere."""
    a = np.diag(np.concatenate([[9.0], np.ones(30)]))
    basis = whitening.orthonormal(np.eye(31)[:, 1:4], np.zeros((31, 0)), np.random.default_rng(0), 3)
    new = whitening.orthonormal(a @ basis, basis, np.random.default_rng(0), 3)
    assert new.shape == (31, 3) and np.abs(basis.T @ new).max() < 1e-12 and np.abs(new.T @ new - np.eye(3)).max() < 1e-12
