"""Hashed n-grams, serial correlation and searches."""

import numpy as np

from tessel.operators import corpus


def test_hashed_ngrams_and_search(spark):
    docs = spark.createDataFrame([(1, "Abab"), (2, None), (3, ""), (4, "the licensed fool"), (5, "é\U0001f600x")], "doc_id long, text string")
    rows = corpus.hashed_ngrams(docs, 3, 1 << 30).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.weight)
    assert {k: len(v) for k, v in by.items()} == {1: 4, 2: 1, 3: 1, 4: 17, 5: 3}
    assert all(np.isclose(sum(w * w for w in v), 1) for v in by.values())
    found = corpus.lexical_search(docs, ["licenses", "fool", "the", "zzz"], 5).collect()
    assert [(r.doc_id, r.score) for r in found] == [(4, 0.5)]


def test_newey_west_has_as_many_lags_as_the_rule(spark):
    from pyspark.sql import functions as F

    from tessel.operators import regression

    n, lags = 400_000, 25
    got = regression.newey_west(spark.range(n).select("id", F.sin(F.col("id") / 40.0).alias("x")), ["id"], "x").head()
    e = np.sin(np.arange(n) / 40.0)
    e -= e.mean()
    want = e @ e + sum(2 * (1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))
    assert got.n == n and np.isclose(got.se, np.sqrt(want / n / (n - 1)), rtol=1e-9)


def test_more_queries_than_can_be_sent_have_the_same_neighbours(spark, sf, monkeypatch):
    from tessel.operators import spatial

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")

    def neighbours():
        found = spatial.nearest_of_queries(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), 5).collect()
        return sorted((r["query"], r["rank"], r["key"], round(r["distance"], 9)) for r in found)

    want = neighbours()
    monkeypatch.setattr(spatial, "SENT_QUERIES", 10)
    monkeypatch.setattr(spatial, "PART_ROWS", 150)
    assert want and neighbours() == want
    # Beyond the bound that was an error.
    monkeypatch.undo()
    many = spark.range(10_001).selectExpr("id", "array(double(id), 0.0D) AS v")
    few = many.where("id < 3 and id > 0")
    got = spatial.nearest_of_queries(few, "id", "v", many, 1)
    assert got.count() == 10_001
