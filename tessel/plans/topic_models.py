"""Topic models over the words of the documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessel.operators import topics as tp
from tessel.plans.base import query, rounded, table


def _bags(spark, sf_dir, priors=None):
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    return tp.bags_of_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", words, priors)


def _plsi_sql(steps: int) -> str:
    parts = [r"c AS MATERIALIZED (SELECT doc_id, w, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) AS w FROM documents) WHERE w <> '' AND doc_id IS NOT NULL GROUP BY 1, 2)"]
    parts.append("l AS (SELECT w, sum(n) * (1 + length(w) % 3) AS l0, sum(n) * (1 + length(w) % 2) AS l1 FROM c GROUP BY w), w0 AS (SELECT w, l0 / sum(l0) OVER () AS p0, l1 / sum(l1) OVER () AS p1 FROM l), d0 AS (SELECT DISTINCT doc_id, 0.5::DOUBLE AS q0, 0.5::DOUBLE AS q1 FROM c)")
    for i in range(1, steps + 1):
        parts.append(f"j{i} AS MATERIALIZED (SELECT doc_id, w, n * p0 * q0 / (p0 * q0 + p1 * q1) AS r0, n * p1 * q1 / (p0 * q0 + p1 * q1) AS r1 FROM c JOIN w{i - 1} USING (w) JOIN d{i - 1} USING (doc_id))")
        parts.append(f"s{i} AS (SELECT w, sum(r0) AS r0, sum(r1) AS r1 FROM j{i} GROUP BY w), w{i} AS (SELECT w, r0 / sum(r0) OVER () AS p0, r1 / sum(r1) OVER () AS p1 FROM s{i})")
        parts.append(f"d{i} AS (SELECT doc_id, sum(r0) / (sum(r0) + sum(r1)) AS q0, sum(r1) / (sum(r0) + sum(r1)) AS q1 FROM j{i} GROUP BY doc_id)")
    return "WITH " + ", ".join(parts)


def _plsi(spark, sf_dir):
    lean = [1 + F.length("word") % 3, 1 + F.length("word") % 2]
    docs = _bags(spark, sf_dir)
    return docs, *tp.plsi(docs, "doc", None, "n", 2, lean, 3)


@query("plsi_words", _plsi_sql(3) + " SELECT w AS word, round(p0, 9) AS p0, round(p1, 9) AS p1 FROM w3")
def plsi_words(spark, sf_dir):
    """The words of two topics after three steps."""
    _, words, _, _ = _plsi(spark, sf_dir)
    return rounded(words.select("word", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")), 9)


@query("plsi_score", _plsi_sql(3) + ", t AS (SELECT doc_id, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY 1) SELECT doc_id, round(ln(any_value(share)) + sum(n * ln(p0 * q0 + p1 * q1)), 5) AS ll FROM c JOIN w3 USING (w) JOIN d3 USING (doc_id) JOIN t USING (doc_id) GROUP BY 1")
def plsi_score(spark, sf_dir):
    bags, words, docs, _ = _plsi(spark, sf_dir)
    got = tp.plsi_score(bags, "doc", None, "n", words, docs)
    return rounded(got.withColumnRenamed("doc", "doc_id"), 5)


@query("lda_fit")
def lda_fit(spark, sf_dir):
    """Two steps of EM for four topics: the bounds before each step and the Dirichlet weights after them."""
    docs = _bags(spark, sf_dir)
    model, trace = tp.fit(docs, tp.start_topics(docs, 4), 2)
    rows = [("bound", i, v) for i, v in enumerate(trace)] + [("alpha", i, float(a)) for i, a in enumerate(model.alpha)]
    return rounded(spark.createDataFrame(rows, "name string, i int, v double"), 4)


@query("labelled_lda_score")
def labelled_lda_score(spark, sf_dir):
    """Each document's bound under topics that its language allows: one of its own and one that all share."""
    langs = [r[0] for r in table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()]
    weights = {lang: [0.5, *[0.5 * (i == j) for j in range(len(langs))]] for i, lang in enumerate(langs)}
    prior = tp.label_priors(table(spark, sf_dir, "documents"), "doc_id", "lang", weights)
    docs = _bags(spark, sf_dir, prior)
    start = tp.start_topics(docs, len(langs) + 1)
    model, _ = tp.em_step(docs, tp.Topics(np.full(len(langs) + 1, 0.5), start.table))
    return rounded(tp.score(docs, model).select(F.col("doc").alias("doc_id"), "n", "bound", F.col("gamma")[0].alias("shared")), 4)
