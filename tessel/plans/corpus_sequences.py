"""Corpus operators, vectors, enumeration, streams over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import corpus as cp
from tessel.operators import enumeration as en
from tessel.operators import families as fam
from tessel.operators import spatial as sp
from tessel.plans.base import query, rounded, table
from tessel.sources import readers
from tessel.streaming import fits as st

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')"


@query("token_counts_by_source", f"SELECT source, count(*) AS docs, CAST(sum(len({_TOK})) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def token_counts_by_source(spark, sf_dir):
    return cp.token_counts(table(spark, sf_dir, "documents"), "source")


@query("exact_duplicates", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def exact_duplicates(spark, sf_dir):
    return cp.exact_duplicates(table(spark, sf_dir, "documents"))


@query("shingle_counts", f"WITH w AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS INTEGER) AS shingles FROM w")
def shingle_counts(spark, sf_dir):
    return cp.shingle_hashes(table(spark, sf_dir, "documents"), 5).select("doc_id", F.size("shingles").alias("shingles"))


def _marked_sql(rules: int) -> str:
    """The text with the findings of the first rules marked."""
    text = "coalesce(text, '')"
    for k, (_, p) in enumerate(cp.SECRET_RULES[:rules]):
        text = f"regexp_replace({text}, '{p.replace(chr(39), chr(39) * 2)}', chr(12) || chr(57344) || '{k}' || chr(12), 'g')"
    return text


def _secret_count_sql(k: int) -> str:
    name, p = cp.SECRET_RULES[k]
    return f"CAST(len(regexp_extract_all({_marked_sql(k)}, '{p.replace(chr(39), chr(39) * 2)}')) AS INTEGER) AS {name}"


@query("secret_flags", "SELECT doc_id, " + ", ".join(_secret_count_sql(k) for k in range(len(cp.SECRET_RULES))) + " FROM documents")
def secret_flags(spark, sf_dir):
    return cp.secret_counts(table(spark, sf_dir, "documents"))


def _redact_sql() -> str:
    text = _marked_sql(len(cp.SECRET_RULES))
    for k, (n, _) in enumerate(cp.SECRET_RULES):
        text = f"replace({text}, chr(12) || chr(57344) || '{k}' || chr(12), '[REDACTED:{n}]')"
    return text


@query("redact", f"SELECT doc_id, md5({_redact_sql()}) AS redacted_md5, len({_redact_sql()}) <> len(coalesce(text, '')) AS changed FROM documents")
def redact(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("n"), cp.redact(text).alias("r"))
    return rows.select("doc_id", F.md5(F.col("r").cast("binary")).alias("redacted_md5"), (F.length("r") != F.col("n")).alias("changed"))


@query("hashed_ngrams", """WITH c AS (SELECT doc_id, list_transform(string_split(' ' || lower(coalesce(text, '')) || ' ', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: ((((c[i] % 2147483647) * 31 + c[i + 1]) % 2147483647 * 31 + c[i + 2]) % 2147483647) * 2654435761 % 4294967296 // 4194304)) AS b FROM c),
n AS (SELECT doc_id, b, count(*) AS n FROM g GROUP BY doc_id, b), w AS (SELECT doc_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM n)
SELECT doc_id, count(*) AS buckets, round(sum(w * w), 6) AS norm, round(sum(b * w), 4) AS centre FROM w GROUP BY doc_id""")
def hashed_ngrams(spark, sf_dir):
    w = F.col("weight")
    rows = cp.hashed_ngrams(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum(w * w).alias("norm"), F.round(F.sum(F.col("bucket") * w), 4).alias("centre"))
    return rounded(rows)


@query("naive_bayes_text", f"WITH w AS (SELECT toxic AS label, unnest({_TOK}) AS word FROM documents JOIN labels USING (doc_id)), c AS (SELECT label, word, count(*) AS c FROM w GROUP BY 1, 2), t AS (SELECT label, sum(c) AS t FROM c GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM c) SELECT label, word, c, round(ln((c + 1) / (t + v)), 6) AS log_p FROM c JOIN t USING (label), v")
def naive_bayes_text(spark, sf_dir):
    return rounded(cp.naive_bayes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic"))


def _meets_sql(q: str) -> str:
    near = "" if len(q) < 4 else f" OR len(list_filter(w, lambda x: starts_with(x, '{q}') OR (length(x) >= 4 AND starts_with('{q}', x)))) > 0"
    return f"CASE WHEN list_contains(w, '{q}'){near} THEN 1 ELSE 0 END"


_ASKED = ["idiot", "the", "licensed"]


@query("lexical_retrieval", rf"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}\s]', ' ', 'g')), '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, ({' + '.join(map(_meets_sql, _ASKED))}) / 3.0 AS score FROM t) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 20")
def lexical_retrieval(spark, sf_dir):
    return rounded(cp.lexical_search(table(spark, sf_dir, "documents"), _ASKED, 20))


@query("global_order")
def global_order(spark, sf_dir):
    return cp.global_order(table(spark, sf_dir, "documents"), "doc_id", 7, 1, 8).groupBy("reader").agg(F.count("*").alias("docs"), F.min("order_key").alias("first_key"))


@query("pack_tokens", f"WITH d AS (SELECT source, sum(len({_TOK}) + 1) AS t FROM documents GROUP BY 1) SELECT source, CAST(ceil(t / 2048) AS BIGINT) AS rows, CAST(t AS BIGINT) AS tokens, CAST(ceil(t / 2048) * 2048 - t AS BIGINT) AS padding, round(t / (ceil(t / 2048) * 2048), 6) AS efficiency FROM d")
def pack_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(cp.tokens(F.col("text"))).cast("long").alias("n"))
    return rounded(cp.pack_tokens(rows, "doc_id", "n", 2048, "source"))


@query("conversation_turns", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY 1")
def conversation_turns(spark, sf_dir):
    return rounded(table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.avg(F.length("text")).alias("mean_chars")))


@query("vector_moments", "WITH v AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT CAST(i - 1 AS INTEGER) AS i, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM v GROUP BY i")
def vector_moments(spark, sf_dir):
    n, mean, cov = sp.vector_moments(table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(i, n, round(float(mean[i]), 6) + 0.0, round(float(cov[i, i]), 6)) for i in range(len(mean))], "i int, n long, mean double, variance double")


@query("mvn_score")
def mvn_score(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    _, mean, cov = sp.vector_moments(rows, "embedding")
    return sp.mvn_score(rows, "embedding", mean, cov, 1e-3).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("ll"), 3).alias("mean_ll"))


@query("embedding_knn", "WITH q AS (SELECT vec_id AS query, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query, vec_id AS \"key\", list_distance(qe::DOUBLE[], embedding::DOUBLE[]) AS distance FROM q JOIN embeddings ON vec_id <> query) SELECT query, \"key\", round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, \"key\") AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, \"key\") <= 5")
def embedding_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rounded(sp.nearest_of_queries(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), 5))


@query("kde_grid", "SELECT x, round(avg(exp(-pow((x - l_quantity) / 2, 2) / 2)) / (2 * sqrt(2 * pi())), 6) AS density FROM lineitem, (SELECT unnest([0.0::DOUBLE, 10.0::DOUBLE, 25.0::DOUBLE, 50.0::DOUBLE]) AS x) GROUP BY x")
def kde_grid(spark, sf_dir):
    return rounded(sp.kde_grid(table(spark, sf_dir, "lineitem"), "l_quantity", [0, 10, 25, 50], 2.0))


@query("silverman_bandwidth", "SELECT round(0.9 * least(stddev_samp(o_totalprice), (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / 1.349) * pow(count(*), -0.2), 4) AS bandwidth FROM orders")
def silverman_bandwidth(spark, sf_dir):
    return rounded(sp.silverman_bandwidth(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("variogram", "WITH c AS (SELECT CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS cell, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY 1) SELECT CAST(b.cell - a.cell AS INTEGER) AS lag, CAST(sum(a.n * b.n) AS BIGINT) AS n, round(sum(b.n * a.q + a.n * b.q - 2 * a.s * b.s) / (2 * sum(a.n * b.n)), 4) AS gamma FROM c a JOIN c b ON b.cell - a.cell BETWEEN 1 AND 5 GROUP BY 1")
def variogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).alias("day"), "value")
    return rounded(sp.variogram(rows, "day", "value", 5, 1.0), 4)


@query("categorical_rank_cumulative", "WITH p AS (SELECT o_orderpriority AS level, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM orders GROUP BY 1) SELECT level, round(p, 6) AS p, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(p) OVER w, 6) AS cumulative FROM p WINDOW w AS (ORDER BY p DESC, level)")
def categorical_rank_cumulative(spark, sf_dir):
    return rounded(en.ranked_support(fam.fit_categorical(table(spark, sf_dir, "orders"), "o_orderpriority")))


@query("nucleus", "WITH p AS (SELECT l_linenumber AS level, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1), r AS (SELECT level, p, sum(p) OVER (ORDER BY p DESC, level) AS c FROM p) SELECT level, round(p, 6) AS p FROM r WHERE c - p < 0.6")
def nucleus(spark, sf_dir):
    return rounded(en.nucleus(fam.fit_categorical(table(spark, sf_dir, "lineitem"), "l_linenumber"), 0.6).select("level", "p"))


@query("product_topk", "WITH a AS (SELECT o_orderpriority AS v0, ln(count(*) * 1.0 / sum(count(*)) OVER ()) AS l FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS v1, ln(count(*) * 1.0 / sum(count(*)) OVER ()) AS l FROM orders GROUP BY 1) SELECT v0, v1, round(a.l + b.l, 6) AS logp FROM a, b ORDER BY a.l + b.l DESC, v0, v1 LIMIT 4")
def product_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rounded(en.product_topk([fam.fit_categorical(rows, "o_orderpriority"), fam.fit_categorical(rows, "o_orderstatus")], 4))


@query("conjugate_posteriors", "SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + 1.0, 6) AS a, round(count(*) - sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + 1.0, 6) AS b, round((sum(l_linenumber) + 1.0) / (count(*) + 1), 6) AS gamma_mean, round((25 / 100.0 + sum(l_quantity) / 200) / (1 / 100.0 + count(*) / 200.0), 6) AS normal_mean FROM lineitem GROUP BY 1")
def conjugate_posteriors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("d", (F.col("l_discount") > 0.05).cast("int"))
    got = en.posteriors(rows, ["l_returnflag"], {"beta": ("beta", "d", (1.0, 1.0)), "gamma": ("gamma", "l_linenumber", (1.0, 1.0)), "normal": ("normal", "l_quantity", (25.0, 100.0, 200.0))})
    return rounded(got.select("l_returnflag", F.col("beta_a").alias("a"), F.col("beta_b").alias("b"), "gamma_mean", "normal_mean"))


@query("dirichlet_posterior", "SELECT l_linestatus, l_returnflag AS level, count(*) + 1.0::DOUBLE AS alpha, round((count(*) + 1.0) / sum(count(*) + 1.0) OVER (PARTITION BY l_linestatus), 6) AS mean FROM lineitem GROUP BY 1, 2")
def dirichlet_posterior(spark, sf_dir):
    return rounded(en.dirichlet_posterior(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linestatus"]))


@query("block_model", "SELECT c.c_nationkey % 5 AS b1, s.s_nationkey % 5 AS b2, count(*) AS edges FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON c.c_custkey = o_custkey JOIN supplier s ON s.s_suppkey = l_suppkey GROUP BY 1, 2")
def block_model(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.col("c_nationkey") % 5).alias("block")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), (F.col("s_nationkey") % 5).alias("block")))
    return en.block_model(edges, nodes)


@query("average_effect", "WITH s AS (SELECT l_linenumber AS z, count(*) AS n, avg(l_quantity) FILTER (l_discount > 0.05) AS y1, avg(l_quantity) FILTER (l_discount <= 0.05) AS y0 FROM lineitem GROUP BY 1) SELECT round(sum(n * (y1 - y0)) / sum(n), 6) AS effect, count(*) AS strata FROM s WHERE y1 IS NOT NULL AND y0 IS NOT NULL")
def average_effect(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("t"), "l_quantity", "l_linenumber")
    return rounded(en.average_effect(rows, "t", "l_quantity", "l_linenumber"))


@query("shortest_path_rounds", "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + k) % 25 AS dst, 1.0 + (n_nationkey * k) % 7 AS w FROM nation, (SELECT unnest([1, 2]) AS k)), p AS (SELECT CAST(0 AS INTEGER) AS node, 0.0::DOUBLE AS d, 0 AS r UNION ALL SELECT CAST(e.dst AS INTEGER), p.d + e.w, r + 1 FROM p JOIN e ON e.src = p.node WHERE r < 5) SELECT node, min(d) AS distance FROM p GROUP BY node")
def shortest_path_rounds(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr("n_nationkey AS src", "(n_nationkey * 3 + k) % 25 AS dst", "1D + (n_nationkey * k) % 7 AS w")
    return en.shortest_paths(edges, 0, 5)


@query("dataset_digest")
def dataset_digest(spark, sf_dir):
    return readers.dataset_digest(table(spark, sf_dir, "nation"))


@query("conform_schema", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def conform_schema(spark, sf_dir):
    return readers.conform(table(spark, sf_dir, "nation"), {"n_nationkey": "count", "n_name": "text", "n_regionkey": "real"})


@query("check_dataset", """SELECT 'o_orderkey' AS issue, 0 AS rows UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) FROM orders UNION ALL SELECT 'o_clerk', count(*) FILTER (o_custkey % 3 = 0) FROM orders
UNION ALL SELECT 'support', count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 3 <> 0 AND o_totalprice <= 100000) FROM orders""")
def check_dataset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_clerk", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")).otherwise("none"))
    beyond = fam.FAMILIES["lognormal"].logpdf(F.col("o_totalprice") - 100_000, {"mu": F.lit(10.0), "sigma2": F.lit(1.0)})
    return readers.check_dataset(rows, {"o_orderkey": "count", "o_orderpriority": ("categorical", ["1-URGENT", "2-HIGH"]), "o_clerk": "real"}, beyond)


@query("windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    got = st.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("streaming_fit", """WITH c AS (SELECT l_linenumber AS t, count(*) AS n, sum(l_quantity) AS s1, sum(l_quantity * l_quantity) AS s2 FROM lineitem GROUP BY 1),
w AS (SELECT t, n, s1, s2, pow(t, -0.7) * (SELECT coalesce(product(1 - pow(u, -0.7)), 1) FROM range(2, 8) r(u) WHERE u > t) AS w FROM c)
SELECT round(sum(w * s1) / sum(w * n), 6) AS mu, round(sum(w * s2) / sum(w * n) - pow(sum(w * s1) / sum(w * n), 2), 6) AS sigma2 FROM w""")
def streaming_fit(spark, sf_dir):
    """Decayed estimates over seven chunks of the lines, by line number."""
    fit = st.StreamingFit(fam.FAMILIES["gaussian"], "l_quantity", st.harmonic(0.7))
    rows = table(spark, sf_dir, "lineitem")
    for i in range(1, 8):
        fit.update(rows.where(F.col("l_linenumber") == i), i)
    p = fit.params(spark)
    return spark.createDataFrame([(round(p["mu"], 6), round(p["sigma2"], 6))], "mu double, sigma2 double")


@query("incremental_fit", "SELECT round(avg(l_quantity), 6) AS mu, round(var_pop(l_quantity), 6) AS sigma2 FROM lineitem")
def incremental_fit(spark, sf_dir):
    """Chunks given twice replace themselves: the result is that of one fit over all rows."""
    fit, rows = st.IncrementalFit(fam.FAMILIES["gaussian"], "l_quantity"), table(spark, sf_dir, "lineitem")
    parts = [r[0] for r in rows.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    for i in [*parts, *parts[:2]]:
        fit.update(rows.where(F.col("l_linenumber") == i), i)
    p = fit.params(spark)
    return spark.createDataFrame([(round(p["mu"], 6), round(p["sigma2"], 6))], "mu double, sigma2 double")
