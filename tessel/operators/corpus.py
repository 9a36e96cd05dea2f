"""Text corpora: exact duplicates, shingles and signatures, secrets, hashed n-grams, naive Bayes, retrieval, order and packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def token_counts(df: DataFrame, by: str) -> DataFrame:
    """(by, docs, tokens)."""
    return df.groupBy(by).agg(F.count("*").alias("docs"), F.sum(F.size(tokens(F.col("text"))).cast("long")).alias("tokens"))


def shingles(words: Column, k: int) -> Column:
    """Distinct shingles of k words; a shorter text is one shingle, an empty one none.

    `words` should be a stored column: an expression would be evaluated again for every shingle.
    """
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(many))


def shingle_hashes(df: DataFrame, k: int, column: str = "text", name: str = "shingles") -> DataFrame:
    """Add the distinct shingles of k words as 64-bit hashes; a shorter text is one shingle, an empty one none.

    Words are hashed once and shingles are hashes of k word hashes, so no string is built.
    """
    rows = df.withColumn("_w", F.transform(tokens(F.col(column)), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(k)]))
    return rows.withColumn(name, F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64("_w"))).otherwise(F.array_distinct(many))).drop("_w")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, group_id, copies): rows of equal text share the smallest doc_id."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = df.select("doc_id", sha.alias("h"))
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))
    return rows.join(groups, "h").select("doc_id", "group_id", "copies")


def minhash_signature(shingle_array: Column, hashes: int = 64) -> Column:
    """Array of the smallest seeded hash of the shingles, per seed."""
    return F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda s: F.array_min(F.transform(shingle_array, lambda g: F.xxhash64(g, s))))


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures, an estimate of the sets' Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return same / F.size(a)


#: Names and patterns of the secrets that are looked for; an earlier one wins where two overlap.
SECRET_RULES = (
    ("private_key_block", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("openai_key", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("url_credentials", r"\b[a-z][a-z0-9+.\-]*://[^\s:/@]+:([^\s:/@]+)@"),
    ("bearer_token", r"\bBearer\s+[A-Za-z0-9._\-]{16,}\b"),
    ("sensitive_assignment", r"(?i)\b(?:api[_-]?key|secret|token|passwd|password|access[_-]?key|private[_-]?key)\b\s*[:=]\s*['\"]?([^\s'\"]{6,})"),
)
#: Patterns of personal data, for the same functions.
PERSONAL_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("card_number", r"\b[0-9]{13,16}\b"),
)
#: Stands for a secret already found: a sign of its own between blanks, so that no later pattern reaches across.
SECRET_MARK = "\f\ue000"


def secret_counts(df: DataFrame, rules=SECRET_RULES) -> DataFrame:
    """(doc_id, one count per rule); a finding that overlaps an earlier rule's isn't counted."""
    text, counts = F.coalesce(F.col("text"), F.lit("")), []
    for k, (name, pattern) in enumerate(rules):
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, f"{SECRET_MARK}{k}\f")
    return df.select("doc_id", *counts)


def redact(text: Column, rules=SECRET_RULES) -> Column:
    """Each finding becomes [REDACTED:rule]; rules in order, so an earlier one wins an overlap."""
    for k, (_, pattern) in enumerate(rules):
        text = F.regexp_replace(text, pattern, f"{SECRET_MARK}{k}\f")
    for k, (name, _) in enumerate(rules):
        text = F.replace(text, F.lit(f"{SECRET_MARK}{k}\f"), F.lit(f"[REDACTED:{name}]"))
    return text


def ngram_buckets(points: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of each n-gram of code points: a polynomial over 2**31 - 1, spread by an odd factor over 32 bits, its upper part."""
    size = max(1, len(points) - n + 1)
    padded = np.concatenate([points.astype(np.int64), np.zeros(max(0, n - len(points)), np.int64)])
    h = np.zeros(size, np.int64)
    for j in range(n):
        h = (h * 31 + padded[j : j + size]) % 2147483647
    return ((h * 2654435761) % (1 << 32) * buckets) >> 32


def hashed_ngrams(df: DataFrame, n: int = 3, buckets: int = 1024) -> DataFrame:
    """(doc_id, bucket, weight): L2-normalised counts of hashed character n-grams of the padded lower-case text.

    Each row is counted where it is, in Arrow batches; nothing is shuffled.
    """

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, cell, weight, rows = batch.column(0)[lo : lo + 256], [], [], []
                for text in batch.column(1)[lo : lo + 256].to_pylist():
                    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
                    own, c = np.unique(ngram_buckets(points, n, buckets), return_counts=True)
                    cell.append(own)
                    weight.append(c / np.sqrt((c.astype(float) ** 2).sum()))
                    rows.append(len(own))
                who = ids.take(pa.array(np.repeat(np.arange(len(rows)), rows)))
                yield pa.RecordBatch.from_arrays([who, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(weight))], ["doc_id", "bucket", "weight"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text")).mapInArrow(count, f"doc_id {kind}, bucket int, weight double")


def naive_bayes(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(word, label, log_odds pieces): smoothed word log-probabilities per label, from labelled documents."""
    words = docs.join(labels.select(F.col("doc_id").alias("l_id"), F.col(label).alias("label")), F.col("doc_id") == F.col("l_id")).select("label", F.explode(tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("label", "word").agg(F.count("*").alias("c"))
    per = counts.groupBy("label").agg(F.sum("c").alias("t"))
    vocab = counts.agg(F.count_distinct("word").alias("v"))
    return counts.join(F.broadcast(per), "label").crossJoin(F.broadcast(vocab)).select("label", "word", "c", F.ln((F.col("c") + 1) / (F.col("t") + F.col("v"))).alias("log_p"))


def lexical_search(df: DataFrame, query: list[str], top: int) -> DataFrame:
    """(doc_id, score): share of the query's words that a document holds, exactly or by a common prefix of four letters or more; the best `top`."""
    words = F.array_distinct(tokens(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[^\p{L}\p{N}\s]", " ")))
    rows = df.select("doc_id", words.alias("w"))

    def meets(q: str) -> Column:
        near = F.lit(False) if len(q) < 4 else F.exists("w", lambda x: x.startswith(q) | ((F.length(x) >= 4) & F.lit(q).startswith(x)))
        return (F.array_contains("w", q) | near).cast("int")

    hit = sum((meets(q) for q in query), F.lit(0))
    return rows.select("doc_id", (hit / len(query)).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(top)


def global_order(df: DataFrame, key: str, seed: int, epoch: int, world: int) -> DataFrame:
    """(key, position key, rank): a shuffled order that depends on seed, epoch and key alone, dealt over `world` readers."""
    h = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key))
    return df.select(key, h.alias("order_key"), F.pmod(h, F.lit(world)).cast("int").alias("reader"))


def pack_tokens(df: DataFrame, key: str, length: str, block: int, by: str) -> DataFrame:
    """(by, rows, tokens, padding, efficiency) of documents packed one after another into rows of `block` tokens.

    Each document ends with a boundary token and only a stream's last row is padded, so a stream's
    length says how many rows it fills.
    """
    per = df.groupBy(by).agg(F.sum(F.col(length) + 1).alias("tokens"))
    rows = F.ceil(F.col("tokens") / block)
    return per.select(by, rows.cast("long").alias("rows"), "tokens", (rows * block - F.col("tokens")).cast("long").alias("padding"), (F.col("tokens") / (rows * block)).alias("efficiency"))
