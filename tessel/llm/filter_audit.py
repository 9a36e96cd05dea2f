"""Filter interaction audit: what each of five text filters removes after any of the others.

Every row's failures become bits. Each task packs the rows of its partition, sorted by part, into
NumPy bitsets: one per filter and label, parts on word boundaries. For each set of filters applied
before (a prefix, whatever its order) AND-NOT and popcount give what the next filter would still
remove, and Spark sums the counts of all tasks. Orders differ by their prefix sets only, so the 600
rows of a part come from 80 counts.

Filters, on whole texts (null: empty; words: maximal runs of other than space and 0x09 to 0x0D, case
kept): A under 200 words; B distinct words under half of the words; C A-Z in more than three of a
hundred code points; D one of # $ % & * |; E identical to the text of any smaller doc_id.

E needs the smallest doc_id of each text: an aggregation by two 64-bit hashes and the length of the
text, then a join. Texts, and doc_ids for the labels, that more than one in `HOT_SHARE` rows share
are joined by broadcast (at most `HOT_SHARE` of them, whatever the table), all others by shuffle, so
no task meets a hot key.

Odd input: null texts are empty ones and equal to them; rows without doc_id are never after another
and have no labels, and their texts make no other row fail E; rows that repeat a doc_id are rows of
their own, and equal texts under one doc_id don't fail E for each other; a doc_id labelled more than
once has a label if any of its rows has; null lang is the empty string; a table without rows gives
no rows; extra columns don't matter.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, table

FILTERS = "ABCDE"
#: Keys that more than one in so many rows have are joined by broadcast; there are at most so many of them.
HOT_SHARE = 1000
#: Parts of which a task keeps counts at a time.
OPEN_PARTS = 4096


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, t1, t2, size (text hashes and length), bits (filters A to D, lowest first) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"))
    word_list = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, different = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < 200, F.lit(100).cast("long") * different < F.lit(50).cast("long") * n, F.lit(100).cast("long") * capitals > F.lit(3).cast("long") * F.length("t"), F.col("t").rlike(r"[#$%&*|]")]
    bits = sum((test.cast("int") * (1 << k) for k, test in enumerate(tests)), F.lit(0))
    hashes = (F.xxhash64("t").alias("t1"), F.xxhash64(F.lit("second"), F.col("t")).alias("t2"), F.octet_length("t").cast("long").alias("size"))
    return rows.withColumn("w", word_list).select("doc_id", "part", *hashes, bits.alias("bits"))


def join_counted(rows: DataFrame, keys: list[str], right: DataFrame, total: int) -> DataFrame:
    """`rows` left-joined with `right`, one row a key with the column `_rows`: how many of `rows` have it.

    Keys of more than one in HOT_SHARE of the `total` rows are at most HOT_SHARE; these are broadcast.
    """
    extra = [c for c in right.columns if c not in (*keys, "_rows")]
    hot = right.where(F.col("_rows") * HOT_SHARE > total)
    marked = rows.join(F.broadcast(hot.select(*keys, *extra, F.lit(True).alias("_hot"))), keys, "left")
    met = marked.where("_hot").drop("_hot")
    cold = marked.where("_hot IS NULL").drop("_hot", *extra).join(right.where(F.col("_rows") * HOT_SHARE <= total).drop("_rows"), keys, "left")
    return met.unionByName(cold)


def with_repeats(rows: DataFrame, total: int) -> DataFrame:
    """part, doc_id, bits with filter E's bit."""
    text = ["t1", "t2", "size"]
    first = rows.groupBy(*text).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_rows")).where("_rows > 1")
    met = join_counted(rows, text, first, total)
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return met.select("part", "doc_id", (F.col("bits") + later.cast("int") * 16).alias("bits"))


def with_labels(rows: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """part, bits with the labels' bits: 32 for quality 1, 64 for toxic 1."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("g"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("x")).where("g + x > 0")
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_rows")).where(F.col("_rows") * HOT_SHARE > total)
    marks = marks.join(F.broadcast(repeated), "doc_id", "left").withColumn("_rows", F.coalesce("_rows", F.lit(1)))
    unnamed = rows.where("doc_id IS NULL").select("part", "bits")
    met = join_counted(rows.where("doc_id IS NOT NULL"), ["doc_id"], marks, total)
    return met.select("part", (F.col("bits") + F.coalesce("g", F.lit(0)) * 32 + F.coalesce("x", F.lit(0)) * 64).alias("bits")).unionByName(unnamed)


def subsets() -> list[tuple[int, int]]:
    """(prefix set, filter) of every step: sets as bits, a filter by its place."""
    return [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]


def bitset_counts(codes: np.ndarray, bits: np.ndarray, parts: int) -> np.ndarray:
    """For each part an array (prefix set and filter, figure); figures: kept, removed, fails, alone, good lost, toxic lost.

    Each part's rows lie on word boundaries of shared bitsets, so one AND-NOT serves all parts.
    """
    order = np.argsort(codes, kind="stable")
    codes, bits = codes[order], bits[order]
    rows = np.bincount(codes, minlength=parts)
    n_words = np.maximum(1, -(-rows // 64))
    start = np.concatenate([[0], np.cumsum(n_words)])
    place = start[codes] * 64 + np.arange(len(codes)) - np.concatenate([[0], np.cumsum(rows)])[codes]

    def packed(flags: np.ndarray) -> np.ndarray:
        spread = np.zeros(start[-1] * 64, bool)
        spread[place[flags]] = True
        return np.packbits(spread, bitorder="little").view(np.uint64)

    def popcount(words: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(words).astype(np.int64), start[:-1])

    here = packed(np.ones(len(codes), bool))
    fails = [packed((bits >> k & 1).astype(bool)) for k in range(len(FILTERS))]
    good, toxic = (packed((bits >> k & 1).astype(bool)) for k in (5, 6))
    gone = [np.zeros_like(here)]
    for s in range(1, 1 << len(FILTERS)):
        low = (s & -s).bit_length() - 1
        gone.append(gone[s & (s - 1)] | fails[low])
    alone = [popcount(fails[f] & ~gone[(1 << len(FILTERS)) - 1 - (1 << f)]) for f in range(len(FILTERS))]
    all_fails = [popcount(f) for f in fails]
    out = np.empty((parts, len(subsets()), 6), np.int64)
    for i, (s, f) in enumerate(subsets()):
        removed = fails[f] & ~gone[s]
        out[:, i] = np.stack([popcount(here & ~gone[s | 1 << f]), popcount(removed), all_fails[f], alone[f], popcount(removed & good), popcount(removed & toxic)], axis=1)
    return out


def partition_counts(rows: DataFrame) -> DataFrame:
    """part, step (index of `subsets`), kept, removed, fails, alone, good, toxic: one set of rows per part and task."""
    names = ["kept", "removed", "fails", "alone", "good", "toxic"]

    def flush(found: dict[str, np.ndarray]):
        sums = np.stack(list(found.values()))
        steps = sums.shape[1]
        columns = [pa.array(np.repeat(np.array(list(found), object), steps), pa.string()), pa.array(np.tile(np.arange(steps, dtype=np.int32), len(found)))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(sums[:, :, j].ravel()) for j in range(6)], ["part", "step", *names])

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            counts = bitset_counts(part.indices.to_numpy(zero_copy_only=False), batch.column("bits").to_numpy(zero_copy_only=False), len(part.dictionary))
            for name, figures in zip(part.dictionary.to_pylist(), counts, strict=True):
                found[name] = found[name] + figures if name in found else figures
            if len(found) > OPEN_PARTS:
                yield flush(found)
                found = {}
        if found:
            yield flush(found)

    return rows.select("part", "bits").mapInArrow(run, "part string, step int, " + ", ".join(f"{n} long" for n in names))


def orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, letter, at (index of `subsets`) of the steps of every order."""
    at = {pair: i for i, pair in enumerate(subsets())}
    rows = []
    for order in permutations(range(len(FILTERS))):
        gone = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[k] for k in order), step, FILTERS[f], at[gone, f]))
            gone |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, at int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    # The texts are read once; what follows reads a few bytes a row.
    rows = checkpoint(failures(docs))
    total = rows.count()
    counts = partition_counts(with_labels(with_repeats(rows, total), labels, total))
    sums = counts.groupBy("part", F.col("step").alias("at")).agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "fails", "alone", "good", "toxic")])
    spread = sums.join(F.broadcast(orders(docs.sparkSession)), "at")
    whole = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return spread.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), F.col("alone").alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), whole.alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the documents table by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY 1),
m AS (SELECT part, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b, (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce((w.doc_id > min(w.doc_id) OVER (PARTITION BY t))::INT, 0) AS e, coalesce(g, 0) AS g, coalesce(x, 0) AS x FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
k AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(g) AS g, sum(x) AS x FROM m GROUP BY 1, 2),
f AS (SELECT chr(65 + i::INT) AS letter, (1 << i)::INT AS bit FROM range(5) r(i)),
o AS (SELECT '' AS filter_order, 0 AS gone, 0 AS step, '' AS letter, 0 AS bit UNION ALL SELECT o.filter_order || f.letter, o.gone + o.bit, o.step + 1, f.letter, f.bit FROM o JOIN f ON (o.gone + o.bit) & f.bit = 0),
s AS (SELECT q.filter_order, p.step, p.letter, p.bit, p.gone FROM o p JOIN o q ON q.step = 5 AND starts_with(q.filter_order, p.filter_order) AND p.step > 0),
z AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(g) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS toxic_lost FROM k, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z
"""
