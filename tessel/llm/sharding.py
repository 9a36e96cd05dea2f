"""Sharding by extendible hashing, in DataFrame operations alone.

A row's hash addresses a directory by its leading bits. A bucket over the byte limit splits on one
more bit, and only such a bucket; what fits stays at its depth. A shard is a bucket that fits and
whose every shorter prefix didn't, so a row's shard is its shortest prefix that fits.

The depths are found from a histogram over prefixes, summed before anything is shuffled, never from
rows gathered in one place: one round tries all depths up to a number of bits taken from the total;
rows whose bucket is still too large go on to a next round of more bits.

Results for odd input: a null text has 0 bytes; rows that are equal in doc_id and text have one
hash, so no split parts them, and neither can a single row be split: such a bucket stays at the
shortest prefix that holds nothing else and, over the limit, is marked oversized; null doc_ids are
hashed with their texts; an empty table has no shard; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, table

#: Bytes that a shard may hold, and bits of a hash.
LIMIT_BYTES, HASH_BITS = 1 << 20, 60
#: Bits beyond the expected depth that the first round tries, and bits of each later round.
SPARE_BITS, ROUND_BITS = 3, 8


def row_hash(doc_id: str = "doc_id", text: str = "text"):
    """The leading 60 bits of an MD5 of doc_id and text."""
    inner = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), inner).cast("binary"))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def prefix(column: str, depth):
    """The leading `depth` bits of a hash; `depth` is a column or a number."""
    return F.call_function("shiftright", F.col(column), (F.lit(HASH_BITS) - depth).cast("int"))


def depths(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, bytes): the shortest prefix of `low` to `high` bits that fits, for each prefix of `high` bits that has one."""
    cells = rows.groupBy(prefix("h", high).alias("cell")).agg(F.sum("n").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
    buckets = levels.groupBy("depth", "p").agg(F.sum("n").alias("bytes"), (F.min("h0") == F.max("h1")).alias("one"))
    fits = buckets.where((F.col("bytes") <= limit) | F.col("one")).select("depth", "p", "bytes")
    return levels.join(fits, ["depth", "p"]).groupBy("cell").agg(F.min(F.struct("depth", "bytes")).alias("s")).select("cell", F.col("s.depth").alias("depth"), F.col("s.bytes").alias("bytes"))


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, shard (the prefix's bits), shard_bytes, oversized of every row of `docs` (doc_id, text)."""
    rows = checkpoint(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"), row_hash().alias("h")))
    total = rows.agg(F.sum("n")).head()[0] or 0
    low, high = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes)))) + SPARE_BITS)
    parts, rest = [], rows
    while True:
        found = depths(rest, low, high, limit_bytes)
        here = rest.withColumn("cell", prefix("h", high)).join(found, "cell", "left")
        if high >= HASH_BITS:
            parts.append(here.select("doc_id", "n", "h", "depth", "bytes"))
            break
        here = checkpoint(here.select("doc_id", "n", "h", "depth", "bytes"))
        parts.append(here.where("depth is not null"))
        rest = here.where("depth is null").select("doc_id", "n", "h")
        if rest.isEmpty():
            break
        low, high = high + 1, min(HASH_BITS, high + ROUND_BITS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bits = F.lpad(F.bin(F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - F.col("depth")).cast("int"))), F.col("depth"), F.lit("0"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), F.when(F.col("depth") == 0, F.lit("")).otherwise(bits).alias("shard"), F.col("bytes").alias("shard_bytes"), (F.col("bytes") > limit_bytes).alias("oversized"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS r, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
lv AS (SELECT r, n, h, d, h >> (60 - d) AS p FROM k, (SELECT unnest(range(61)) AS d)),
b AS (SELECT d, p, sum(n) AS bytes FROM lv GROUP BY d, p HAVING sum(n) <= {LIMIT_BYTES} OR min(h) = max(h)),
s AS (SELECT lv.r, min(lv.d) AS depth, CAST(arg_min(b.bytes, lv.d) AS BIGINT) AS bytes FROM lv JOIN b ON b.d = lv.d AND b.p = lv.p GROUP BY lv.r)
SELECT k.doc_id, k.n AS n_bytes, CAST(s.depth AS INTEGER) AS depth,
  CASE WHEN s.depth = 0 THEN '' ELSE right('000000000000000000000000000000000000000000000000000000000000' || bin(k.h >> (60 - s.depth)), CAST(s.depth AS INTEGER)) END AS shard,
  s.bytes AS shard_bytes, s.bytes > {LIMIT_BYTES} AS oversized
FROM k JOIN s ON s.r = k.r
"""
