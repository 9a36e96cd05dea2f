"""Benchmark decontamination by canonical templates, in DataFrame operations alone.

Texts are cut into words; numbers, units after a number and names (capitalised words inside a
sentence) become typed placeholders, the rest is lower-cased. Windows of `SIZE` template words are
hashed and joined with those of the benchmark, so a question with other numbers or names still
meets its original. A hit counts where its slots are consistent: within an occurrence of an item, a
benchmark value stands for one and the same value of the document throughout (with few exceptions).
A document is contaminated if the hits of an occurrence cover at least `COVER` of an item's windows.

Every window also has a plain key, the hash of its lower-case words as they are. It finds windows of
more placeholders than a template may have, and copies in other case, whose names can't be told; such
a hit is the item's own words and needs no consistency. A window counts for the cover by either key.

Occurrences are told apart by their shift, the place in the text less that in the item: hits of one
shift are one, as are hits of a text whose sorted shifts lie no further apart than each of `SHIFTS`
(words were put in or left out), and all hits of a document together (an item in scattered pieces).
Each is judged for itself, so variants of an item beside its copy don't hide it.

The benchmark's windows are counted first. Below a bound they are broadcast, with a bitmap of their
hashes as a first sieve; beyond it every window is shuffled to the join. Hits are pre-aggregated per document, item and shift,
so a passage that many documents share stays one row each.

Results for odd input: null and empty texts have no window and are clean; items of fewer words than
a window are matched as one shorter window, by exactly as many words; every row is judged by its own
text, whatever its doc_id (null, repeated or neither), so equal texts are judged once and alike; an
empty benchmark leaves every document clean. Texts are told apart by 128 bits of their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, table

#: Words of a window, least share of an item's windows, placeholders a template window may have at most.
SIZE, COVER, MOST_SLOTS = 8, 0.5, 4
#: Distances of shifts within one occurrence.
SHIFTS = (0, SIZE, 4 * SIZE)
#: Windows of a benchmark up to which they are broadcast.
BROADCAST_WINDOWS = 1_000_000
#: Contaminated texts up to which they are broadcast, and copies of each for the join beyond that.
BROADCAST_TEXTS, SALTS = 200_000, 32
#: Two hashes that tell texts apart.
TEXT = ("d_text", "d_more")
#: Least share of an item's values that stand for one value each.
CONSISTENT = 0.8

#: Placeholders, from a block of code points that no text uses; typed number, unit and name.
NUMBER, UNIT, NAME = "", "", ""
#: Units that a number may have.
UNITS = "km|m|cm|mm|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|miles|feet|ft|inches|dollars|euros|cents|percent|degrees|meters|metres|kilometers|kilometres|grams|litres|liters"


def with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add `_raw`, the lower-case words of a text (names behind a mark), `_tpl`, as many template words, `_h`, their hashes, and `_w`, those of the plain words."""
    plain = F.coalesce(F.col(text), F.lit(""))
    plain = F.when(plain.contains(NUMBER) | plain.contains(UNIT) | plain.contains(NAME), F.translate(plain, NUMBER + UNIT + NAME, "   ")).otherwise(plain)
    # A capital is looked for first, what stands before it only then.
    marked = F.regexp_replace(plain, r"\p{Lu}(?<=[\p{Ll}\p{N},;] .)\p{L}*", NAME + "$0")
    rows = rows.withColumn("_raw", F.array_remove(F.split(F.lower(marked), rf"[^\p{{L}}\p{{N}}{NAME}]+"), ""))
    number = lambda w: (w >= "0") & (w < ":")

    def template(w, i):
        unit = w.isin(UNITS.split("|")) & (i > 0)
        return F.when(number(w), NUMBER).when(w.startswith(NAME), NAME).when(unit & number(F.get("_raw", i - 1)), UNIT).otherwise(w)

    return rows.withColumn("_tpl", F.transform("_raw", template)).withColumn("_h", F.transform("_raw", lambda w, i: F.xxhash64(template(w, i)))).withColumn("_w", F.transform("_raw", lambda w: F.xxhash64(plain_word(w))))


def plain_word(w):
    """A word without the mark of names."""
    return F.translate(w, NAME, "")


def text_keys():
    """The columns of TEXT from the column `text`."""
    return F.xxhash64("text").alias("d_text"), F.xxhash64(F.lit("second"), F.col("text")).alias("d_more")


def window_key(at: str, n: int, hashes: str = "_h"):
    """Hash of the `n` template words (`_w`: plain words) from position `at` on (counted from 1)."""
    return F.xxhash64(*[F.get(hashes, F.col(at) + (k - 1)) for k in range(n)])


def either_key():
    """The template key and the plain key of a window, as rows to come."""
    return F.array(F.struct(F.col("k_tpl").alias("key"), F.lit(False).alias("exact")), F.struct(F.col("k_raw").alias("key"), F.lit(True).alias("exact")))


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, i_text, windows, w_size, key, exact, w_at, w_words, w_slots of every window of the benchmark by its plain key (exact), and of those of few placeholders by their template's."""
    rows = with_words(benchmark.select("item_id", "text", F.xxhash64("text").alias("i_text"))).where("size(_raw) > 0").withColumn("w_size", F.least(F.size("_raw"), F.lit(size)))
    rows = rows.withColumn("n_windows", F.size("_raw") - F.col("w_size") + 1)
    rows = rows.withColumn("w_at", F.explode(F.sequence(F.lit(1), F.col("n_windows"))))
    keys = lambda hashes: F.coalesce(*[F.when(F.col("w_size") == n, window_key("w_at", n, hashes)) for n in range(1, size + 1)])
    rows = rows.select("item_id", "i_text", "n_windows", "w_size", "w_at", F.expr("slice(_raw, w_at, w_size)").alias("w_raw"), F.expr("slice(_tpl, w_at, w_size)").alias("w_tpl"), keys("_h").alias("k_tpl"), keys("_w").alias("k_raw"))
    slots = F.size(F.filter("w_tpl", lambda w: w.isin(NUMBER, UNIT, NAME)))
    rows = rows.withColumn("w_slots", slots).withColumn("k", F.explode(either_key()))
    return rows.where(F.col("k.exact") | (F.col("w_slots") <= MOST_SLOTS)).select("*", "k.key", "k.exact").drop("k", "k_tpl", "k_raw")


def _bitmap(keys: list[int]) -> tuple[list[int], int]:
    """Words of 64 bits in which the lowest bits of each key are set, a power of two of them, and that power less one."""
    n = 1
    while n * 4 < len(keys):
        n *= 2
    words = [0] * n
    for k in keys:
        words[(k >> 6) & (n - 1)] |= 1 << (k & 63)
    # One string is one literal; the plan folds it into one array.
    return [w - (1 << 64) if w >> 63 else w for w in words], n - 1


def candidate_windows(tokens: DataFrame, n: int, keys: list[int] | None) -> DataFrame:
    """d_text, d_more, p, key, exact, d_raw of the windows of `n` words of which a hash may be among `keys` (None: of all).

    The positions are generated, hashed and tried on the keys' bitmap inside one stage of generated
    code; only likely hits leave it with their words.
    """
    places = F.when(F.size("_h") >= n, F.sequence(F.lit(1), F.size("_h") - (n - 1)))
    wins = tokens.select(*TEXT, "_raw", "_h", "_w", F.explode(places).alias("p")).withColumn("k_tpl", window_key("p", n)).withColumn("k_raw", window_key("p", n, "_w"))
    if keys is not None:
        words, mask = _bitmap(keys)
        table_ = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

        def known(key: str):
            word = F.get(table_, F.call_function("shiftright", F.col(key), F.lit(6)).bitwiseAND(F.lit(mask)).cast("int"))
            return F.call_function("shiftrightunsigned", word, F.col(key).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

        wins = wins.where(known("k_tpl") | known("k_raw"))
    wins = wins.select(*TEXT, "p", F.slice("_raw", F.col("p"), F.lit(n)).alias("d_raw"), F.explode(either_key()).alias("k"))
    return wins.select(*TEXT, "p", "k.key", F.col("k.exact").alias("d_exact"), "d_raw", F.lit(n).alias("n"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """d_text, d_more, item_id, cover, exact (the cover by plain windows), consistent of every occurrence of an item in a text that share a window."""
    wanted = checkpoint(item_windows(benchmark, size))
    per_size = {r[0]: r[1] for r in wanted.groupBy("w_size").count().orderBy("w_size").limit(size).collect()}
    few = sum(per_size.values()) <= BROADCAST_WINDOWS
    tokens = with_words(docs.select("text", *text_keys())).select(*TEXT, "_raw", "_h", "_w")
    wins = None
    for n in per_size or {size: 0}:
        keys = [r[0] for r in wanted.where(F.col("w_size") == n).select("key").distinct().collect()] if few else None
        part = candidate_windows(tokens, n, keys)
        wins = part if wins is None else wins.unionByName(part)
    right = wanted.select("item_id", "i_text", "n_windows", "w_size", "w_at", "w_raw", "w_tpl", "exact", F.col("key").alias("w_key"))
    met = wins.join(F.broadcast(right) if few else right, (F.col("key") == F.col("w_key")) & (F.col("n") == F.col("w_size")) & (F.col("d_exact") == F.col("exact")))
    # Words that aren't placeholders must be equal, which also rules out equal hashes of other templates.
    placed = F.exists(F.arrays_zip("d_raw", "w_raw", "w_tpl"), lambda z: (z["d_raw"] != z["w_raw"]) & ~z["w_tpl"].isin(NUMBER, UNIT, NAME))
    other = F.exists(F.arrays_zip("d_raw", "w_raw"), lambda z: plain_word(z["d_raw"]) != plain_word(z["w_raw"]))
    met = met.where(F.when(F.col("exact"), ~other).otherwise(~placed))
    pairs = F.filter(F.arrays_zip(F.col("w_tpl").alias("t"), F.col("w_raw").alias("b"), F.col("d_raw").alias("d")), lambda z: z["t"].isin(NUMBER, NAME))
    # Of a window met by both keys the template tells the values; one met by the plain key alone has the item's own.
    met = met.withColumn("values", F.transform(pairs, lambda z: F.struct(z["b"].alias("b"), z["d"].alias("d"))))
    alone = [*TEXT, "item_id", "i_text"]
    per = met.groupBy(*alone, (F.col("p") - F.col("w_at")).alias("shift")).agg(F.first("n_windows").alias("n_windows"), F.collect_set("w_at").alias("at"), F.collect_set(F.when(F.col("exact"), F.col("w_at"))).alias("same"), F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("exact"), F.col("values"))))).alias("pairs"))
    w = Window.partitionBy(*alone).orderBy("shift")
    per = per.withColumn("gap", F.col("shift") - F.lag("shift").over(w))
    runs = [F.struct(F.lit(k).alias("level"), F.sum((F.coalesce("gap", F.lit(0)) > k).cast("long")).over(w).alias("run")) for k in SHIFTS]
    pooled = F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("run"))
    per = per.withColumn("runs", F.array(*runs, pooled)).withColumn("run", F.explode("runs")).groupBy(*TEXT, "item_id", "i_text", "run")
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    per = per.agg((F.size(distinct("at")) / F.first("n_windows")).alias("cover"), (F.size(distinct("same")) / F.first("n_windows")).alias("exact"), distinct("pairs").alias("pairs"))
    bench_values = F.size(F.array_distinct(F.transform("pairs", lambda z: z["b"])))
    # Values that stand for several: each further value beyond the first is one too many.
    return per.select(*TEXT, "item_id", "cover", "exact", (F.size("pairs") <= bench_values + (1 - CONSISTENT) * bench_values).alias("consistent"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, cover: float = COVER) -> DataFrame:
    """d_text, d_more, items, cover, first_item: the texts that hold benchmark items, how many, and the largest cover."""
    found = hits(docs, benchmark, size).withColumn("cover", F.when(F.col("consistent"), F.col("cover")).otherwise(F.col("exact"))).where(F.col("cover") >= cover)
    found = found.groupBy(*TEXT, "item_id").agg(F.max("cover").alias("cover"))
    return found.groupBy(*TEXT).agg(F.count("*").alias("items"), F.max("cover").alias("cover"), F.min("item_id").alias("first_item"))


def met(rows: DataFrame, keys: list[str], bad: DataFrame, how: str) -> DataFrame:
    """`rows` joined with the written table `bad` (TEXT, ...) by their two hashes in `keys`; how: inner, left or left_anti.

    Few texts are broadcast, so nothing is shuffled; more are spread over `SALTS` copies, so rows of
    one text, however many, meet them in as many tasks.
    """
    bad = bad.select(*[F.col(t).alias(f"{t} of the benchmark") for t in TEXT], *[c for c in bad.columns if c not in TEXT])
    same = (F.col(f"`{keys[0]}`") == F.col(f"`{TEXT[0]} of the benchmark`")) & (F.col(f"`{keys[1]}`") == F.col(f"`{TEXT[1]} of the benchmark`"))
    if bad.count() <= BROADCAST_TEXTS:
        return rows.join(F.broadcast(bad), same, how).drop(*[f"{t} of the benchmark" for t in TEXT])
    bad = bad.withColumn("salt of the text", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Each salt has all the texts, so a row's may differ when a task is run again.
    rows = rows.withColumn("salt of the row", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return rows.join(bad, same & (F.col("`salt of the row`") == F.col("`salt of the text`")), how).drop("salt of the text", "salt of the row", *[f"{t} of the benchmark" for t in TEXT])


def without(rows: DataFrame, keys: list[str], bad: DataFrame) -> DataFrame:
    """The rows whose text isn't among `bad`."""
    return met(rows, keys, bad, "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, cover: float = COVER) -> DataFrame:
    """doc_id, items, cover, first_item of the rows of `docs` (doc_id, text) that hold benchmark items."""
    bad = checkpoint(contaminated_texts(docs, benchmark, size, cover))
    return met(docs.select("doc_id", *text_keys()), list(TEXT), bad, "inner").drop(*TEXT)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, contaminated, items, cover, first_item."""
    docs = table(spark, sf_dir, "documents")
    bad = checkpoint(contaminated_texts(docs, table(spark, sf_dir, "benchmark")))
    joined = met(docs.select("doc_id", *text_keys()), list(TEXT), bad, "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.round(F.coalesce("cover", F.lit(0.0)), 6).alias("cover"), "first_item")
