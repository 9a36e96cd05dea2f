"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `docs`. Between stages the rows are written as Parquet and read again.

Null and empty texts: quality scores them like a short good line and keeps them; language ID rejects
them as undetermined. Every row is a document of its own to the Jaccard join, whatever its doc_id:
of each group of linked rows one stays, also of rows without doc_id and of repeated rows; rows of
different texts under one doc_id stay. Texts without words are linked to nothing and stay, but equal
ones under one doc_id count once. Extra columns pass through all filtering stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tessel.llm import decontamination, jaccard_join, language_id, line_quality, piece_encoding
from tessel.llm.common import checkpoint, crc_mod, few, table

#: Least quality score; least probability of a language; words of a shingle and per cent of the near-duplicate join.
LEAST_QUALITY, LEAST_LANGUAGE, SHINGLE, PERCENT = 0.3, 0.4, 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose line field finds them good; learned from labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    learn = F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False))
    field = line_quality.fit(docs.where(learn).select("doc_id", "text"), table(spark, sf_dir, "labels").where(learn))
    name = _free(docs, "quality_score")
    scored = line_quality.score(docs, field, carry=tuple(docs.columns), score_column=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the network knows with some certainty; learned from rows whose crc32(doc_id) mod 4 isn't 2."""
    net = language_id.fit(docs.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True))).select("doc_id", "text", "lang"))
    lang, score = _free(docs, "lang_found"), _free(docs, "lang_score")
    found = language_id.predict(docs, net, carry=tuple(docs.columns), lang_column=lang, score_column=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE)).drop(lang, score)


def _row_key(docs: DataFrame) -> Column:
    """128 bits of all columns of a row, as text; equal rows have equal keys, whenever they are read."""
    plain = [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields]
    flags = [c.isNull() for c in plain]
    return F.concat(F.hex(F.xxhash64(*plain, *flags)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), *flags, *plain)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked rows: that of the smallest doc_id, of rows without one if there is no other."""
    key = _free(docs, "row_key")
    keyed = docs.withColumn(key, _row_key(docs))
    rows = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("t")).groupBy("k", "d", "h", "t").agg(F.count("*").alias("copies"))
    found = jaccard_join.similar_components(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT)
    found = found.select(F.col("doc_id").alias("k"), (F.col("n_shingles") == 0).alias("wordless"), "component_id").distinct()
    alone = F.col("wordless") & F.col("d").isNotNull()
    group = (F.when(~alone, F.col("component_id")), F.when(alone, F.col("d")), F.when(alone, F.col("t")))
    first = F.min(F.struct(F.col("d").isNull().alias("unnamed"), "d", "h", "k", "copies", (F.col("wordless") & F.col("d").isNull()).alias("free")))
    kept = checkpoint(few(rows.join(found, "k").groupBy(*group).agg(first.alias("f")).select(F.col("f.k").alias(key), ((F.col("f.copies") == 1) | F.col("f.free")).alias("whole"))))
    out = keyed.join(kept.where("whole"), key, "left_semi")
    # Rows that repeat in all columns have one key: one of them stays.
    again = kept.where("not whole")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items, each row by its own text."""
    names = [_free(docs, name) for name in decontamination.TEXT]
    keyed = docs.withColumns({n: k for n, k in zip(names, decontamination.text_keys(), strict=True)})
    bad = checkpoint(decontamination.contaminated_texts(docs.select("text"), table(spark, sf_dir, "benchmark")).select(*decontamination.TEXT))
    return decontamination.without(keyed, names, bad).drop(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed as in encode_documents), and digests of the ids and of the decoded text."""
    encoded = piece_encoding.encode_documents(docs.select("doc_id", "text"))
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: The learned stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
