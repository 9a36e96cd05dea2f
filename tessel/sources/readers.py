"""Readers and writers by kind, typed schemas, dataset digests and model files."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str):
    def keep(f):
        READERS[kind] = f
        return f

    return keep


def open(spark: SparkSession, kind: str, *args, **kwargs) -> DataFrame:  # noqa: A001
    """Read a source of a registered kind: parquet, orc, csv, jsonl, json, sql, text, binary, pandas, or one that a user added."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, *args, **kwargs)


def kinds() -> list[str]:
    return sorted(READERS)


def _columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df.select(*columns) if columns else df


@reader("parquet")
def read_parquet(spark, path, columns=None):
    return _columns(spark.read.parquet(path), columns)


@reader("orc")
def read_orc(spark, path, columns=None):
    return _columns(spark.read.orc(path), columns)


@reader("csv")
def read_csv(spark, path, schema=None, columns=None):
    """A header is required; without a schema all columns are strings (types come from `conform`)."""
    r = spark.read.option("header", True).option("enforceSchema", False)
    return _columns((r.schema(schema) if schema else r).csv(path), columns)


@reader("jsonl")
def read_jsonl(spark, path, schema=None, columns=None):
    r = spark.read
    return _columns((r.schema(schema) if schema else r).json(path), columns)


@reader("json")
def read_json(spark, path, schema=None, columns=None):
    r = spark.read.option("multiLine", True)
    return _columns((r.schema(schema) if schema else r).json(path), columns)


@reader("text")
def read_text(spark, path, whole=False):
    return spark.read.text(path, wholetext=whole)


@reader("binary")
def read_binary(spark, path, glob=None):
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


@reader("sql")
def read_sql(spark, url, query, **options):
    """The query runs in the database; partition options pass through."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


@reader("pandas")
def read_pandas(spark, frame, schema=None):
    return spark.createDataFrame(frame, schema)


#: Logical types and their Spark types.
LOGICAL = {"real": T.DoubleType(), "count": T.LongType(), "boolean": T.BooleanType(), "text": T.StringType(), "timestamp": T.TimestampType()}


def conform(df: DataFrame, fields: dict[str, Any]) -> DataFrame:
    """Typed projection. fields: name -> real, count, boolean, text, timestamp, ("categorical", levels), ("vector", n), ("optional", type).

    A value that can't be had is an error of the job, as is a null outside an optional field.
    """
    return df.select(*[_typed(F.col(k), k, t).alias(k) for k, t in fields.items()])


def _typed(c: Column, name: str, kind: Any, optional: bool = False) -> Column:
    if isinstance(kind, tuple) and kind[0] == "optional":
        return _typed(c, name, kind[1], True)
    if isinstance(kind, tuple) and kind[0] == "categorical":
        out, ok = c, c.isin(list(kind[1]))
    elif isinstance(kind, tuple) and kind[0] == "vector":
        out = c.cast("array<double>")
        ok = F.size(out) == kind[1]
    elif kind == "boolean":
        s = F.lower(F.trim(c.cast("string")))
        out = F.when(s.isin("true", "t", "yes", "y", "1"), True).when(s.isin("false", "f", "no", "n", "0"), False)
        ok = out.isNotNull()
    elif kind == "count":
        out = F.expr(f"try_cast(try_cast(`{name}` AS double) AS bigint)")
        ok = out.isNotNull()
    elif kind == "real":
        out = F.expr(f"try_cast(`{name}` AS double)")
        ok = out.isNotNull()
    else:
        out = c.cast(LOGICAL[kind])
        ok = out.isNotNull()
    bad = F.raise_error(F.concat(F.lit(f"{name}: not a {kind}: "), F.coalesce(c.cast("string"), F.lit("null")))).cast(_type_of(kind))
    checked = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(bad)
    return F.when(c.isNull(), F.lit(None)).otherwise(checked) if optional else checked


def _type_of(kind: Any) -> T.DataType:
    if isinstance(kind, tuple):
        return T.ArrayType(T.DoubleType()) if kind[0] == "vector" else T.StringType()
    return LOGICAL[kind]


def _conforms(name: str, kind: Any, optional: bool = False) -> Column:
    """Whether a value can be had as the kind, never null."""
    c = F.col(name)
    if isinstance(kind, tuple) and kind[0] == "optional":
        return _conforms(name, kind[1], True)
    if isinstance(kind, tuple) and kind[0] == "categorical":
        ok = c.isin(list(kind[1]))
    elif isinstance(kind, tuple):
        ok = F.size(c.cast("array<double>")) == kind[1]
    elif kind == "boolean":
        ok = F.lower(F.trim(c.cast("string"))).isin("true", "t", "yes", "y", "1", "false", "f", "no", "n", "0")
    elif kind in ("count", "real"):
        ok = F.expr(f"try_cast(`{name}` AS double)").isNotNull()
    else:
        ok = c.try_cast(LOGICAL[kind]).isNotNull()
    return c.isNull() | F.coalesce(ok, F.lit(False)) if optional else F.coalesce(ok, F.lit(False))


def check_dataset(df: DataFrame, fields: dict[str, Any], logpdf: Column | None = None) -> DataFrame:
    """(issue, rows): per field the rows that don't conform to its kind, and as `support` those that conform
    but have no finite log-density; over all rows, in one aggregation. No error is raised."""
    bad = {name: ~_conforms(name, kind) for name, kind in fields.items()}
    marked = df.select(*[b.alias(f"_b{i}") for i, b in enumerate(bad.values())], (F.lit(True) if logpdf is None else F.coalesce((F.abs(logpdf) < float("inf")) & ~F.isnan(logpdf), F.lit(False))).alias("_ok"))
    conforms = F.lit(True)
    for i in range(len(bad)):
        conforms &= ~F.col(f"_b{i}")
    counts = marked.agg(*[F.count_if(F.col(f"_b{i}")).alias(f"_b{i}") for i in range(len(bad))], F.count_if(conforms & ~F.col("_ok")).alias("_s"))
    pairs = [F.struct(F.lit(name).alias("issue"), F.col(f"_b{i}").alias("rows")) for i, name in enumerate(bad)] + [F.struct(F.lit("support").alias("issue"), F.col("_s").alias("rows"))]
    return counts.select(F.inline(F.array(*pairs)))


def dataset_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): independent of the rows' order; sums of the limbs of each row's SHA-256, so equal rows count."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    limbs = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    sums = df.select(*[x.alias(f"l{i}") for i, x in enumerate(limbs)]).agg(F.count("*").alias("rows"), *[F.pmod(F.sum(f"l{i}"), F.lit(1 << 32)).alias(f"l{i}") for i in range(8)])
    return sums.select("rows", F.lower(F.concat(*[F.lpad(F.hex(f"l{i}"), 8, "0") for i in range(8)])).alias("digest"))


def save_encoded(df: DataFrame, path: str) -> None:
    """Parquet, with the rows' digest beside it."""
    df.write.parquet(f"{path}/data")
    dataset_digest(df.sparkSession.read.parquet(f"{path}/data")).write.parquet(f"{path}/digest")


def load_encoded(spark: SparkSession, path: str) -> DataFrame:
    """What `save_encoded` wrote; an error if the rows differ from their digest."""
    rows, want = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/digest").head()
    got = dataset_digest(rows).head()
    if (got.rows, got.digest) != (want.rows, want.digest):
        raise ValueError(f"{path} was changed after it was written")
    return rows


def save_model(spark: SparkSession, path: str, name: str, model: dict, version: int) -> None:
    """A model of numbers and names as one JSON row; versions are kept."""
    spark.createDataFrame([(name, version, json.dumps(model, sort_keys=True))], "name string, version int, model string").write.mode("append").parquet(path)


def load_model(spark: SparkSession, path: str, name: str, version: int | None = None) -> dict:
    rows = spark.read.parquet(path).where(F.col("name") == name)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    row = rows.orderBy(F.desc("version")).limit(1).head()
    if row is None:
        raise KeyError(f"{name} {version or ''}")
    return json.loads(row.model)
