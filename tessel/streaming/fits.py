"""Models re-estimated over streams: decayed sums, replaceable chunks, drift."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.shared import scope


def constant(rate: float) -> Callable[[int], float]:
    if not 0 < rate <= 1:
        raise ValueError("a rate lies in (0, 1]")
    return lambda t: rate


def harmonic(alpha: float, offset: float = 1.0) -> Callable[[int], float]:
    """(offset + t - 1) ** -alpha with alpha in (0.5, 1]."""
    if not 0.5 < alpha <= 1:
        raise ValueError("alpha lies in (0.5, 1]")
    return lambda t: min(1.0, (offset + t - 1) ** -alpha)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class _Kept:
    """The last state of a fit as one small text in a folder; a new state is whole before the old one goes."""

    def __init__(self, path: str | None):
        self.path = path

    def _versions(self, spark: SparkSession) -> list[str]:
        p, fs = _hadoop(spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if fs.exists(_hadoop(spark, f"{self.path}/{n}/_SUCCESS")[0])]
        return sorted((n for n in done if n.isdigit()), key=int)

    def load(self, spark: SparkSession) -> dict | None:
        have = self._versions(spark) if self.path is not None else []
        return json.loads(spark.read.text(f"{self.path}/{have[-1]}").head()[0]) if have else None

    def save(self, spark: SparkSession, state: dict) -> None:
        if self.path is None:
            return
        have = self._versions(spark)
        number = int(have[-1]) + 1 if have else 0
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{number:012d}")
        for old in have:
            p, fs = _hadoop(spark, f"{self.path}/{old}")
            fs.delete(p, True)


def _solved(family, spark: SparkSession, sums: dict[str, float]) -> dict[str, float]:
    names = list(sums)
    table = spark.createDataFrame([tuple(sums[k] for k in names)], ", ".join(f"{k} double" for k in names))
    solved = family.solve({k: F.col(k) for k in names})
    return table.select(*[solved[k].alias(k) for k in family.params]).head().asDict()


class StreamingFit:
    """S <- (1 - rate) S + rate s over batches, the first taken whole; a family's sums are the state.

    `update` is a `foreachBatch` function: one aggregation per batch. A batch number that was seen
    is passed over. With a `path`, which belongs beside the query's checkpoint, every state is written
    there before its batch counts as done and takes the place of the one before, and a new driver goes
    on from it; so a replay after a failure changes nothing.
    """

    def __init__(self, family, column: str, schedule: Callable[[int], float], spark: SparkSession | None = None, path: str | None = None):
        self.family, self.column, self.schedule, self.kept = family, column, schedule, _Kept(path)
        self.state: dict[str, float] | None = None
        self.steps, self.last = 0, -1
        found = self.kept.load(spark) if spark is not None else None
        if found is not None:
            self.last, self.steps, self.state = found["batch"], found["steps"], found["state"]

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        x = F.col(self.column).cast("double")
        sums = self.family.stats(x, F.lit(1.0))
        row = batch.where(x.isNotNull()).agg(F.count("*").alias("_rows"), *[c.alias(k) for k, c in sums.items()]).head().asDict()
        self.last = batch_id
        if row.pop("_rows"):
            self.steps += 1
            new = {k: float(v) for k, v in row.items()}
            rate = self.schedule(self.steps)
            self.state = new if self.state is None else {k: (1 - rate) * self.state[k] + rate * new[k] for k in new}
        self.kept.save(batch.sparkSession, {"batch": batch_id, "steps": self.steps, "state": self.state})

    def params(self, spark) -> dict[str, float]:
        return _solved(self.family, spark, self.state)


class IncrementalFit:
    """Sums kept per chunk: a chunk that comes again replaces its old sums, so late data can be replayed.

    With a `path` the chunks' sums are written there with every update, and a new driver goes on from them.
    Chunks are named by numbers or texts.
    """

    def __init__(self, family, column: str, spark: SparkSession | None = None, path: str | None = None):
        self.family, self.column, self.kept = family, column, _Kept(path)
        found = self.kept.load(spark) if spark is not None else None
        self.chunks = {k: v for k, v in found["chunks"]} if found else {}

    def update(self, chunk: DataFrame, chunk_id) -> None:
        sums = self.family.stats(F.col(self.column).cast("double"), F.lit(1.0))
        self.chunks[chunk_id] = {k: float(v or 0.0) for k, v in chunk.agg(*[c.alias(k) for k, c in sums.items()]).head().asDict().items()}
        self.kept.save(chunk.sparkSession, {"chunks": list(self.chunks.items())})

    def params(self, spark) -> dict[str, float]:
        names = list(next(iter(self.chunks.values())))
        return _solved(self.family, spark, {k: sum(c[k] for c in self.chunks.values()) for k in names})


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window and key under a watermark; the same plan serves batch and stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


class DriftMonitor:
    """`foreachBatch` function that compares each batch with a reference by the stability index and keeps what exceeds a bound.

    The reference's deciles and its share of each are worked out once; a batch is one aggregation.
    Proportions get 1e-6 added; a batch without values is passed over.
    """

    def __init__(self, reference: DataFrame, column: str, bound: float = 0.2, bins: int = 10):
        from tessel.operators.running import quantiles

        self.column, self.bound, self.alarms = column, bound, []
        with scope():
            cuts = quantiles(self._values(reference), "x", [i / bins for i in range(1, bins)]).head().q
        self.cuts = sorted({c for c in cuts or [] if c is not None})
        self.shares = self._shares(reference)

    def _values(self, df: DataFrame) -> DataFrame:
        x = F.col(self.column).cast("double")
        return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(x.alias("x"))

    def _shares(self, df: DataFrame) -> list[float] | None:
        cell = sum(((F.col("x") >= float(c)).cast("int") for c in self.cuts), F.lit(0))
        counts = {r.bin: r["count"] for r in self._values(df).groupBy(cell.alias("bin")).count().collect()}
        total = sum(counts.values())
        return [counts.get(i, 0) / total for i in range(len(self.cuts) + 1)] if total else None

    def update(self, batch: DataFrame, batch_id: int) -> None:
        now = self._shares(batch)
        if now is None or self.shares is None:
            return
        # A cell that neither has says nothing.
        pairs = [(r + 1e-6, c + 1e-6) for r, c in zip(self.shares, now, strict=True) if r or c]
        value = sum((c - r) * math.log(c / r) for r, c in pairs)
        if value > self.bound:
            self.alarms.append((batch_id, value))
