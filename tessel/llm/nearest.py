"""Approximate nearest neighbours along several shifted Hilbert curves.

Each curve projects the vectors to a few random directions, spreads each evenly over a grid, shifts
it, and orders the cells of that grid along a Hilbert curve. Cuts at the quantiles of a bounded sample
range-partition every curve into segments of about equally many vectors. A query meets the segment of
its own key and the next ones on both sides; there it is compared with short codes of the vectors (a
byte for each component), the few best of every window are merged over segments and curves, and the
merged candidates are ranked by the exact distance of the original vectors in double precision.

How many segments a window has on each side is fitted on the sample as well: the fewest with which the
sample's own neighbours are found with recall `TARGET`. Vectors with structure need narrow windows;
the test tables' are nearly isotropic in 64 dimensions, where no order along curves tells neighbours
well apart, and windows are wide. Every vector is indexed, whatever the sample.

Vectors are searched once per distinct value: a group is named by its smallest id, and carries its
few smallest ids, enough to answer with ties. So a value that a third of the rows share is one row on
each curve. A segment with many vectors is dealt to parts that queries meet one by one.

Results for odd input: vectors that are null, zero, or hold null or non-finite components take no
part, neither do those of another length than the commonest; null ids neither; ids that repeat with
the same vector count once; with fewer candidates than asked for all are given; an empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, small_batches, table
from tessel.llm.hilbert import hilbert_key

#: Curves; directions of a projection and bits of each; vectors that cuts, scales and windows are fitted on.
CURVES, AXES, BITS, SAMPLE = 16, 8, 6, 8192
#: Segments of a curve, vectors of the sample to each at least; recall within the sample that windows are fitted to.
SEGMENTS, LEAST_IN_SEGMENT, TARGET = 256, 32, 0.92
#: Vectors that one task holds of a segment; candidates of a query that are compared exactly, in multiples of those asked for.
PART, EXACT = 32_768, 6


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v: vectors that take part, as they are stored."""
    good = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return good.where(F.size("v") == (length[0] if length else 0))


def groups(rows: DataFrame, keep: int, every: int) -> DataFrame:
    """rep, v, ids, asked of each distinct vector: its smallest id, its `keep` smallest ids, whether a query has it."""
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    marked = rows.distinct().withColumn("h", F.xxhash64("v"))
    few = marked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = marked.where(F.pmod("vec_id", F.lit(every)) == 0).select("h", "v").distinct().withColumn("asked", F.lit(True))
    return few.join(asked, ["h", "v"], "left").select(F.col("ids")[0].alias("rep"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


class Curves:
    """Projections, shifts and cuts of all curves, and the code of vectors, fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, segments: int = SEGMENTS, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = sample.shape[1]
        axes = min(AXES, n)
        self.low = sample.min(axis=0)
        self.step = np.maximum((sample.max(axis=0) - self.low) / 255, 1e-300)
        self.plans = []
        for _ in range(curves):
            base = np.linalg.qr(rng.normal(size=(n, n)))[0][:, :axes]
            at = sample @ base
            self.plans.append((base, at.mean(axis=0), np.maximum(at.std(axis=0), 1e-300), rng.random(axes)))
        parts = max(1, min(segments, len(sample) // LEAST_IN_SEGMENT))
        self.cuts = [np.sort(self.key(sample, c))[np.arange(1, parts) * len(sample) // parts] for c in range(curves)]
        self.segments = parts

    def key(self, x: np.ndarray, curve: int) -> np.ndarray:
        base, middle, scale, shift = self.plans[curve]
        # A logistic curve turns each direction into shares of the vectors, nearly.
        place = (1 / (1 + np.exp(np.clip(-1.702 * (x @ base - middle) / scale, -30, 30))) + shift) / 2
        return hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)

    def segment(self, x: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.cuts[curve], self.key(x, curve), side="right")

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.low) / self.step), 0, 255).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return (self.low + code * self.step).astype(np.float32)

    def fit_window(self, sample: np.ndarray, k: int, total: int, target: float = TARGET, queries: int = 256) -> int:
        """The fewest segments on each side with which the sample's nearest are found with recall `target`.

        Of a sample of so many as stand for the nearest `k` among all `total` vectors: these lie closer
        than the sample's own nearest `k`.
        """
        q = sample[:: max(1, len(sample) // queries)][:queries]
        rows = np.arange(0, len(sample), max(1, len(sample) // queries))[:queries]
        d = (q * q).sum(axis=1)[:, None] + (sample * sample).sum(axis=1)[None] - 2 * q @ sample.T
        d[np.arange(len(q)), rows] = np.inf
        k = min(math.ceil(k * len(sample) / total), len(sample) - 1)
        if k < 1:
            return 0
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        gap = np.full(near.shape, self.segments)
        for c in range(len(self.plans)):
            own = self.segment(sample, c)
            gap = np.minimum(gap, np.abs(own[near] - own[rows][:, None]))
        return int(np.quantile(gap, target, method="higher"))


def _array(column) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, curves: int = CURVES, window: int | None = None, segments: int = SEGMENTS, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of every id divisible by `every`, by Euclidean distance.

    window: segments met on each side of a query's own; fitted where it isn't given.
    """
    spark = rows.sparkSession
    small_batches(spark)
    keep = k + 1
    vectors = checkpoint(groups(usable(rows), keep, every))
    total = vectors.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # About twice the sample by hash, then those of smallest hash: what reaches the driver has a bound.
    share = min(1.0, 2 * SAMPLE / total)
    drawn = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = np.array([r.v for r in drawn.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()], np.float64)
    index = Curves(sample, curves, segments)
    side = index.fit_window(sample, keep, total) if window is None else window
    parts = max(1, math.ceil(total / index.segments / part))
    shared = spark.sparkContext.broadcast(index)
    name = lambda c, s, p: (c * index.segments + s) * parts + p

    def place(batches):
        own = shared.value
        for batch in batches:
            rep, x = batch.column(0).to_numpy(), _array(batch.column(1))
            codes = [c.tobytes() for c in own.code(x)]
            for c in range(len(own.plans)):
                yield pa.RecordBatch.from_arrays([pa.array(name(c, own.segment(x, c), rep % parts)), batch.column(0), pa.array(codes, pa.binary())], ["key", "rep", "code"])

    def ask(batches):
        own = shared.value
        for batch in batches:
            x = _array(batch.column(1))
            raw = [v.tobytes() for v in x.astype(np.float32)]
            for c in range(len(own.plans)):
                at = own.segment(x, c)
                for s in range(-side, side + 1):
                    ok = np.flatnonzero((at + s >= 0) & (at + s < own.segments))
                    for p in range(parts):
                        yield pa.RecordBatch.from_arrays([pa.array(name(c, at[ok] + s, p)), batch.column(0).take(pa.array(ok)), pa.array([raw[i] for i in ok], pa.binary())], ["q_key", "q", "qv"])

    def meet(data: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_c, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        if data.num_rows and queries.num_rows:
            own = shared.value
            rep = data.column("rep").to_numpy()
            x = own.decode(np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(len(rep), -1))
            square = (x * x).sum(axis=1)
            asked = queries.column("q").to_numpy()
            y = np.frombuffer(b"".join(queries.column("qv").to_pylist()), np.float32).reshape(len(asked), -1)
            most = min(2 * keep, len(rep))
            step = max(1, (1 << 22) // len(rep))
            for lo in range(0, len(asked), step):
                some = y[lo : lo + step]
                d = square[None] + (some * some).sum(axis=1)[:, None] - 2 * some @ x.T
                near = np.argpartition(d, most - 1, axis=1)[:, :most]
                out_q.append(np.repeat(asked[lo : lo + step], most))
                out_c.append(rep[near].ravel())
                out_d.append(np.take_along_axis(d, near, axis=1).ravel())
        return pa.table({"q": np.concatenate(out_q), "c": np.concatenate(out_c), "d": np.concatenate(out_d)})

    on_curves = vectors.select("rep", "v").mapInArrow(place, "key long, rep long, code binary")
    asking = vectors.where("asked").select("rep", "v").mapInArrow(ask, "q_key long, q long, qv binary")
    met = on_curves.groupBy("key").cogroup(asking.groupBy("q_key")).applyInArrow(meet, "q long, c long, d float")
    best = Window.partitionBy("q").orderBy("d", "c")
    merged = met.groupBy("q", "c").agg(F.min("d").alias("d")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= EXACT * keep).select("q", "c")

    def exact(batches):
        for batch in batches:
            d = np.sqrt(((_array(batch.column(2)) - _array(batch.column(3))) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d), batch.column(4)], ["q", "c", "d", "ids"])

    both = merged.join(vectors.select(F.col("rep").alias("c"), "v", "ids"), "c").join(vectors.where("asked").select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q")
    near = both.select("q", "c", "v", "qv", "ids").mapInArrow(exact, "q long, c long, d double, ids array<long>")
    # Groups become ids: at most k + 1 of each are needed, then at most k + 1 in all.
    members = near.select("q", "d", F.explode("ids").alias("vec_id"))
    answers = members.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("k") <= keep).select("q", "d", "vec_id")
    lists = answers.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    by_vector = vectors.where("asked").select(F.col("rep").alias("q"), F.xxhash64("v").alias("h"), "v").join(lists, "q")
    own = usable(rows).where(F.pmod("vec_id", F.lit(every)) == 0).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h"), "v")
    mine = own.join(by_vector, ["h", "v"]).select("query_id", F.slice(F.filter("near", lambda z: z["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("p", "z")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("z.vec_id").alias("vec_id"), F.col("z.d").alias("score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
