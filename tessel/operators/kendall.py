"""Kendall's concordant and discordant pairs, exactly, at any number of distinct values.

Distinct (x, y) pairs with their counts are dealt out by ranges of (x, y) and again by ranges of
(y, x). A discordant pair of points lies in one x-range (counted there by merging), or in different
ranges of both (counted from the table of how many points each pair of ranges has), or in different
x-ranges but one y-range (counted there, less what shares both). No pairs are formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import scoped, written

#: Distinct points of a range, about.
RANGE = 500_000


def inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w_i w_j over i < j with y_i > y_j, by merging blocks of doubling size."""
    n, out, size = len(y), 0, 1
    if n < 2:
        return 0
    rank = pd.factorize(y, sort=True)[0]
    at, w = np.arange(n), np.asarray(w, np.int64)
    while size < n:
        group, right = at // (2 * size), (at // size) % 2
        by = np.lexsort((right, rank, group))
        g, r, v = group[by], right[by], w[by]
        left = np.cumsum(np.where(r == 0, v, 0))
        first = np.flatnonzero(np.diff(g, prepend=-1))
        last = np.append(first[1:], n) - 1
        # Left elements of the block that are larger: those after the element in the merged order.
        larger = left[last][np.searchsorted(first, np.arange(n), side="right") - 1] - left
        out += sum(int(a) * int(b) for a, b in zip(v[r == 1], larger[r == 1], strict=True)) if int(w.sum()) ** 2 > 1 << 62 else int((v * larger)[r == 1].sum())
        size *= 2
    return out


@scoped
def discordant(points: DataFrame, ranges: int | None = None) -> int:
    """Discordant pairs of points (x, y, w), w the rows each stands for; neither x nor y may be null."""
    points = written(points.select("x", "y", "w"))
    m = ranges or max(1, -(-points.count() // RANGE))
    dealt = written(points.repartitionByRange(m, "x", "y").withColumn("p", F.spark_partition_id()))
    dealt = written(dealt.repartitionByRange(m, "y", "x").withColumn("b", F.spark_partition_id()))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        return pd.DataFrame({"n": [str(inversions(pdf["y"].to_numpy(), pdf["w"].to_numpy()))]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        total = inversions(pdf["y"].to_numpy(), pdf["w"].to_numpy())
        total -= sum(inversions(g["y"].to_numpy(), g["w"].to_numpy()) for _, g in pdf.groupby("p", sort=False))
        return pd.DataFrame({"n": [str(total)]})

    whole = F.coalesce(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(0)).alias("n")
    one = dealt.groupBy("p").applyInPandas(inside, "n string").agg(whole)
    two = dealt.groupBy("b").applyInPandas(across, "n string").agg(whole)
    cells = dealt.groupBy("p", "b").agg(F.sum("w").cast("decimal(38,0)").alias("c"))
    grid = cells.select("b").distinct().select("b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("p")).join(cells, ["p", "b"], "left").select("p", "b", F.coalesce("c", F.lit(0).cast("decimal(38,0)")).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("before").over(Window.partitionBy("p").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    three = grid.withColumn("before", before).withColumn("above", above).agg(F.coalesce(F.sum(F.col("c").cast("decimal(19,0)") * F.col("above").cast("decimal(19,0)")), F.lit(0)).alias("n"))
    return sum(int(part.head().n) for part in (one, two, three))


@scoped
def counts(df: DataFrame, x: str, y: str, ranges: int | None = None) -> DataFrame:
    """One row: concordant, discordant, ties_x, ties_y (pairs equal in it), and tau-b; rows with a null or NaN are left out."""
    kinds = dict(df.dtypes)
    rows = df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    for side, c in (("x", x), ("y", y)):
        rows = rows.where(~F.isnan(side)) if kinds[c] in ("double", "float") else rows
    points = written(rows.groupBy("x", "y").agg(F.count("*").alias("w")))
    if ranges is None and points.count() <= RANGE:
        # One range holds them all: one task counts everything.
        found = points.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_all, "total string, tx string, ty string, same string, d string").head()
        total, tx, ty, both, d = (int(v) for v in found) if found else (0,) * 5
        return _figures(df, total, tx, ty, both, d)
    pairs = lambda by: points.groupBy(*by).agg(F.sum("w").cast("decimal(19,0)").alias("s")).agg(F.coalesce(F.sum(F.col("s") * (F.col("s") - 1) / 2), F.lit(0)).alias("n")).head().n
    total, tx, ty, both = (int(pairs(by)) for by in ([F.lit(1)], ["x"], ["y"], ["x", "y"]))
    return _figures(df, total, tx, ty, both, discordant(points, ranges))


def _all(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs in all, tied in x, in y and in both, and discordant ones, of a whole table of points."""
    pdf = pdf.sort_values(["x", "y"])
    pairs = lambda sums: str(sum(int(s) * (int(s) - 1) // 2 for s in sums))
    w = pdf["w"]
    return pd.DataFrame({"total": [pairs([w.sum()])], "tx": [pairs(w.groupby(pdf["x"]).sum())], "ty": [pairs(w.groupby(pdf["y"]).sum())], "same": [pairs(w)], "d": [str(inversions(pdf["y"].to_numpy(), w.to_numpy()))]})


def _figures(df: DataFrame, total: int, tx: int, ty: int, both: int, d: int) -> DataFrame:
    c = total - tx - ty + both - d
    # Pairs of equal points count for neither side's ties.
    tx, ty = tx - both, ty - both
    base = c + d
    tau = (c - d) / (float(base + tx) * float(base + ty)) ** 0.5 if base + tx and base + ty else None
    return df.sparkSession.createDataFrame([(c, d, tx, ty, tau)], "concordant long, discordant long, ties_x long, ties_y long, tau_b double")
