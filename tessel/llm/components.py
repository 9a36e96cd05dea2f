"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, few


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in `edges` (a, b): root is the smallest id of its component.

    Each round is two aggregations and two joins over the edges; rounds grow with the logarithm of
    the longest chain. Between rounds the edges are written to the shared folder.
    """
    now = checkpoint(few(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    if now.isEmpty():
        return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    while True:
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = checkpoint(few(small))
        # Stars only: no node has two centres, or is a centre itself and has one.
        ends = new.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(new.select(F.col("v").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        if ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        now = new
