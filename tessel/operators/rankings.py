"""Models of rankings and paired comparisons.

A ranking is a set of rows (voter, item, pos), positions from 1 for the best. Counts of pairs come from
one aggregation or a self-join within the voter; what is iterated afterwards has one row per item or
pair of items.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import written


def precedence(rows: DataFrame, voter: str, item: str, pos: str) -> DataFrame:
    """(a, b, n): how many voters put item a before item b."""
    left = rows.select(F.col(voter).alias("v"), F.col(item).alias("a"), F.col(pos).alias("p"))
    right = rows.select(F.col(voter).alias("v"), F.col(item).alias("b"), F.col(pos).alias("q"))
    return left.join(right, "v").where("p < q").groupBy("a", "b").agg(F.count("*").alias("n"))


def mallows_centre(rows: DataFrame, voter: str, item: str, pos: str) -> DataFrame:
    """(item, score, place, mean_distance): items by wins less losses, ties by item, and the mean
    number of pairs in which a voter differs from that order."""
    pairs = written(precedence(rows, voter, item, pos))
    both = pairs.select(F.col("a").alias("item"), F.col("n").alias("s")).unionByName(pairs.select(F.col("b").alias("item"), (-F.col("n")).alias("s")))
    score = both.groupBy("item").agg(F.sum("s").alias("score"))
    # As many rows as items are ranked.
    centre = score.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "item")))
    place = lambda side: centre.select(F.col("item").alias(side), F.col("place").alias(f"place_{side}"))
    wrong = pairs.join(place("a"), "a").join(place("b"), "b").where("place_a > place_b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wrong"))
    voters = rows.agg(F.count_distinct(voter).alias("voters"))
    return centre.crossJoin(F.broadcast(wrong.crossJoin(voters))).select("item", "score", "place", (F.col("wrong") / F.col("voters")).alias("mean_distance"))


def mallows_expected_distance(theta: float, items: int) -> float:
    """Mean Kendall distance to the centre at dispersion theta."""
    if theta < 1e-9:
        return items * (items - 1) / 4
    return items * math.exp(-theta) / -math.expm1(-theta) - sum(j * math.exp(-j * theta) / -math.expm1(-j * theta) for j in range(1, items + 1))


def mallows_theta(mean_distance: float, items: int, most: float = 50.0) -> float:
    """The dispersion whose expected distance is the mean distance; 0 at that of chance or beyond."""
    if mean_distance >= items * (items - 1) / 4:
        return 0.0
    lo, hi = 0.0, most
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mallows_expected_distance(mid, items) > mean_distance else (lo, mid)
    return (lo + hi) / 2


def mallows_score(rows: DataFrame, centre: DataFrame, voter: str, item: str, pos: str, theta: float, items: int) -> DataFrame:
    """(voter, distance, ll): log-probability of each voter's complete ranking."""
    log_z = sum(math.log(-math.expm1(-j * theta) / -math.expm1(-theta)) if theta > 0 else math.log(j) for j in range(1, items + 1))
    placed = rows.join(F.broadcast(centre.select(F.col("item").alias("c_item"), "place")), F.col(item) == F.col("c_item")).select(F.col(voter).alias("v"), F.col(pos).alias("p"), "place")
    other = placed.select(F.col("v").alias("w"), F.col("p").alias("q"), F.col("place").alias("other"))
    wrong = placed.join(other, (F.col("v") == F.col("w")) & (F.col("p") < F.col("q")), "left").groupBy("v").agg(F.count_if(F.col("place") > F.col("other")).alias("distance"))
    return wrong.select(F.col("v").alias(voter), "distance", (-theta * F.col("distance") - log_z).alias("ll"))


def plackett_luce(rows: DataFrame, voter: str, item: str, pos: str, iterations: int = 20) -> DataFrame:
    """(item, w): worths that sum to 1, by minorise-maximise steps from equal ones.

    A voter's ranking is a series of choices, of the first among all, of the second among the rest and so
    on; an item's new worth is its choices over the sum, over the choices it was there for, of one over
    the worth then on offer. A voter's running sums are windows over its own items.
    """
    ranked = rows.select(F.col(voter).alias("v"), F.col(item).alias("item"), F.col(pos).alias("p"))
    w = ranked.select("item").distinct()
    w = written(w.crossJoin(F.broadcast(w.agg(F.count("*").alias("k")))).select("item", (1 / F.col("k")).alias("w")))
    chosen = ranked.withColumn("last", F.col("p") == F.max("p").over(Window.partitionBy("v")))
    rest, done = Window.partitionBy("v").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("v").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(iterations):
        offer = chosen.join(w, "item").withColumn("d", F.sum("w").over(rest))
        shares = offer.withColumn("part", F.sum(F.when(F.col("last"), 0.0).otherwise(1 / F.col("d"))).over(done))
        new = shares.groupBy("item").agg((F.count_if(~F.col("last")) / F.sum("part")).alias("u"))
        total = new.agg(F.sum("u").alias("t"))
        w = written(new.crossJoin(F.broadcast(total)).select("item", (F.col("u") / F.col("t")).alias("w")), instead=w)
    return w


def plackett_luce_score(rows: DataFrame, worths: DataFrame, voter: str, item: str, pos: str) -> DataFrame:
    """(voter, ll): log-probability of each voter's order among the items it ranks."""
    rest = Window.partitionBy(voter).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.select(voter, pos, F.col(item).alias("item")).join(worths, "item")
    return both.withColumn("d", F.sum("w").over(rest)).groupBy(voter).agg(F.sum(F.ln(F.col("w") / F.col("d"))).alias("ll"))


def paired_counts(rows: DataFrame, winner: str, loser: str) -> DataFrame:
    """(a, b, n): wins of a over b."""
    return rows.groupBy(F.col(winner).alias("a"), F.col(loser).alias("b")).agg(F.count("*").alias("n")).where("a <> b")


def bradley_terry(wins: DataFrame, iterations: int = 50) -> DataFrame:
    """(item, w): worths that sum to 1 from (a, b, n), by minorise-maximise steps from equal ones.

    A new worth is the item's wins over the sum, over its meetings, of one over both worths.
    """
    pairs = wins.select("a", "b", "n", F.col("n").alias("won")).unionByName(wins.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", F.lit(0).cast("long").alias("won")))
    met = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("won").alias("won")))
    items = met.select(F.col("a").alias("item")).distinct()
    w = written(items.crossJoin(F.broadcast(items.agg(F.count("*").alias("k")))).select("item", (1 / F.col("k")).alias("w")))
    for _ in range(iterations):
        both = met.join(w.select(F.col("item").alias("a"), F.col("w").alias("wa")), "a").join(w.select(F.col("item").alias("b"), F.col("w").alias("wb")), "b")
        new = both.groupBy(F.col("a").alias("item")).agg((F.sum("won") / F.sum(F.col("n") / (F.col("wa") + F.col("wb")))).alias("u"))
        w = written(new.crossJoin(F.broadcast(new.agg(F.sum("u").alias("t")))).select("item", (F.col("u") / F.col("t")).alias("w")), instead=w)
    return w
