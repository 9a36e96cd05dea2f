"""Chow-Liu trees: the tree of columns with the most mutual information, as a model with messages along its edges.

One pass counts the cells of all pairs of columns; mutual information per pair is a DataFrame of as
many rows as there are pairs, and the spanning tree over the columns is found on the driver. The
model itself is a table of conditional probabilities. Rows without missing values are scored by one
look-up per column; missing values are summed out by messages from the leaves to the root, as joins
and aggregations over (row, level), so a level table of any size works.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.special import NEG_INF
from tessel.sources.shared import written


@dataclass
class Tree:
    """Columns from the root on, each one's parent (None: the root), and the table (child, parent_level, level, p)."""

    order: list[str]
    parent: dict[str, str | None]
    table: DataFrame

    def of(self, column: str) -> DataFrame:
        return self.table.where(F.col("child") == column).select(F.col("parent_level").alias("_pl"), F.col("level").alias("_l"), "p")


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, x, y, k): the rows that have each pair of levels, for all pairs of columns; rows where either is null are left out."""
    level = lambda c: F.col(c).cast("string")
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), level(a).alias("x"), level(b).alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = df.select(F.explode(F.array(*pairs)).alias("c")).select("c.*").where("x IS NOT NULL AND y IS NOT NULL")
    return cells.groupBy("a", "b", "x", "y").agg(F.count("*").alias("k"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(a, b, mi) in nats, from `pair_counts`."""
    side = lambda v: counts.groupBy("a", "b", v).agg(F.sum("k").alias("s")).groupBy("a", "b").agg(F.sum(F.col("s") * F.ln("s")).alias(f"e_{v}"))
    joint = counts.groupBy("a", "b").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("e"))
    both = joint.join(side("x"), ["a", "b"]).join(side("y"), ["a", "b"])
    return both.select("a", "b", ((F.col("e") - F.col("e_x") - F.col("e_y")) / F.col("n") + F.ln("n")).alias("mi"))


def spanning_tree(weights: list[tuple[str, str, float]], columns: list[str], root: str) -> tuple[list[str], dict[str, str | None]]:
    """Columns in the order they join the tree from `root`, and their parents: each time the heaviest edge that leaves it."""
    weight = {frozenset((a, b)): w for a, b, w in weights}
    order, parent = [root], {root: None}
    while len(order) < len(columns):
        _, u, v = max(((weight.get(frozenset((u, v)), 0.0), -columns.index(u), -columns.index(v)), u, v) for u in order for v in columns if v not in parent)
        order.append(v)
        parent[v] = u
    return order, parent


def fit(df: DataFrame, columns: list[str], root: str | None = None, pseudo: float = 0.0) -> tuple[Tree, list[tuple[str, str, float]]]:
    """The tree and the mutual information (nats) of all pairs.

    `pseudo` is shared out evenly over the levels of a column given each parent level (and over those of the root).
    """
    counts = written(pair_counts(df, columns))
    weights = [(r.a, r.b, r.mi) for r in mutual_information(counts).collect()]
    order, parent = spanning_tree(weights, columns, root or columns[0])
    level = F.col(order[0]).cast("string")
    tables = [df.where(level.isNotNull()).groupBy(level.alias("level")).agg(F.count("*").alias("k")).select(F.lit(order[0]).alias("child"), F.lit(None).cast("string").alias("parent_level"), "level", "k")]
    for c in order[1:]:
        p = parent[c]
        straight = columns.index(p) < columns.index(c)
        a, b, up, own = (p, c, "x", "y") if straight else (c, p, "y", "x")
        tables.append(counts.where((F.col("a") == a) & (F.col("b") == b)).select(F.lit(c).alias("child"), F.col(up).alias("parent_level"), F.col(own).alias("level"), "k"))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rows = written(rows)
    totals = rows.groupBy("child", F.col("parent_level").alias("pl")).agg(F.sum("k").alias("t"))
    levels = rows.groupBy("child").agg(F.count_distinct("level").alias("levels"))
    met = rows.join(totals, (rows["child"] == totals["child"]) & rows["parent_level"].eqNullSafe(totals["pl"])).drop(totals["child"]).join(levels, "child")
    p = (F.col("k") + pseudo / F.col("levels")) / (F.col("t") + pseudo)
    return Tree(order, parent, written(met.select("child", "parent_level", "level", p.alias("p")))), weights


def score_complete(df: DataFrame, tree: Tree, name: str = "ll") -> DataFrame:
    """Add the log-density of rows without missing values; levels that the model hasn't seen together give -infinity."""
    rows = df.withColumn(name, F.lit(0.0))
    for c in tree.order:
        up = F.lit(None).cast("string") if tree.parent[c] is None else F.col(f"`{tree.parent[c]}`").cast("string")
        rows = rows.join(tree.of(c), (F.col(f"`{c}`").cast("string") == F.col("_l")) & up.eqNullSafe(F.col("_pl")), "left")
        rows = rows.withColumn(name, F.col(name) + F.when(F.col("p") > 0, F.ln("p")).otherwise(F.lit(NEG_INF))).drop("_l", "_pl", "p")
    return rows


def _log_sum(column: str) -> Column:
    """Logarithm of the sum of exponentials of a group, by its largest."""
    held = F.collect_list(column)
    top = F.max(column)
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.ln(F.aggregate(F.transform(held, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)))


def beliefs(df: DataFrame, tree: Tree, key: str) -> DataFrame:
    """(key, level, logb): for every row the joint log-density of what it holds and each level of the root column.

    Missing values are summed out from the leaves on; `key` names rows uniquely.
    """
    held = {c: F.col(f"`{c}`").cast("string") for c in tree.order}
    rows = written(df.select(F.col(key).alias("k"), *[v.alias(f"h{i}") for i, v in enumerate(held.values())]))
    place = {c: i for i, c in enumerate(tree.order)}
    message: dict[str, DataFrame] = {}
    for c in reversed(tree.order):
        own = f"h{place[c]}"
        table = tree.of(c)
        # Beliefs of (row, level of c): what its children say about that level.
        levels = table.select("_l").distinct()
        seen = rows.where(f"{own} IS NOT NULL").select("k", F.col(own).alias("level"))
        open_rows = rows.where(f"{own} IS NULL").select("k").crossJoin(F.broadcast(levels)) if levels.count() <= 10_000 else rows.where(f"{own} IS NULL").select("k").join(levels)
        state = seen.unionByName(open_rows.select("k", F.col("_l").alias("level"))).withColumn("logb", F.lit(0.0))
        for child in [d for d in tree.order if tree.parent[d] == c]:
            said = message.pop(child)
            state = state.join(said, (state["k"] == said["mk"]) & (state["level"] == said["ml"]), "left").select("k", "level", (F.col("logb") + F.coalesce("m", F.lit(NEG_INF))).alias("logb"))
        met = state.join(table, state["level"] == table["_l"]).withColumn("logb", F.col("logb") + F.when(F.col("p") > 0, F.ln("p")).otherwise(F.lit(NEG_INF)))
        if tree.parent[c] is None:
            return met.select(F.col("k").alias(key), "level", "logb")
        up = rows.select(F.col("k").alias("uk"), F.col(f"h{place[tree.parent[c]]}").alias("up"))
        met = met.join(up, met["k"] == up["uk"]).where("up IS NULL OR up = _pl")
        message[c] = written(met.groupBy(F.col("k").alias("mk"), F.col("_pl").alias("ml")).agg(_log_sum("logb").alias("m")))
    raise ValueError("a tree needs a root")


def score(df: DataFrame, tree: Tree, key: str) -> DataFrame:
    """(key, ll) of every row, missing values summed out; -infinity for levels the model hasn't seen together."""
    missing = F.lit(False)
    for c in tree.order:
        missing = missing | F.col(f"`{c}`").isNull()
    whole = score_complete(df.where(~missing), tree).select(key, "ll")
    rest = df.where(missing)
    part = beliefs(rest, tree, key).groupBy(key).agg(_log_sum("logb").alias("ll"))
    part = rest.select(key).join(part, key, "left").select(key, F.coalesce("ll", F.lit(NEG_INF)).alias("ll"))
    return whole.unionByName(part)


def posterior(df: DataFrame, columns: list[str], tree: Tree, rooted: Tree, key: str) -> DataFrame:
    """(key, level, p): the distribution of the root column of `rooted` (the same tree fitted from that root) given each row's other columns.

    What a row holds in that column itself isn't used.
    """
    if {frozenset((c, p)) for c, p in tree.parent.items() if p} != {frozenset((c, p)) for c, p in rooted.parent.items() if p}:
        raise ValueError("both trees must have the same edges")
    from pyspark.sql import Window

    open_root = df.select(key, *[F.lit(None).cast("string").alias(c) if c == rooted.order[0] else F.col(f"`{c}`") for c in columns])
    state = beliefs(open_root, rooted, key)
    top = F.max("logb").over(Window.partitionBy(key))
    weight = F.when(top == NEG_INF, 0.0).otherwise(F.exp(F.col("logb") - top))
    state = state.select(key, "level", weight.alias("w"))
    total = F.sum("w").over(Window.partitionBy(key))
    return state.select(key, "level", F.when(total > 0, F.col("w") / total).alias("p"))
