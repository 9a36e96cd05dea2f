"""Entropy splits, trees and forests from histograms of (tree, node, feature, bin, label): no row moves.

Features are binned once by quantiles. A level of all trees takes one pass: every task walks its rows
down the trees so far (a bounded table, sent along), counts the cells of the open nodes in numpy, and
Spark sums the cells; windows over the bins then give the best split of every node. Bags are Poisson
weights from a hash of tree and row key, so a row counts alike whenever it is read; they are worked out
once and written with the bins, one byte a tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import scoped, written


def _entropy(counts: list[Column], total: Column) -> Column:
    """Total times entropy, in nats."""
    return sum((F.when(c > 0, -c * F.ln(c / total)).otherwise(0.0) for c in counts), F.lit(0.0))


def best_splits(cells: DataFrame, by: list[str], classes: int, least: float = 0.0) -> DataFrame:
    """(by, feature, bin, gain, n): the split 'at most bin, or above' of each group with the largest gain in nats a row.

    `cells`: by, feature, bin, c0 .. c<classes - 1> (weights of the classes). Ties go to the smaller
    feature, then the smaller bin; groups without a split that gains more than `least` have no row.
    """
    upto = Window.partitionBy(*by, "feature").orderBy("bin")
    whole = Window.partitionBy(*by, "feature")
    names = [f"c{k}" for k in range(classes)]
    rows = cells.select(*by, "feature", "bin", *[F.sum(c).over(upto).alias(f"l{k}") for k, c in enumerate(names)], *[F.sum(c).over(whole).alias(f"t{k}") for k, c in enumerate(names)])
    left, total = [F.col(f"l{k}").cast("double") for k in range(classes)], [F.col(f"t{k}").cast("double") for k in range(classes)]
    right = [t - s for s, t in zip(left, total, strict=True)]
    nl, nt = sum(left[1:], left[0]), sum(total[1:], total[0])
    nr = nt - nl
    gain = (_entropy(total, nt) - _entropy(left, nl) - _entropy(right, nr)) / nt
    found = rows.select(*by, "feature", "bin", F.when((nl > 0) & (nr > 0), gain).alias("gain"), nt.alias("n")).where(F.col("gain") > least)
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n"))
    return found.groupBy(*by).agg(best.alias("s")).select(*by, (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gain", "s.n")


def entropy_split(df: DataFrame, features: list[Column], label: str, by: list[str] | None = None) -> DataFrame:
    """The best split of each group over integer features (bins), numbered from 0; null features and labels are left out per feature."""
    by = by or []
    classes = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), f.cast("long").alias("bin")) for i, f in enumerate(features)]))
    rows = df.where(F.col(label).isNotNull()).select(*by, F.col(label).alias("_y"), each.alias("f")).select(*by, "_y", "f.*").where("bin IS NOT NULL")
    cells = rows.groupBy(*by, "feature", "bin").agg(*[F.count_if(F.col("_y") == c).alias(f"c{k}") for k, c in enumerate(classes)])
    return best_splits(cells, by, len(classes))


@dataclass
class Forest:
    """Bin edges of the features, the classes, and of each tree its nodes: number -> (feature, bin) or, for a leaf, class shares.

    Node 1 is the root; the children of node k are 2 k (at most the bin) and 2 k + 1.
    """

    features: list[str]
    edges: list[list[float]]
    classes: list
    splits: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    leaves: list[dict[int, list[float]]] = field(default_factory=list)


def _value(column: Column) -> Column:
    """A feature as double; null counts as below all."""
    return F.coalesce(column.cast("double"), F.lit(float("-inf")))


def _bins(values: np.ndarray, edges: list[float]) -> np.ndarray:
    """Edges below each value: 0 to their number; NaN is above all that are none."""
    return np.searchsorted(np.sort(np.array(edges, float)), values)


def _rules(splits: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the inner nodes, ascending, and their features and bins."""
    known = np.array(sorted(splits), np.int64)
    return known, np.array([splits[k] for k in known.tolist()], np.int64).reshape(-1, 2)


def _walk(bins: np.ndarray, rules: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, rule = rules
    node = np.ones(len(bins), np.int64)
    if not len(known):
        return node
    rows, flat, width = np.arange(len(bins)), np.ascontiguousarray(bins).ravel(), bins.shape[1]
    # Of all rows the place of their node among the inner ones; rows in a leaf drop out.
    at = np.full(len(bins), np.searchsorted(known, 1))
    while len(rows):
        node[rows] = mine = 2 * node[rows] + (flat[rows * width + rule[at, 0]] > rule[at, 1])
        at = np.searchsorted(known, mine)
        at[at == len(known)] = 0
        inner = known[at] == mine
        rows, at = rows[inner], at[inner]
    return node


def poisson_weights(hashed: np.ndarray) -> np.ndarray:
    """Poisson weights of mean 1 from 64-bit hashes."""
    u = (hashed.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(steps, u)


@scoped
def fit(df: DataFrame, key: str, features: list[str], label: str, trees: int = 10, depth: int = 5, bins: int = 32, per_node: int | None = None, bagged: bool = True, least: float = 1e-6) -> Forest:
    """A forest for a label with a bounded number of classes; each node tries `per_node` features chosen by a hash (None: all)."""
    rows = df.where(F.col(label).isNotNull())
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    cuts = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), [(i + 1) / bins for i in range(bins - 1)], 10_000).alias(f"q{i}") for i, f in enumerate(features)]).head()
    edges = [sorted(set(q or [])) for q in cuts]
    code = F.create_map(*[c for k, v in enumerate(classes) for c in (F.lit(v), F.lit(k))])
    hashes = [F.xxhash64(F.lit(t), F.col(key)).alias(f"h{t}") for t in range(trees)] if bagged else []
    values = [_value(F.col(f)).alias(f"x{i}") for i, f in enumerate(features)]
    table = written(_coded(rows.select(F.try_element_at(code, F.col(label)).alias("y"), *hashes, *values), len(hashes), edges))
    forest = Forest(features, edges, classes, [{} for _ in range(trees)], [{} for _ in range(trees)])
    n_classes, n_features, most = len(classes), len(features), max([len(e) for e in edges], default=0) + 1
    open_nodes, last = {(t, 1) for t in range(trees)}, None
    for level in range(depth + 1):
        if not open_nodes or not n_classes:
            break
        cells = _histogram(table, forest.splits, open_nodes, n_features, most, n_classes, bagged)
        cells = last = written(cells, instead=last)
        shares = cells.where("feature = 0").groupBy("tree", "node").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n_classes)]).collect()
        found = {}
        if level < depth:
            tried = cells
            if per_node and per_node < n_features:
                place = F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.xxhash64("tree", "node", "feature")))
                picked = cells.select("tree", "node", "feature").distinct().withColumn("k", place).where(F.col("k") <= per_node).drop("k")
                tried = cells.join(picked, ["tree", "node", "feature"])
            found = {(r.tree, r.node): (int(r.feature), int(r.bin)) for r in best_splits(tried, ["tree", "node"], n_classes, least).collect()}
        open_nodes = set()
        for r in shares:
            c = [float(r[f"c{k}"]) for k in range(n_classes)]
            if (r.tree, r.node) in found:
                forest.splits[r.tree][r.node] = found[r.tree, r.node]
                open_nodes |= {(r.tree, 2 * r.node), (r.tree, 2 * r.node + 1)}
            else:
                forest.leaves[r.tree][r.node] = [v / sum(c) for v in c]
    return forest


def _coded(rows: DataFrame, trees: int, edges: list[list[float]]) -> DataFrame:
    """The hashes of `trees` bags (h0 ..) as Poisson weights (w0 ..), and the values of the features (x0 ..) as bins (b0 ..)."""
    names = ["y", *[f"w{t}" for t in range(trees)], *[f"b{i}" for i in range(len(edges))]]

    def run(batches):
        for batch in batches:
            # The largest weight of 53 bits is below 20.
            weights = [pa.array(poisson_weights(batch.column(f"h{t}").to_numpy()).astype(np.int8)) for t in range(trees)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), *weights, *[pa.array(_bins(batch.column(f"x{i}").to_numpy(), e).astype(np.int32)) for i, e in enumerate(edges)]], names)

    return rows.mapInArrow(run, ", ".join(f"{n} {'byte' if n[0] == 'w' else 'int'}" for n in names))


def _histogram(table: DataFrame, splits, open_nodes, n_features: int, most: int, n_classes: int, bagged: bool) -> DataFrame:
    """(tree, node, feature, bin, c0 ..) of the open nodes."""
    shared = table.sparkSession.sparkContext.broadcast((splits, sorted(open_nodes)))
    names = ["tree", "node", "feature", "bin", *[f"c{k}" for k in range(n_classes)]]

    def run(batches):
        splits, wanted = shared.value
        nodes, rules = [np.array([n for t, n in wanted if t == tree], np.int64) for tree in range(len(splits))], [_rules(s) for s in splits]
        sums = [np.zeros((len(n), n_features, most, n_classes), np.int64) for n in nodes]
        for batch in batches:
            y = batch.column("y").to_numpy()
            bins = np.stack([batch.column(f"b{i}").to_numpy() for i in range(n_features)], axis=1) if n_features else np.zeros((len(y), 0), int)
            for t, mine in enumerate(nodes):
                if not len(mine):
                    continue
                node = _walk(bins, rules[t])
                at = np.searchsorted(mine, node)
                at[at == len(mine)] = 0
                met = mine[at] == node
                w = batch.column(f"w{t}").to_numpy() if bagged else np.ones(len(y), np.int8)
                met &= w > 0
                rows = np.flatnonzero(met)
                at, w, size = at[rows], w[rows].astype(float), len(mine) * most * n_classes
                for i in range(n_features):
                    # Sums of a batch's whole weights are exact.
                    cell = (at * most + bins[rows, i]) * n_classes + y[rows]
                    sums[t][:, i] += np.bincount(cell, w, size).astype(np.int64).reshape(len(mine), most, n_classes)
        for t, mine in enumerate(nodes):
            node, feature, b = np.nonzero(sums[t].sum(axis=3))
            if len(node):
                counts = sums[t][node, feature, b]
                columns = [pa.array(np.full(len(node), t, np.int32)), pa.array(mine[node]), pa.array(feature.astype(np.int32)), pa.array(b.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(n_classes)]], names)

    kinds = ["int", "long", "int", "int", *["long"] * n_classes]
    parts = table.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return parts.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(n).alias(n) for n in names[4:]])


def predict(df: DataFrame, forest: Forest, name: str = "shares") -> DataFrame:
    """Add the mean over the trees of the class shares of a row's leaf, in the order of `forest.classes`."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    width = len(forest.features)
    values = F.array(*[_value(F.col(f)) for f in forest.features])

    @F.arrow_udf("array<double>")
    def shares(rows: pa.Array) -> pa.Array:
        model = shared.value
        given = rows.flatten().to_numpy().reshape(len(rows), width)
        bins = np.stack([_bins(given[:, i], e) for i, e in enumerate(model.edges)], axis=1) if width else given.astype(int)
        out = np.zeros((len(bins), len(model.classes)))
        for splits, leaves in zip(model.splits, model.leaves, strict=True):
            known = np.array(sorted(leaves))
            table = np.array([leaves[k] for k in known])
            # A bag may leave a child empty: its rows get the shares of no tree.
            node = _walk(bins, _rules(splits))
            at = np.searchsorted(known, node)
            at[at == len(known)] = 0
            out += np.where((known[at] == node)[:, None], table[at], 0.0)
        total = out.sum(axis=1, keepdims=True)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array((out / np.where(total > 0, total, 1)).ravel()))

    return df.withColumn(name, shares(values))
