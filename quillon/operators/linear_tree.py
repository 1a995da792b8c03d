"""Regression trees with a ridge in every leaf, grown level by level from sums of products.

One job a level: a row is counted once for each feature, under its node and the feature's bin, in sums of products of
(1, features, y). Sums over bins on one side of an edge give both sides' ridges, so every split of every node is judged
by the fall in squared error of the leaves' ridges, not of their means. What reaches the driver is nodes x features x
bins rows, whatever the table's size; sums are partial before the shuffle, so one node with all rows is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.linear import LinearModel, _matrix, _sums, gram, solve_ridge


def ridge_error(g: np.ndarray, features: Sequence[str], alpha: float) -> float:
    """The squared error of the ridge that the sums of products g lead to."""
    model = solve_ridge(g, features, alpha)
    w = np.array([model.intercept, *model.coefficients, -1.0])
    return max(0.0, float(w @ g @ w))


@dataclass
class Node:
    """A split (feature <= edge goes left) with children, or a leaf with a model."""

    number: int
    model: LinearModel
    rows: float
    feature: str | None = None
    edge: float | None = None
    children: list[Node] = field(default_factory=list)

    def at(self, make) -> Column:
        """make(leaf) for the leaf that a row falls into; null features go right."""
        if not self.children:
            return make(self)
        left, right = self.children
        return F.when(F.col(f"`{self.feature}`") <= F.lit(self.edge), left.at(make)).otherwise(right.at(make))

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


@dataclass
class LinearTree:
    root: Node
    features: tuple[str, ...]
    low: float
    high: float

    def leaf(self) -> Column:
        """The number of a row's leaf."""
        return self.root.at(lambda n: F.lit(n.number))

    def column(self, bounded: bool = True) -> Column:
        """The prediction, kept between the least and greatest training target if bounded; null where a feature is."""
        out = self.root.at(lambda n: n.model.column())
        return F.least(F.greatest(out, F.lit(self.low)), F.lit(self.high)) if bounded else out

    def importance(self) -> dict[str, float]:
        """Each feature's greatest coefficient by size over the leaves, as a share of all."""
        top = {f: max(abs(n.model.coefficients[i]) for n in self.root.leaves()) for i, f in enumerate(self.features)}
        total = sum(top.values()) or 1.0
        return {f: v / total for f, v in top.items()}

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> LinearTree:
        def node(d: dict) -> Node:
            model = LinearModel(tuple(d["model"]["features"]), d["model"]["intercept"], tuple(d["model"]["coefficients"]))
            return Node(d["number"], model, d["rows"], d["feature"], d["edge"], [node(c) for c in d["children"]])

        return cls(node(data["root"]), tuple(data["features"]), data["low"], data["high"])


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Up to bins - 1 distinct approximate quantiles of each feature."""
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = df.agg(*(F.percentile_approx(F.col(f"`{f}`").cast("double"), at, F.lit(100 * bins)).alias(f"e{i}") for i, f in enumerate(features))).first()
    return {f: sorted(set(found[f"e{i}"] or [])) for i, f in enumerate(features)}


def grow(df: DataFrame, features: Sequence[str], y: str, max_leaves: int = 4, max_depth: int = 3, bins: int = 32, alpha: float = 1.0, min_rows: int = 20) -> LinearTree:
    """Grow a tree: at every level the nodes whose best split lowers the ridge error most are split, up to max_leaves.

    Splits are at approximate quantiles, bins of them; both sides keep min_rows rows. Rows with a null or NaN feature or
    target are not learnt from. Ties go to the first feature, then the smallest edge. No row at all is an error.
    """
    use = F.lit(True)
    for c in (*features, y):
        x = F.col(f"`{c}`").cast("double")
        use &= x.isNotNull() & ~F.isnan(x)
    rows = df.where(use).select(*(F.col(f"`{c}`").cast("double").alias(c) for c in (*features, y)))
    edges = bin_edges(rows, features, bins)
    total = gram(rows, features, y)
    if not total[0, 0]:
        raise ValueError("no row to learn from")
    low, high = rows.agg(F.min(f"`{y}`"), F.max(f"`{y}`")).first()
    root = Node(0, solve_ridge(total, features, alpha), float(total[0, 0]))
    tree, sums, count = LinearTree(root, tuple(features), low, high), {0: total}, 1
    open_nodes = [root]
    for _ in range(max_depth):
        if not open_nodes or len(root.leaves()) >= max_leaves:
            break
        best = _best_splits(rows, tree, open_nodes, sums, edges, y, alpha, min_rows)
        open_nodes = []
        for gain, number in sorted(((b[0], -n) for n, b in best.items()), reverse=True):
            if len(root.leaves()) >= max_leaves:
                break
            node = next(n for n in root.leaves() if n.number == -number)
            _, node.feature, node.edge, left, right = best[-number]
            for part in (left, right):
                child = Node(count, solve_ridge(part, features, alpha), float(part[0, 0]))
                sums[count] = part
                count += 1
                node.children.append(child)
                open_nodes.append(child)
    return tree


def _best_splits(rows: DataFrame, tree: LinearTree, nodes: list[Node], sums: dict[int, np.ndarray], edges: dict[str, list[float]], y: str, alpha: float, min_rows: int) -> dict:
    """By node: the fall in error, the feature, the edge and both sides' sums of its best split, where one lowers the error."""
    features, k = tree.features, len(tree.features) + 2
    # equal edges of a feature are one bin each: how many edges lie below the value
    bin_of = [sum(((F.col(f"`{f}`") > F.lit(e)).cast("int") for e in edges[f]), F.lit(0)) for f in features]
    placed = rows.withColumn("__node", tree.leaf()).where(F.col("__node").isin([n.number for n in nodes]))
    placed = placed.select("*", F.posexplode(F.array(*bin_of)).alias("__feature", "__bin"))
    found: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    for r in placed.groupBy("__node", "__feature", "__bin").agg(*_sums(features, y)).collect():  # nodes x features x bins
        found.setdefault((r["__node"], r["__feature"]), {})[r["__bin"]] = _matrix(r, k)
    best: dict[int, tuple] = {}
    for (number, f), by_bin in sorted(found.items()):
        whole = ridge_error(sums[number], features, alpha)
        left = np.zeros((k, k))
        for b, edge in enumerate(edges[features[f]]):
            left = left + by_bin.get(b, 0.0)
            right = sums[number] - left
            if left[0, 0] < min_rows or right[0, 0] < min_rows - 0.5:
                continue
            gain = whole - ridge_error(left, features, alpha) - ridge_error(right, features, alpha)
            if gain > 1e-9 * max(1.0, whole) and (number not in best or gain > best[number][0] * (1 + 1e-12)):
                best[number] = (gain, features[f], edge, left, right)
    return best


@dataclass
class RidgeAndTrees:
    """A ridge over all rows and trees on what is left of the target, each on what the ones before leave."""

    ridge: LinearModel
    trees: list[LinearTree]

    def column(self) -> Column:
        return sum((t.column(bounded=False) for t in self.trees), self.ridge.column())


def ridge_and_trees(df: DataFrame, features: Sequence[str], y: str, trees: int = 1, alpha: float = 1.0, **options) -> RidgeAndTrees:
    """Fit the ridge, then each tree (options of grow) on the residuals left so far."""
    model = RidgeAndTrees(solve_ridge(gram(df, features, y), features, alpha), [])
    for _ in range(trees):
        left = df.select(*(F.col(f"`{f}`") for f in features), (F.col(f"`{y}`").cast("double") - model.column()).alias("__left"))
        model.trees.append(grow(left, features, "__left", alpha=alpha, **options))
    return model
