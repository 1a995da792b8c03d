"""Exact top-k search by inner product, with cover trees over queries and data.

Rows are dealt to blocks: to the nearest of some pivots, and large cells are split by a hash of the id, so identical
vectors do not pile up in one task. Every block is indexed by a cover tree: a node has a centre, all its points lie
within its radius, and its children's centres cover it at a smaller radius while keeping that distance from each
other. Queries are blocked and indexed in the same way.

Two nodes are met together: no query below one scores more with a point below the other than
<a, b> + |a| R_b + |b| R_a + R_a R_b, so the pair is pruned when that is below the worst k-th score among the node's
queries. Each query group first searches the blocks of its own pivot; the k-th scores found there prune whole pairs of
groups and blocks before any data move, and start the searches of the others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import materialise

#: A node of so few points is a leaf, of data and of queries, so that two leaves make one dense product; each level's
#: radius is this share of the one above, or what FANOUT centres reach.
LEAF, QUERY_LEAF, SHRINK, FANOUT = 512, 128, 0.6, 16
#: At most so many pivots, from about so many sampled rows.
PIVOTS, SAMPLE = 64, 4096


class CoverTree:
    """Points in tree order with their ids; nodes as parallel arrays: point range, centre, radius, children's range."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, tags: np.ndarray, leaf: int = LEAF) -> None:
        real = points.astype(np.float64)
        order: list[np.ndarray] = []
        self.low, self.high, self.radius = [], [], []
        centres: list[int] = []
        placed = 0

        def near(members: np.ndarray, centre: int) -> np.ndarray:
            gap = real[members] - real[centre]
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        middle = np.abs(real - real.mean(0)).sum(1).argmin() if len(real) else 0
        kids: list[list[int]] = []
        queue = [(np.arange(len(real)), int(middle), -1)] if len(real) else []
        while queue:  # breadth first, so that a node's children are consecutive
            after: list[tuple[np.ndarray, int, int]] = []
            for members, centre, parent in queue:
                node = len(centres)
                centres.append(centre)
                kids.append([])
                if parent >= 0:
                    kids[parent].append(node)
                distance = near(members, centre)
                radius = float(distance.max())
                self.radius.append(radius * (1 + 1e-9))
                split = self._children(real, members, centre, distance, radius) if len(members) > leaf and radius > 0 else None
                self.low.append(-1)
                self.high.append(-1)
                if split is None:
                    self.low[node], self.high[node] = placed, placed + len(members)
                    order.append(members)
                    placed += len(members)
                else:
                    after += [(m, c, node) for m, c in split]
            queue = after
        turn = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.points, self.ids, self.tags = points[turn], ids[turn], tags[turn]
        self.centre = real[centres] if centres else np.zeros((0, points.shape[1]))
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.kids = kids
        self.radius = np.array(self.radius)
        self.leaves = [self._below(n) for n in range(len(centres))]

    def _children(self, real: np.ndarray, members: np.ndarray, centre: int, distance: np.ndarray, radius: float) -> list[tuple[np.ndarray, int]]:
        """Centres taken farthest first until all members are within the next radius, or FANOUT are taken.

        Centres lie farther from each other than they cover, and every point of positive distance can be split off, so
        a node's children are smaller than it, also where many dimensions keep points far apart.
        """
        least, owner, centres = distance.copy(), np.zeros(len(members), np.int64), [centre]
        while least.max() > SHRINK * radius and len(centres) < FANOUT:
            far = int(members[least.argmax()])
            gap = real[members] - real[far]
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            owner[d < least] = len(centres)
            least = np.minimum(least, d)
            centres.append(far)
        return [(members[owner == k], c) for k, c in enumerate(centres)]

    def _below(self, node: int) -> np.ndarray:
        """The points below a node, by place."""
        if not self.kids[node]:
            return np.arange(self.low[node], self.high[node])
        return np.concatenate([self._below(k) for k in self.kids[node]])


class TopK:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.worst = floor.astype(np.float64)  # a score below this is not among the k best
        self.pruned, self.scored = 0, 0  # pairs of nodes left out by their bound, pairs of leaves scored

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        best = np.lexsort((i, -s))[: self.k]
        self.scores[query], self.ids[query] = s[best], i[best]
        if len(best) == self.k:
            self.worst[query] = max(self.worst[query], float(s[best[-1]]))


def dual_search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray) -> TopK:
    """For each query (in its tree's order) its k best points of `data` among those not below its floor; ids equal to its own do not count."""
    found = TopK(len(queries.ids), k, floor)
    if not len(queries.ids) or not len(data.ids):
        return found
    small = max(np.abs(queries.points).max(initial=0), np.abs(data.points).max(initial=0)) < 1 << 20
    q = queries.points.astype(np.float64) if small else queries.points
    d = data.points.astype(np.float64) if small else data.points

    def bound(a: int, b: np.ndarray) -> np.ndarray:
        rb = data.radius[b]
        top = data.centre[b] @ queries.centre[a] + queries.norm[a] * rb + data.norm[b] * queries.radius[a] + queries.radius[a] * rb
        return top + 1e-9 * (1 + np.abs(top)) + 1e-3

    stack = [(float(bound(0, np.array([0]))[0]), 0, 0)]
    while stack:
        top, a, b = stack.pop()
        own = queries.leaves[a]
        if top < found.worst[own].min():
            found.pruned += 1
            continue
        if queries.kids[a] and (not data.kids[b] or queries.radius[a] > data.radius[b]):
            stack += sorted((float(bound(x, np.array([b]))[0]), x, b) for x in queries.kids[a])
        elif data.kids[b]:
            nodes = np.array(data.kids[b])
            stack += sorted((float(t), a, int(x)) for t, x in zip(bound(a, nodes), nodes, strict=True))
        else:
            found.scored += 1
            part = slice(data.low[b], data.high[b])
            scores = (q[own] @ d[part].T).astype(np.int64)
            ids = data.ids[part]
            good = (scores >= found.worst[own][:, None]) & (ids[None, :] != queries.ids[own][:, None])
            for row in np.nonzero(good.any(axis=1))[0]:
                found.add(int(own[row]), scores[row][good[row]], ids[good[row]])
    return found


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector is null or holds a null or a non-finite component."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _pivots(vectors: DataFrame, width: int) -> np.ndarray:
    """At most PIVOTS rows, spread out, of a bounded sample of about SAMPLE."""
    total = vectors.count()
    cells = 1 << 20
    share = min(cells, -(-SAMPLE * cells // max(1, total)))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(cells)) < share).select("vec_id", "v").limit(4 * SAMPLE).collect()
    rows = _matrix([r["v"] for r in sorted(sample, key=lambda r: (r["vec_id"], r["v"]))], width).astype(np.float64)
    if not len(rows):
        return np.zeros((1, width))
    chosen, least = [0], np.full(len(rows), np.inf)
    for _ in range(min(PIVOTS, -(-total // 2048)) - 1):
        gap = rows - rows[chosen[-1]]
        least = np.minimum(least, np.einsum("ij,ij->i", gap, gap))
        if least.max() == 0:
            break
        chosen.append(int(least.argmax()))
    return rows[chosen]


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _blocks(vectors: DataFrame, pivots: np.ndarray, width: int, rows: int, name: str, leaf: int) -> DataFrame:
    """pivot, block, tree (pickled): blocks of about `rows` rows of one pivot, as trees."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            points = _matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            pivot = (points @ pivots.T - half).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32))], names=["vec_id", "v", "pivot"])

    dealt = materialise(vectors.select("vec_id", "v").mapInArrow(deal, "vec_id long, v array<long>, pivot int"), f"{name}-dealt")
    counts = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("__n"))  # at most PIVOTS rows
    salted = dealt.join(F.broadcast(counts), "pivot").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("__n") / rows)).cast("int"))

    def grow(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        points = _matrix([list(v) for v in frame["v"]], width)
        tree = CoverTree(points, frame["vec_id"].to_numpy(np.int64), frame["tag"].to_numpy(np.int64), leaf)
        return pd.DataFrame({"pivot": [key[0]], "block": [key[1]], "tree": [pickle.dumps(tree)], "centre": [tree.centre[0].tolist()], "radius": [tree.radius[0]]})

    tagged = salted.select("pivot", "block", "vec_id", "v", F.xxhash64("v").alias("tag"))
    grown = tagged.groupBy("pivot", "block").applyInPandas(grow, "pivot int, block int, tree binary, centre array<double>, radius double")
    return materialise(grown, f"{name}-trees")


def top_k(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows by integer inner product; ties to the smaller id.

    queries: a condition that marks the query rows. Components are floor(scale * x); shorter vectors count as padded
    with zeros. Rows whose vector is null or has a null or non-finite component, or whose id is null, take no part, and
    rows with a query's own id are not its candidates. Fewer than k candidates are all returned; no rows give none.
    Rows repeated with the same id are candidates each.
    """
    usable = df.where(F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), quantised(vector, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("v IS NOT NULL")
    usable = materialise(usable, "vectors")
    width = max(1, usable.agg(F.max(F.size("v"))).first()[0] or 0)
    pivots = _pivots(usable, width)
    data = _blocks(usable, pivots, width, block_rows, "data", LEAF)
    asking = _blocks(usable.where("asks").distinct(), pivots, width, block_rows, "queries", QUERY_LEAF)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine, other = pickle.loads(row["queries"]), pickle.loads(row["data"])
                floor = np.frombuffer(row["floor"], np.float64) if row["floor"] else np.full(len(mine.ids), -np.inf)
                found = dual_search(mine, other, k, floor)
                n = np.array([len(s) for s in found.scores])
                who = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["qp"]] * len(who), pa.int32()), pa.array([row["qb"]] * len(who), pa.int32()), pa.array(who), pa.array(mine.ids[who]), pa.array(mine.tags[who]), pa.array(np.concatenate(found.ids).astype(np.int64)), pa.array(np.concatenate(found.scores).astype(np.int64))],
                    names=["qp", "qb", "place", "query_id", "tag", "vec_id", "score"],
                )

    schema = "qp int, qb int, place long, query_id long, tag long, vec_id long, score long"
    groups = asking.select(F.col("pivot").alias("qp"), F.col("block").alias("qb"), F.col("tree").alias("queries"), F.col("centre").alias("qc"), F.col("radius").alias("qr"))
    blocks = data.select(F.col("pivot").alias("dp"), F.col("block").alias("db"), F.col("tree").alias("data"), F.col("centre").alias("dc"), F.col("radius").alias("dr"))
    home = groups.join(blocks, (F.col("qp") == F.col("dp")) & (F.col("db") == 0)).withColumn("floor", F.lit(None).cast("binary"))
    seeds = materialise(home.select("qp", "qb", "queries", "data", "floor").mapInArrow(search, schema), "search-home")

    # per group: each query's k-th score so far, and the least of them
    best = W.partitionBy("qp", "qb", "place").orderBy(F.col("score").desc(), "vec_id")
    kth = seeds.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("qp", "qb", "place", F.col("score").cast("double").alias("kth"))

    def floors(key, frame: pd.DataFrame) -> pd.DataFrame:
        out = np.full(int(frame["place"].max()) + 1, -np.inf)
        out[frame["place"]] = frame["kth"].fillna(-np.inf)
        return pd.DataFrame({"qp": [key[0]], "qb": [key[1]], "floor": [out.tobytes()], "least": [float(out.min())]})

    places = groups.select("qp", "qb", "queries").mapInArrow(_places, "qp int, qb int, place long").join(kth, ["qp", "qb", "place"], "left")
    floor = materialise(places.groupBy("qp", "qb").applyInPandas(floors, "qp int, qb int, floor binary, least double"), "search-floors")
    dot = F.aggregate(F.zip_with("qc", "dc", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    most = dot + norm(F.col("qc")) * F.col("dr") + norm(F.col("dc")) * F.col("qr") + F.col("qr") * F.col("dr")
    # the stated query set against all rows, in blocks: every group asks the blocks of each pivot; only centres and radii
    # meet here, and trees are fetched for the pairs that are left
    met = groups.drop("queries").join(floor.select("qp", "qb", "least"), ["qp", "qb"]).withColumn("dp", F.explode(F.sequence(F.lit(0), F.lit(len(pivots) - 1))))
    met = met.join(blocks.drop("data"), "dp").where((most * (1 + 1e-9) + 1 >= F.col("least")) & ~((F.col("qp") == F.col("dp")) & (F.col("db") == 0)))
    pairs = materialise(met.select("qp", "qb", "dp", "db"), "search-pairs")
    spread = pairs.join(blocks.select("dp", "db", "data"), ["dp", "db"]).join(groups.select("qp", "qb", "queries"), ["qp", "qb"]).join(floor.select("qp", "qb", "floor"), ["qp", "qb"])
    rest = spread.select("qp", "qb", "queries", "data", "floor").mapInArrow(search, schema)
    every = seeds.unionByName(rest)
    top = W.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = len(pickle.loads(row["queries"]).ids)
            yield pa.RecordBatch.from_arrays([pa.array([row["qp"]] * n, pa.int32()), pa.array([row["qb"]] * n, pa.int32()), pa.array(np.arange(n))], names=["qp", "qb", "place"])
