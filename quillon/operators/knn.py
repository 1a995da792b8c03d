"""Nearest-neighbour joins and predictions over array columns.

Queries and data are dealt to blocks, and every pair of blocks meets once: each pair's partial top k is taken in the
task by matrix products, so no row pair leaves it, and a window merges k rows per block. This is the stated query set
against all rows. Vectors of few dimensions, where bounds prune, are dealt to the leaves of a tree of cuts instead: a
query meets its own leaf and those that its k-th distance reaches, and rows of equal vectors are one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.sources.scratch import stored

BLOCK = 2048
#: Dimensions up to which leaves are used, and pairs of rows up to which blocks are used in any case.
FEW_DIMENSIONS = 4
FEW_PAIRS = 4 * BLOCK * BLOCK
#: Points of a leaf, about; the number of leaves; the points a leaf that cuts are found from; queries of a task.
LEAF = 2048
MOST_LEAVES = 16_384
CUT_POINTS = 32
QUERIES = 16_384
SLICE = 512


def knn(queries: DataFrame, data: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """query_id, id, d2 (squared distance), rk (from 1) of each query's k nearest rows; ties to the smaller id.

    Rows whose vector is null or holds a null take no part."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull())
    queries, data = queries.where(whole), data.where(whole)
    n_data, least, largest = data.agg(F.count(F.lit(1)), F.min(F.size(vector)), F.max(F.size(vector))).first()
    n_queries = queries.count()
    if n_data * n_queries > FEW_PAIRS and 0 < least == largest <= FEW_DIMENSIONS:
        rows = (t.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for t in (queries, data))
        return _by_leaves(*(t.where((F.size("v") == largest) & F.forall("v", lambda x: F.abs(x) < F.lit(float("inf")))) for t in rows), k, largest, skip_self)
    db, qb = max(1, -(-n_data // BLOCK)), max(1, -(-n_queries // BLOCK))
    left = queries.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    right = data.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    left = left.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(db - 1))))
    right = right.withColumn("d", F.pmod(F.xxhash64("id"), F.lit(db)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def near(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "d2": []})
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        rough = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        own, ids = a["id"].to_numpy(), b["id"].to_numpy()
        if skip_self:
            rough[own[:, None] == ids[None, :]] = np.inf
        take = min(len(ids), k + 8)
        part = np.argpartition(rough, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(own), 1))
        gap = x[:, None, :] - y[part]
        d2 = (gap * gap).sum(2)
        d2[np.isinf(np.take_along_axis(rough, part, 1))] = np.inf
        if take < len(ids):  # of many rows as near as the last, those of the smallest ids
            last = np.sort(d2, axis=1)[:, k - 1]
            slack = 1e-12 * ((x * x).sum(1) + (y * y).sum(1).max())
            for i in np.flatnonzero((rough <= (last + slack)[:, None]).sum(1) > take):
                exact = ((x[i] - y) ** 2).sum(1)
                exact[np.isinf(rough[i])] = np.inf
                part[i] = np.lexsort((ids, exact))[:take]
                d2[i] = exact[part[i]]
        order = np.lexsort((ids[part], d2), axis=1)[:, :k]
        rows, cols = np.repeat(np.arange(len(own)), order.shape[1]), np.take_along_axis(part, order, 1).ravel()
        out = pd.DataFrame({"query_id": own[rows], "id": ids[cols], "d2": np.take_along_axis(d2, order, 1).ravel()})
        return out[np.isfinite(out["d2"])]

    found = left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInPandas(near, "query_id long, id long, d2 double")
    rk = F.row_number().over(W.partitionBy("query_id").orderBy("d2", "id"))
    return found.withColumn("rk", rk).where(F.col("rk") <= k)


def _cuts(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each cut of a full tree, node 1 its root, 2i and 2i + 1 the sides below and from the cut of i."""
    axis, cut = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    held = {1: points}
    for node in range(1, 1 << depth):
        here = held.pop(node, points[:0])
        spread = here.max(0) - here.min(0) if len(here) else np.zeros(1)
        if not spread.max() > 0:
            continue  # all go below
        axis[node] = a = int(np.argmax(spread))
        x = np.sort(here[:, a])
        cut[node] = max(x[len(x) // 2], x[np.searchsorted(x, x[0], side="right")])
        held[2 * node], held[2 * node + 1] = here[here[:, a] < cut[node]], here[here[:, a] >= cut[node]]
    return axis, cut


def _leaf(x: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(len(cut).bit_length() - 1):
        node = 2 * node + (x[np.arange(len(x)), axis[node]] >= cut[node])
    return node


def _reached(x: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and of leaves whose box lies within the query's reach (a squared distance)."""
    at, node = np.arange(len(x)), np.ones(len(x), np.int64)
    for _ in range(len(low).bit_length() - 2):
        at, node = np.repeat(at, 2), np.repeat(2 * node, 2)
        node[1::2] += 1
        gap = np.maximum(np.maximum(low[node] - x[at], x[at] - high[node]), 0.0)
        inside = (gap * gap).sum(1) <= reach[at] * (1 + 1e-9)
        inside &= np.isfinite(low[node, 0])
        at, node = at[inside], node[inside]
    return at, node


def _bounded(x: np.ndarray, reach: np.ndarray, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """reach; where it is infinite, the farthest corner of the smallest node around the leaf that holds `most` rows."""
    reach, node = reach.copy(), leaf.copy()
    open_ = np.flatnonzero(np.isinf(reach))
    while len(open_):
        enough = rows[node[open_]] >= most
        done = open_[enough]
        gap = np.maximum(np.abs(x[done] - low[node[done]]), np.abs(high[node[done]] - x[done]))
        reach[done] = (gap * gap).sum(1)
        open_ = open_[~enough]
        open_ = open_[node[open_] > 1]
        node[open_] //= 2
    return reach


def _nearest_points(x: np.ndarray, y: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and squared distance of the `most` nearest rows of each query, ties to smaller ids.

    y: distinct points in the order of their first ids; ids: each one's smallest ids, padded at the end by the largest long.
    """
    none, found = np.iinfo(np.int64).max, []
    for at in range(0, len(x), SLICE):
        part = x[at : at + SLICE]
        d2 = np.zeros((len(part), len(y)))
        for i in range(y.shape[1]):
            d2 += np.square(part[:, i][:, None] - y[:, i][None, :])
        take = min(most, len(y))
        near = np.tile(np.arange(len(y)), (len(part), 1))
        if take < len(y):
            near = np.argpartition(d2, take - 1, axis=1)[:, :take]
            last = np.take_along_axis(d2, near, 1).max(1)
            tied = np.flatnonzero((d2 <= last[:, None]).sum(1) > take)
            near[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :take]
        far = np.repeat(np.take_along_axis(d2, near, 1), ids.shape[1], axis=1)
        own = ids[near].reshape(len(part), -1)
        far[own == none] = np.inf
        order = np.lexsort((own, far), axis=1)[:, :most]
        far, own = np.take_along_axis(far, order, 1), np.take_along_axis(own, order, 1)
        row, col = np.nonzero(np.isfinite(far))
        found.append((at + row, own[row, col], far[row, col]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _by_leaves(queries: DataFrame, data: DataFrame, k: int, d: int, skip_self: bool) -> DataFrame:
    """knn() of finite vectors of d dimensions: id and v of both. Ids are the data's keys."""
    spark, most = data.sparkSession, k + skip_self
    # of equal vectors only the smallest ids can be anyone's neighbours
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    points = data.withColumn("r", first).where(F.col("r") <= most).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points, asked = stored(points, "points"), stored(queries.select("v").distinct().withColumn("row", F.monotonically_increasing_id()), "asked")
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id long, id long, d2 double, rk int")
    depth = max(1, int(np.ceil(np.log2(max(1, min(MOST_LEAVES, n / LEAF))))))
    share = min(1.0, CUT_POINTS * 2.0**depth / n)
    some = points.select("v").sample(share, 7).limit(2 * CUT_POINTS << depth).toPandas()["v"]  # cuts only: every point is in a leaf
    axis, cut = _cuts(np.stack(some.to_numpy()) if len(some) else np.zeros((0, d)), depth)

    def in_leaves(t: DataFrame) -> DataFrame:
        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in (f for f in frames if len(f)):
                yield f.assign(leaf=_leaf(np.stack(f["v"].to_numpy()), axis, cut))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)
        return t.mapInPandas(place, f"{kinds}, leaf long")

    points, asked = stored(in_leaves(points), "leaves"), stored(in_leaves(asked), "asked")
    low, high, rows = np.full((2 << depth, d), np.inf), np.full((2 << depth, d), -np.inf), np.zeros(2 << depth, np.int64)
    ends = [f(F.col("v")[i]) for f in (F.min, F.max) for i in range(d)]
    for r in points.groupBy("leaf").agg(F.sum(F.size("ids")), *ends).collect():  # a row a leaf
        rows[r[0]], low[r[0]], high[r[0]] = r[1], r[2 : 2 + d], r[2 + d :]
    for node in range((1 << depth) - 1, 0, -1):
        two = slice(2 * node, 2 * node + 2)
        rows[node], low[node], high[node] = rows[two].sum(), low[two].min(0), high[two].max(0)

    def met(visits: DataFrame) -> DataFrame:
        """row, id, d2: the nearest rows of each leaf that a query visits; visits: row, v, leaf."""
        tasks = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("tasks"))
        tasks = F.broadcast(spark.createDataFrame(tasks.toPandas(), "leaf long, tasks int"))  # a row a leaf
        left = visits.join(tasks, "leaf").withColumn("task", F.pmod(F.xxhash64("row"), F.col("tasks")).cast("int")).drop("tasks")
        right = points.join(tasks, "leaf").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

        def near(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"row": [], "id": [], "d2": []})
            ids = np.full((len(b), b["ids"].map(len).max()), np.iinfo(np.int64).max)
            for i, own in enumerate(b["ids"]):
                ids[i, : len(own)] = own
            turn = np.argsort(ids[:, 0], kind="stable")
            at, found, d2 = _nearest_points(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())[turn], ids[turn], most)
            return pd.DataFrame({"row": a["row"].to_numpy()[at], "id": found, "d2": d2})

        return stored(left.groupBy("leaf", "task").cogroup(right.groupBy("leaf", "task")).applyInPandas(near, "row long, id long, d2 double"), "near")

    own = met(asked)
    reach = own.groupBy("row").agg(F.when(F.count(F.lit(1)) >= most, F.max("d2")).alias("reach"))
    reach = asked.join(reach, "row", "left").select("row", "v", "leaf", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f for f in frames if len(f)):
            x, leaf = np.stack(f["v"].to_numpy()), f["leaf"].to_numpy()
            at, node = _reached(x, _bounded(x, f["reach"].to_numpy(), leaf, low, high, rows, most), low, high)
            other = node != leaf[at]
            yield pd.DataFrame({"row": f["row"].to_numpy()[at[other]], "v": f["v"].to_numpy()[at[other]], "leaf": node[other]})

    also = met(stored(reach.mapInPandas(visit, "row long, v array<double>, leaf long"), "visits"))
    best = own.unionByName(also).groupBy("row").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id"))), 1, most).alias("near"))
    near = queries.select(F.col("id").alias("query_id"), "v").join(asked.join(best, "row").select("v", "near"), "v")
    kept = F.filter("near", lambda e: ~e["id"].eqNullSafe(F.col("query_id"))) if skip_self else F.col("near")
    found = near.select("query_id", F.posexplode(F.slice(kept, 1, k)).alias("at", "e"))
    return found.select("query_id", F.col("e.id").alias("id"), F.col("e.d2").alias("d2"), (F.col("at") + 1).alias("rk"))


#: Weights of neighbours by rank rk, squared distance d2 and k.
WEIGHTS = {
    "uniform": lambda rk, d2, k: F.lit(1.0),
    "inverse_rank": lambda rk, d2, k: F.lit(1.0) / rk,
    "linear_rank": lambda rk, d2, k: F.lit(float(k + 1)) - rk,
    "inverse_distance": lambda rk, d2, k: F.lit(1.0) / (d2 + F.lit(1e-6)),
    "gaussian": lambda rk, d2, k: F.exp(-d2 / F.lit(2.0)),
}


def knn_predict(neighbours: DataFrame, targets: DataFrame, id_col: str, y: str, k: int, weights: str = "uniform") -> DataFrame:
    """query_id, prediction: the weighted mean of the neighbours' targets."""
    w = WEIGHTS[weights](F.col("rk").cast("double"), F.col("d2"), k)
    joined = neighbours.join(targets.select(F.col(id_col).alias("id"), F.col(y).cast("double").alias("y")), "id")
    return joined.groupBy("query_id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"))


def auto_k(neighbours: DataFrame, targets: DataFrame, id_col: str, y: str) -> DataFrame:
    """k, r2 for each k: how well the mean of the first k neighbours predicts the query's own target."""
    t = targets.select(F.col(id_col).alias("id"), F.col(y).cast("double").alias("y"))
    joined = neighbours.join(t, "id").join(t.select(F.col("id").alias("query_id"), F.col("y").alias("own")), "query_id")
    running = F.avg("y").over(W.partitionBy("query_id").orderBy("rk").rowsBetween(W.unboundedPreceding, 0))
    rows = joined.select("rk", "own", running.alias("p"))
    return rows.groupBy(F.col("rk").alias("k")).agg((F.lit(1.0) - F.sum((F.col("own") - F.col("p")) ** 2) / (F.count("own") * F.var_pop("own"))).alias("r2"))


def auto_k_linear(neighbours: DataFrame, targets: DataFrame, id_col: str, y: str) -> DataFrame:
    """k, r2 for each k, the neighbours weighted by linear rank: k for the nearest, 1 for the k-th."""
    t = targets.select(F.col(id_col).alias("id"), F.col(y).cast("double").alias("y"))
    joined = neighbours.join(t, "id").join(t.select(F.col("id").alias("query_id"), F.col("y").alias("own")), "query_id")
    upto = W.partitionBy("query_id").orderBy("rk").rowsBetween(W.unboundedPreceding, 0)
    k = F.col("rk")
    p = ((k + 1) * F.sum("y").over(upto) - F.sum(k * F.col("y")).over(upto)) / (k * (k + 1) / F.lit(2.0))
    rows = joined.select("rk", "own", p.alias("p"))
    return rows.groupBy(F.col("rk").alias("k")).agg((F.lit(1.0) - F.sum((F.col("own") - F.col("p")) ** 2) / (F.count("own") * F.var_pop("own"))).alias("r2"))


def auto_k_predict(neighbours: DataFrame, targets: DataFrame, id_col: str, y: str) -> DataFrame:
    """query_id, prediction: the mean of the first k neighbours for the k of largest R2, the least of several; the mean of
    all targets where no k has a positive R2."""
    best = auto_k(neighbours, targets, id_col, y).orderBy(F.col("r2").desc(), "k").first()
    if best is None or best["r2"] is None or best["r2"] <= 0:
        mean = targets.agg(F.avg(F.col(y).cast("double"))).first()[0]
        return neighbours.select("query_id").distinct().withColumn("prediction", F.lit(mean))
    return knn_predict(neighbours.where(F.col("rk") <= best["k"]), targets, id_col, y, best["k"])


def softmax_weights(neighbours: DataFrame, gamma: float) -> DataFrame:
    """neighbours with weight: softmax of -gamma * d2 over each query's neighbours."""
    over = W.partitionBy("query_id")
    e = F.exp(-F.lit(gamma) * (F.col("d2") - F.min("d2").over(over)))
    return neighbours.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(over)).drop("e")


def local_model_weights(neighbours: DataFrame, losses: DataFrame) -> DataFrame:
    """query_id, model, weight: 1 / (mean loss of the model on the query's neighbours + 1e-10), normalised per query.

    losses: id, model, loss.
    """
    mean = neighbours.join(losses, "id").groupBy("query_id", "model").agg(F.avg("loss").alias("m"))
    raw = mean.withColumn("raw", F.lit(1.0) / (F.col("m") + F.lit(1e-10)))
    return raw.select("query_id", "model", (F.col("raw") / F.sum("raw").over(W.partitionBy("query_id"))).alias("weight"))


def sign_bits(vector: Column, planes: np.ndarray) -> Column:
    """A signature of the signs of the products with the planes, as a string of bits."""

    @F.pandas_udf("string")
    def bits(column: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, planes.shape[1]))
        return pd.Series(["".join("1" if b else "0" for b in row) for row in x @ planes.T >= 0])

    return bits(vector)
