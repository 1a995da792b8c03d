"""Layers of mutually non-dominated rows, and the survivors that NSGA-II and NSGA-III take from them.

A row dominates another if it is no worse (greater) in any objective and better in one. Layer 0 has the rows that none
dominates, layer k those that only rows of layers below k dominate.

Rows are cut into sectors by the direction in which they lie from the best corner, since rows in one direction dominate
each other most. A row's layer within any part of the rows is at most its layer among all, so after every sector has
been layered by itself, the first layers of all rows are found among the first layers of the sectors: rounds take as
many layers as fit into MERGED rows, layer those rows together, and go on with the rest. No pair of rows is ever a row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.operators.ordered import with_neighbours
from quillon.sources.scratch import stored

#: Rows of a sector, about; a sector with more is cut by a hash of the key.
SECTOR_ROWS = 20_000
#: Rows that are layered together in one task, a tenth of it beyond three objectives; more are thinned by blocks of so many rows.
MERGED = 200_000


def layer_array(values: np.ndarray, upto: int | None = None) -> np.ndarray:
    """The layer of each row of a matrix of objectives; -1 for rows beyond the first `upto` layers."""
    n, m = values.shape
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    distinct, inverse = np.unique(values, axis=0, return_inverse=True)  # in lexicographic order: nothing dominates what is before it
    inverse = inverse.reshape(-1)
    if m == 1:
        found = np.arange(len(distinct))
    elif m == 2:
        found = np.empty(len(distinct), np.int64)
        last: list[float] = []  # of each layer the least second objective, which falls from layer to layer
        for i, second in enumerate((-distinct[:, 1]).tolist()):
            k = _first_below(last, second)
            found[i] = k
            if k == len(last):
                last.append(second)
            else:
                last[k] = second
    elif m == 3:
        found = _layers_by_staircases(distinct)
    else:
        found = _layers_by_insertion(distinct)
    if upto is not None:
        found = np.where(found < upto, found, -1)
    return found[inverse]


def _first_below(last: list[float], second: float) -> int:
    """The first layer whose least second objective is greater; `last` has them negated, in ascending order."""
    lo, hi = 0, len(last)
    while lo < hi:
        mid = (lo + hi) // 2
        if last[mid] < second:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _layers_by_staircases(rows: np.ndarray) -> np.ndarray:
    """As _layers_by_insertion for three objectives: of each layer the rows that matter in the second and third, as a
    staircase, so that one bisection says whether any of the layer dominates."""
    out = np.empty(len(rows), np.int64)
    steps: list[tuple[list[float], list[float]]] = []
    for i, (second, third) in enumerate(rows[:, 1:].tolist()):
        lo, hi = 0, len(steps)
        while lo < hi:
            mid = (lo + hi) // 2
            at = bisect_right(steps[mid][0], second)
            if at and steps[mid][1][at - 1] <= third:
                lo = mid + 1
            else:
                hi = mid
        if lo == len(steps):
            steps.append(([], []))
        seconds, thirds = steps[lo]
        at = upto = bisect_left(seconds, second)
        while upto < len(thirds) and thirds[upto] >= third:
            upto += 1
        seconds[at:upto], thirds[at:upto] = [second], [third]
        out[i] = lo
    return out


def _layers_by_insertion(rows: np.ndarray) -> np.ndarray:
    """Rows in lexicographic order, each put into the first layer that has no row dominating it, by bisection over layers."""
    out = np.empty(len(rows), np.int64)
    members: list[np.ndarray] = []
    sizes: list[int] = []
    rest = np.ascontiguousarray(rows[:, 1:])  # the first objective is no worse in all that came before
    for i, row in enumerate(rest):
        lo, hi = 0, len(members)
        while lo < hi:
            mid = (lo + hi) // 2
            if (members[mid][: sizes[mid]] <= row).all(axis=1).any():
                lo = mid + 1
            else:
                hi = mid
        if lo == len(members):
            members.append(np.empty((8, rest.shape[1])))
            sizes.append(0)
        elif sizes[lo] == len(members[lo]):
            members[lo] = np.concatenate([members[lo], np.empty_like(members[lo])])
        members[lo][sizes[lo]] = row
        sizes[lo] += 1
        out[i] = lo
    return out


def _sectors(rows: DataFrame, names: Sequence[str], n: int) -> DataFrame:
    """rows with __part: sectors by direction from the best corner, cut by a hash of the key where they are large."""
    wanted = max(1, -(-n // SECTOR_ROWS))
    axes = min(len(names) - 1, 2)
    each = max(1, round(wanted ** (1 / max(1, axes))))
    spans = rows.agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(names)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(names))).first()
    low, high = ([spans[f"{k}{i}"] for i in range(len(names))] for k in ("lo", "hi"))
    unit = [(F.col(c) - F.lit(a)) / F.lit((b - a) or 1.0) for c, a, b in zip(names, low, high, strict=True)]
    # every edge is a quantile of an angle, so their number follows the number of sectors, not the rows
    angled = rows.withColumns({f"__angle{k}": F.atan2(F.sqrt(sum((u * u for u in unit[k + 1 :]), F.lit(0.0))), unit[k]) for k in range(axes)})
    part = F.lit(0)
    if each > 1 and axes:
        cuts = angled.agg(*(F.percentile_approx(f"__angle{k}", F.array(*(F.lit(i / each) for i in range(1, each))), F.lit(10 * each)).alias(f"c{k}") for k in range(axes))).first()
        for k in range(axes):
            at = sum((F.when(F.col(f"__angle{k}") > F.lit(e), 1).otherwise(0) for e in cuts[k]), F.lit(0))
            part = part * each + at
    cut = angled.select(*rows.columns, part.cast("int").alias("__sector"))
    sizes = cut.groupBy("__sector").agg(F.ceil(F.count(F.lit(1)) / (2 * SECTOR_ROWS)).cast("int").alias("__splits"))  # a row a sector
    salted = cut.join(F.broadcast(sizes), "__sector")
    return salted.withColumn("__part", F.struct("__sector", F.pmod(F.xxhash64("__key"), F.col("__splits")).alias("split"))).drop("__sector", "__splits")


def _layered(rows: DataFrame, names: Sequence[str], group: str | None, upto: int | None) -> DataFrame:
    """rows (__key and objectives) with __own: the layer within the rows of the group."""
    schema = T.StructType([*(rows.schema[c] for c in ("__key", *names)), T.StructField("__own", T.IntegerType())])

    def own(frame):
        return frame[["__key", *names]].assign(__own=layer_array(frame[list(names)].to_numpy(np.float64), upto).astype(np.int32))

    if group is None:
        rows, group = rows.withColumn("__all", F.lit(0)), "__all"
    return rows.groupBy(group).applyInPandas(own, schema)


def _thinned(rows: DataFrame, names: Sequence[str], block: int) -> DataFrame:
    """The rows that none dominates: each block of the rows in turn, MERGED at most, is held against all that are left."""
    blocks = -(-rows.count() // block)
    numbered = stored(rows.withColumn("__block", F.pmod(F.xxhash64("__key"), F.lit(blocks))), "pareto-blocks")
    left = numbered
    for b in range(blocks):
        own = np.array([[r[c] for c in names] for r in left.where(F.col("__block") == b).select(*names).collect()], np.float64).reshape(-1, len(names))
        edge = own[layer_array(own, 1) == 0]

        def undominated(batches, edge=edge):
            for frame in batches:
                values = frame[list(names)].to_numpy(np.float64)
                worse = [((edge <= v).all(1) & (edge < v).any(1)).any() for v in values]
                yield frame[~np.array(worse, bool)]

        left = stored(left.mapInPandas(undominated, left.schema), "pareto-left")
    return left.drop("__block")


def layers(df: DataFrame, objectives: Sequence[str], key: str, upto: int | None = None, enough: int | None = None) -> DataFrame:
    """key and layer (from 0) of every row, smaller objectives being better; key tells rows apart.

    upto: the number of layers wanted; enough: stop after the layer with which so many rows are found. Rows beyond have
    no row in the result. Rows with equal objectives share a layer. A row with a null or NaN objective dominates nothing and
    is dominated by nothing comparable: it gets a null layer. An empty table gives none.
    """
    names = [f"__o{i}" for i in range(len(objectives))]
    rows = df.select(F.col(f"`{key}`").alias("__key"), *(F.col(f"`{o}`").cast("double").alias(n) for o, n in zip(objectives, names, strict=True)))
    bad = F.lit(False)
    for n in names:
        bad |= F.col(n).isNull() | F.isnan(n)
    odd = rows.where(bad).select("__key", F.lit(None).cast("int").alias("layer"))
    rows = stored(rows.where(~bad), "pareto-rows")
    merged = MERGED if len(names) <= 3 else max(1, MERGED // 10)
    out, done, found, left = [], 0, 0, rows.count()
    while left and (upto is None or done < upto) and (enough is None or found < enough):
        if left <= merged:
            first = _layered(rows, names, None, None if upto is None else upto - done).where("__own >= 0")
            taken = stored(first.select("__key", (F.col("__own") + done).alias("layer")), "pareto-layers")
            rest, step = None, None
        else:
            own = stored(_layered(_sectors(rows, names, left), names, "__part", None), "pareto-own")
            counts = [r["count"] for r in own.groupBy("__own").count().orderBy("__own").collect()]  # a row a layer
            step, size = 1, counts[0]
            while step < len(counts) and size + counts[step] <= merged:
                size, step = size + counts[step], step + 1
            if upto is not None:
                step = min(step, upto - done)
            some = own.where(F.col("__own") < step).select("__key", *names)
            if size > merged:  # the first layers of the sectors alone are too many for one task
                first = _thinned(some, names, merged).select("__key", F.lit(0).alias("__own"))
            else:
                first = _layered(some, names, None, step).where("__own >= 0")
            taken = stored(first.select("__key", (F.col("__own") + done).alias("layer")), "pareto-layers")
            rest = own.select("__key", *names).join(taken.select("__key"), "__key", "left_anti")
        out.append(taken)
        found += taken.count()
        if rest is None:
            break
        rows, done = stored(rest, "pareto-rows"), done + step
        left = rows.count()
    result = odd
    for t in out:
        result = result.unionByName(t)
    if enough is not None:
        last = [r for r in result.where("layer IS NOT NULL").groupBy("layer").count().orderBy("layer").collect()]  # a row a layer
        upper, total = None, 0
        for r in last:
            if total >= enough:
                break
            upper, total = r["layer"], total + r["count"]
        result = result.where(F.col("layer").isNull() | (F.col("layer") <= F.lit(upper)))
    return result.select(F.col("__key").alias(key), "layer")


def crowding(df: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """key and crowding of the rows of one layer: per objective the distance between the neighbours in its order over
    its range and the number of objectives, summed; infinite at the ends of any. Ties are in order of key."""
    spans = df.agg(*(F.max(f"`{o}`").alias(f"hi{i}") for i, o in enumerate(objectives)), *(F.min(f"`{o}`").alias(f"lo{i}") for i, o in enumerate(objectives))).first()
    total = None
    for i, o in enumerate(objectives):
        width = ((spans[f"hi{i}"] or 0.0) - (spans[f"lo{i}"] or 0.0)) * len(objectives) or 1.0
        near = with_neighbours(df.select(F.col(f"`{o}`").cast("double").alias("x"), F.col(f"`{key}`").alias("key")), "x", "key", ["x"], back=1, ahead=1)
        part = near.select(F.col("key").alias(key), F.coalesce((F.col("x_1") - F.col("x_-1")) / F.lit(width), F.lit(float("inf"))).alias(f"c{i}"))
        total = part if total is None else total.join(part, key)
    return total.select(key, sum((F.col(f"c{i}") for i in range(len(objectives))), F.lit(0.0)).alias("crowding"))


def nsga2(df: DataFrame, objectives: Sequence[str], key: str, n: int) -> DataFrame:
    """The n survivors of df with layer and, for the layer that is taken in part, crowding: whole layers in order, of
    the last one the least crowded, ties to the smaller key. Rows with a null or NaN objective survive only none."""
    chosen = stored(layers(df, objectives, key, enough=n).where("layer IS NOT NULL"), "nsga2")
    counts = {r["layer"]: r["count"] for r in chosen.groupBy("layer").count().collect()}  # a row a layer
    split, before = max(counts, default=0), sum(counts.values()) - counts.get(max(counts, default=0), 0)
    if sum(counts.values()) <= n:
        return df.join(chosen.withColumn("crowding", F.lit(None).cast("double")), key)
    edge = df.join(chosen.where(F.col("layer") == split).select(key), key)
    ranked = crowding(edge, objectives, key).orderBy(F.col("crowding").desc(), key).limit(n - before)
    part = chosen.join(ranked, key)
    return df.join(chosen.where(F.col("layer") < split).withColumn("crowding", F.lit(None).cast("double")).unionByName(part), key)


def reference_points(n_objectives: int, divisions: int = 4) -> list[tuple[float, ...]]:
    """The points of a regular lattice on the simplex: all shares of `divisions` equal parts among the objectives."""
    out = []
    for bars in combinations(range(divisions + n_objectives - 1), n_objectives - 1):
        edges = (-1, *bars, divisions + n_objectives - 1)
        out.append(tuple((b - a - 1) / divisions for a, b in zip(edges, edges[1:], strict=False)))
    return out


def nsga3(df: DataFrame, objectives: Sequence[str], key: str, n: int, divisions: int = 4) -> DataFrame:
    """The n survivors of df with layer, niche and distance: whole layers in order; the last one is filled niche by niche.

    Objectives are scaled by the least and greatest values of the layers at hand. Every row belongs to the reference
    line through the origin that it is nearest to (distance). From the last layer the niche with the fewest survivors
    gives its next row, nearest first (ties to the smaller key), again and again, ties to the niche first in the lattice.
    """
    chosen = stored(layers(df, objectives, key, enough=n).where("layer IS NOT NULL"), "nsga3")
    rows = df.join(chosen, key)
    spans = rows.agg(*(F.max(f"`{o}`").alias(f"hi{i}") for i, o in enumerate(objectives)), *(F.min(f"`{o}`").alias(f"lo{i}") for i, o in enumerate(objectives))).first()
    unit = [(F.col(f"`{o}`").cast("double") - F.lit(spans[f"lo{i}"] or 0.0)) / F.lit(((spans[f"hi{i}"] or 0.0) - (spans[f"lo{i}"] or 0.0)) or 1.0) for i, o in enumerate(objectives)]
    square = sum((u * u for u in unit), F.lit(0.0))
    lines = []
    for k, p in enumerate(reference_points(len(objectives), divisions)):
        along = sum((u * F.lit(w) for u, w in zip(unit, p, strict=True)), F.lit(0.0))
        away = F.sqrt(F.greatest(square - along * along / F.lit(sum(w * w for w in p)), F.lit(0.0)))
        lines.append(F.struct(F.round(away, 12).alias("distance"), F.lit(k).alias("niche")))
    placed = stored(rows.withColumn("__l", F.array_min(F.array(*lines))).select(*rows.columns, "__l.niche", "__l.distance"), "nsga3-niches")
    split = placed.agg(F.max("layer")).first()[0]
    total = placed.count()
    if split is None or total <= n:
        return placed
    held = {r["niche"]: r["count"] for r in placed.where(F.col("layer") < split).groupBy("niche").count().collect()}  # a row a niche
    there = {r["niche"]: r["count"] for r in placed.where(F.col("layer") == split).groupBy("niche").count().collect()}
    quota = _fill({k: held.get(k, 0) for k in there}, there, n - sum(held.values()))
    quotas = df.sparkSession.createDataFrame(list(quota.items()), "niche int, __quota int")
    place = F.row_number().over(W.partitionBy("niche").orderBy("distance", key))
    last = placed.where(F.col("layer") == split).withColumn("__place", place).join(F.broadcast(quotas), "niche").where(F.col("__place") <= F.col("__quota"))
    return placed.where(F.col("layer") < split).unionByName(last.drop("__place", "__quota").select(*placed.columns))


def _fill(held: dict[int, int], there: dict[int, int], n: int) -> dict[int, int]:
    """How many each niche gives when the one with the fewest gives next, ties to the smaller number."""
    import heapq

    queue = [(c, k) for k, c in held.items()]
    heapq.heapify(queue)
    given = dict.fromkeys(there, 0)
    for _ in range(min(n, sum(there.values()))):
        count, k = heapq.heappop(queue)
        given[k] += 1
        if given[k] < there[k]:
            heapq.heappush(queue, (count + 1, k))
    return given
