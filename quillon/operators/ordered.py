"""Neighbours and ranks in the order of a column, without a window over all rows.

Rows are dealt by ranges of the column and a tie, as many ranges as the session has shuffle partitions, so that ranges
grow in number with the cluster and a hot value is split by the tie. Windows run within a range; what crosses its ends
are a few rows of each range.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.sources.scratch import stored

#: Edges or places up to which plain expressions hold them all.
FEW = 64


def by_range(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """df with part: the number of its range in the order of the columns; stored, so that ranges stay as they are."""
    return stored(df.repartitionByRange(*columns).withColumn("part", F.spark_partition_id()), name)


def with_neighbours(df: DataFrame, x: str, tie: str, values: Sequence[str], back: int = 1, ahead: int = 0) -> DataFrame:
    """df's x, tie and values as they are, with <value>_<k> for k = -back..ahead except 0: the value k rows on.

    Order is by x, then tie, which must tell rows of equal x apart; nulls come first. Where no such row is, null.
    """
    names = list(dict.fromkeys([x, tie, *values]))
    rows = by_range(df.select(*(F.col(f"`{c}`") for c in names)), [x, tie], "ordered")
    order = [F.col(f"`{x}`").asc_nulls_first(), F.col(f"`{tie}`").asc_nulls_first()]
    up = F.row_number().over(W.partitionBy("part").orderBy(*order))
    down = F.row_number().over(W.partitionBy("part").orderBy(*(F.col(f"`{c}`").desc_nulls_last() for c in (x, tie))))
    edges = rows.withColumns({"up": up, "down": down}).where((F.col("up") <= ahead) | (F.col("down") <= back)).collect()  # a few of each range
    parts: dict[int, list] = {}
    for r in edges:
        parts.setdefault(r["part"], []).append(r)
    carried, known = [], sorted(parts)
    for p in known:
        before = [r for q in known if q < p for r in sorted(parts[q], key=lambda r: -r["down"]) if r["down"] <= back]
        after = [r for q in known if q > p for r in sorted(parts[q], key=lambda r: r["up"]) if r["up"] <= ahead]
        carried += [(*(r[c] for c in names), p, True) for r in before[len(before) - back if back < len(before) else 0 :] + after[:ahead]]
    own = rows.withColumn("carried", F.lit(False))
    spread = own.unionByName(df.sparkSession.createDataFrame(carried, own.schema))
    over = W.partitionBy("part").orderBy(*order)
    shifted = [F.lag(c, -k).over(over).alias(f"{c}_{k}") for c in values for k in range(-back, ahead + 1) if k]
    return spread.select("*", *shifted).where("NOT carried").drop("part", "carried")


def with_previous(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """x, y, tie with x1, y1 and x2, y2: the values of the row before and of the one before that, in order of x and tie.

    tie must tell rows of equal x apart. The first rows have nulls; an empty table gives none.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(tie).alias("tie"))
    found = with_neighbours(rows, "x", "tie", ["x", "y"], back=2)
    return found.select("x", "y", "tie", *(F.col(f"{c}_-{k}").alias(f"{c}{k}") for c in "xy" for k in (1, 2)))


def ranks(counts: DataFrame, value: str, n: str) -> DataFrame:
    """counts (one row per value) with upto: how many rows have this value or a smaller one."""
    cut = by_range(counts, [value], "ranks").withColumnRenamed("part", "__b")
    base = cut.groupBy("__b").agg(F.sum(n).alias("__s"))
    base = base.select("__b", (F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__s")).alias("__base"))  # one row a range
    inside = F.sum(n).over(W.partitionBy("__b").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("upto", inside).join(F.broadcast(base), "__b").withColumn("upto", F.col("upto") + F.col("__base")).drop("__b", "__base")


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted edges are at most x: an int; a null x has 0, NaN all. Many edges are searched by halving."""
    if not len(edges):
        return F.lit(0)
    if len(edges) <= FEW:
        return F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: e <= x))
    cuts = np.asarray(edges, np.float64)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy(np.float64), side="right").astype(np.int32))

    return F.when(x.isNull(), F.lit(0)).otherwise(place(x))


def quantiles(df: DataFrame, value: str, wanted: Sequence[float]) -> dict[float, float | None]:
    """Exact quantiles of a column, linear between the two values that each falls between.

    All come from one table of ranks by ranges: no task or buffer holds the column's distinct values. Nulls and NaN do
    not count; a column without a value gives nulls.
    """
    v = F.col(f"`{value}`").cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cut = by_range(counts, ["v"], "quantiles")
    sizes = sorted((r["part"], r["n"]) for r in cut.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a range
    ends = list(accumulate(n for _, n in sizes))
    if not ends:
        return dict.fromkeys(wanted)
    n = ends[-1]
    at = {q: (n - 1) * q for q in wanted}
    places = sorted({p for x in at.values() for p in (int(x) + 1, min(int(x) + 2, n))})
    held = sorted({bisect_left(ends, p) for p in places})
    base = df.sparkSession.createDataFrame([(sizes[i][0], ends[i] - sizes[i][1]) for i in held], "part int, base long")
    # only ranges that hold a place are put in order
    upto = F.col("base") + F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = cut.join(F.broadcast(base), "part").select("v", "n", upto.alias("upto"))
    if len(places) <= FEW:
        found = dict(zip(places, placed.agg(*(F.min(F.when(F.col("upto") >= p, F.col("v"))) for p in places)).first(), strict=True))
    else:  # a value stays if a place falls among its rows, so a row a place comes to the driver at most
        kept = placed.where(bin_of(F.col("upto").cast("double"), places) > bin_of((F.col("upto") - F.col("n")).cast("double"), places))
        rows = kept.select("v", "upto").orderBy("upto").collect()
        reach = [r["upto"] for r in rows]
        found = {p: rows[bisect_left(reach, p)]["v"] for p in places}
    out = {}
    for q, x in at.items():
        low, high = found[int(x) + 1], found[min(int(x) + 2, n)]
        out[q] = low if low == high else low + (high - low) * (x - int(x))
    return out


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    return quantiles(df, value, (q,))[q]


def median(df: DataFrame, value: str) -> float | None:
    """The exact median of a column, the mean of the middle two where rows are even; nulls do not count, none gives null."""
    return quantile(df, value, 0.5)
