"""A library of trees by their semantics, and crossover that looks at residuals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def normalised(vector: Column) -> Column:
    """Centred and scaled to length 1; a constant vector becomes zeros."""
    v = vector.cast("array<double>")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    centred = F.transform(F.array(F.struct(v.alias("v"), mean.alias("m"))), lambda b: F.transform(b["v"], lambda x: x - b["m"]))[0]
    length = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(centred, lambda x: x / length)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def nearest_trees(library: DataFrame, query: Sequence[float], k: int, max_size: int | None = None) -> DataFrame:
    """tree, distance, sign of the k trees nearest to the query or to its negative, both centred; smaller trees first on ties.

    library: tree, size, semantics (array).
    """
    q = np.asarray(query, np.float64) - np.mean(query)
    q = q / (np.linalg.norm(q) or 1.0)
    dot = F.aggregate(F.zip_with(normalised(F.col("semantics")), F.lit(q.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = library if max_size is None else library.where(F.col("size") <= max_size)
    found = rows.select("tree", "size", F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * F.abs(dot), F.lit(0.0))).alias("distance"), F.when(dot >= 0, 1).otherwise(-1).alias("sign"))
    return found.orderBy("distance", "size", "tree").limit(k)


def evict(library: DataFrame, keep: int, by: str = "used") -> DataFrame:
    """The `keep` trees used most often (by = "used") or added last (by = "added")."""
    return library.orderBy(F.col(by).desc(), "size", "tree").limit(keep)


def smallest_per_semantics(library: DataFrame, digits: int = 9) -> DataFrame:
    """One tree, the smallest, of those whose normalised semantics agree to `digits` digits."""
    finger = F.xxhash64(F.transform(normalised(F.col("semantics")), lambda x: F.rint(x * 10.0**digits).cast("long")))
    first = F.row_number().over(W.partitionBy("__f").orderBy("size", "tree"))
    return library.withColumn("__f", finger).withColumn("__r", first).where("__r = 1").drop("__f", "__r")


def stage_order(df: DataFrame, columns: Sequence[str], y: str, keep: int) -> list[str]:
    """Columns taken one by one: the one most correlated with what is left of y after regressing out those before it.

    All steps follow from the covariance matrix, one aggregate.
    """
    names = [*columns, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    c = np.zeros((len(names), len(names)))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    weights = np.zeros(len(names))
    weights[-1] = 1.0
    chosen: list[str] = []
    while len(chosen) < min(keep, len(columns)):
        cov = c @ weights
        strength = [abs(cov[i]) / np.sqrt(c[i, i]) if names[i] not in chosen and c[i, i] > 0 else -1.0 for i in range(len(columns))]
        best = int(np.argmax(strength))
        if strength[best] <= 0:
            break
        weights[best] -= cov[best] / c[best, best]
        chosen.append(names[best])
    return chosen
