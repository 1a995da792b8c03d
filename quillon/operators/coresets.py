"""Farthest-first samples: few rows that leave none far away."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import stored

#: Rows of which one task chooses.
TASK_ROWS = 40_000
#: Rows that can be asked for.
MOST = TASK_ROWS // 4
#: Rows that a pass over all rows hands to the driver.
AHEAD = 512
#: Choices after which the rows' distances are written again.
KEPT = 256


def farthest_first_rows(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of min(k, rows) points in order of choice, and each one's distance to those before it (NaN for the first).

    The first has the smallest id, each next one is farthest from all chosen, ties to the smaller id.
    """
    turn = np.argsort(ids, kind="stable")
    points = points[turn]
    left = np.full(len(points), np.inf)
    chosen, far, at = [], [], 0
    for _ in range(min(k, len(points))):
        chosen.append(at)
        far.append(left[at])
        gap = points - points[at]
        left = np.minimum(left, np.sqrt((gap * gap).sum(1)))
        left[at] = -1.0  # a repeated row can be chosen, a chosen one cannot
        at = int(np.argmax(left))
    return turn[chosen], np.where(np.isinf(far), np.nan, far)


def farthest_first(df: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", task_rows: int = TASK_ROWS) -> DataFrame:
    """id, rk (order of choice, from 1), distance (to those chosen before; null for the first) of k rows, or of all if fewer.

    The greedy choice itself, at any size: up to task_rows rows in one task, beyond that by passes over all rows, each
    of which makes one choice or more (`_by_passes`). Every row is then within twice the least radius that k centres
    can have. Rows with a null vector, or one with a null or non-finite component, take no part; repeated rows are rows
    of their own.
    """
    if not 0 < k <= min(MOST, task_rows // 2):
        raise ValueError(f"k must be from 1 to {min(MOST, task_rows // 2)}")
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    rows = df.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    if rows.count() > task_rows:
        return _by_passes(rows, k)

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        at, far = farthest_first_rows(frame["id"].to_numpy(), np.stack(frame["v"].to_numpy()), k)
        return pd.DataFrame({"id": frame["id"].to_numpy()[at], "rk": np.arange(1, len(at) + 1, dtype=np.int32), "distance": pd.Series(far).astype("Float64").where(~np.isnan(far), None)})

    return rows.withColumn("choice", F.lit(0)).groupBy("choice").applyInPandas(last, "id long, rk int, distance double")  # at most task_rows rows


def _by_passes(rows: DataFrame, k: int) -> DataFrame:
    """The greedy choice of k of more rows than one task takes.

    A pass brings every row's distance up to date and hands the AHEAD farthest rows to the driver. Distances only
    shrink, so as long as the farthest of these comes before what the last of them was, no other row can come before
    it, and the choice goes on among them without a pass.
    """
    spark = rows.sparkSession
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("far", F.lit(float("inf"))), "farthest")
    first = rows.orderBy("id", "v", "row").first()
    chosen, points, taken = [(first["id"], 1, None)], [np.array(first["v"])], [first["row"]]
    kept = 0  # choices that the stored distances know of

    def measured(near: np.ndarray, numbers: list[int]) -> DataFrame:
        sent = spark.sparkContext.broadcast((near, np.array(numbers)))

        def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, gone = sent.value
            for f in (f for f in frames if len(f)):
                x, far = np.stack(f["v"].to_numpy()), f["far"].to_numpy().copy()
                for c in centres:
                    gap = x - c
                    far = np.minimum(far, np.sqrt((gap * gap).sum(1)))
                far[np.isin(f["row"].to_numpy(), gone)] = -1.0
                yield f.assign(far=far)

        return rows.mapInPandas(measure, rows.schema)

    while len(chosen) < k:
        if len(chosen) - kept >= KEPT:
            rows, kept = stored(measured(np.array(points[kept:]), taken[kept:]), "farthest"), len(chosen)
        now = measured(np.array(points[kept:]).reshape(-1, len(points[0])), taken[kept:])
        found = now.orderBy(F.col("far").desc(), "id", "v", "row").limit(AHEAD).collect()
        ids, x, far = np.array([r["id"] for r in found]), np.array([r["v"] for r in found]), np.array([r["far"] for r in found])
        bound, whole = (-far[-1], ids[-1]), len(found) < AHEAD
        while len(chosen) < k:
            at = int(np.lexsort((np.arange(len(ids)), ids, -far))[0])
            if not whole and (-far[at], ids[at]) > bound:
                break  # a row that was not handed over may come first
            chosen.append((int(ids[at]), len(chosen) + 1, float(far[at])))
            points.append(x[at])
            taken.append(found[at]["row"])
            gap = x - x[at]
            far = np.minimum(far, np.sqrt((gap * gap).sum(1)))
            far[at] = -1.0
    return spark.createDataFrame(chosen, "id long, rk int, distance double")
