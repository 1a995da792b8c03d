"""Local linear models, one a row, from the row's nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import ordered
from quillon.sources.scratch import stored

_LOCAL = "query_id long, n int, prediction double, residual double, spread double"
#: Below this a spread counts as none.
LEAST = 1e-10


def local_fits(df: DataFrame, neighbours: DataFrame, id_col: str, features: Sequence[str], y: str) -> DataFrame:
    """query_id, n, prediction, residual (absolute), spread: each row's least-squares model of its neighbours at the row.

    neighbours: query_id, id, rk of a few nearest rows each (the row itself not among them). spread is the median
    absolute deviation of the neighbours' targets. Features and targets are taken from the row's own, with a ridge of 1e-10 of the
    mean squared term, so that a deficient system has a solution. Rows with a null or non-finite feature or target are
    no neighbours and get no row; one without neighbours gets none either.
    """
    columns = [F.col(f"`{c}`").cast("double") for c in [*features, y]]
    ok = F.lit(True)
    for c in columns:
        ok &= F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))
    rows = df.where(ok).select(F.col(f"`{id_col}`").alias("id"), F.array(*columns[:-1]).alias("x"), columns[-1].alias("y"))
    met = neighbours.join(rows, "id").groupBy("query_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))  # k a row
    own = rows.select(F.col("id").alias("query_id"), "x", "y")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in frame.groupby(frame["ys"].map(len)):
                ys = np.stack(part["ys"].to_numpy())
                xs = np.stack([np.stack(v) for v in part["xs"]]) - np.stack(part["x"].to_numpy())[:, None, :]
                terms = np.concatenate([np.ones((*ys.shape, 1)), xs], axis=2)
                normal = np.einsum("rka,rkb->rab", terms, terms)
                size = normal.shape[1]
                normal += (LEAST * np.trace(normal, axis1=1, axis2=2) / size)[:, None, None] * np.eye(size)
                y = part["y"].to_numpy()
                missed = np.linalg.solve(normal, np.einsum("rka,rk->ra", terms, ys - y[:, None])[..., None])[:, 0, 0]
                spread = np.median(np.abs(ys - np.median(ys, axis=1, keepdims=True)), axis=1)
                yield pd.DataFrame({"query_id": part["query_id"], "n": np.int32(n), "prediction": y + missed, "residual": np.abs(missed), "spread": spread})

    return own.join(met, "query_id").select("query_id", "x", "y", "xs", "ys").mapInPandas(solve, _LOCAL)


def nonlinearity_weights(df: DataFrame, neighbours: DataFrame, id_col: str, features: Sequence[str], y: str, clip: float = 2.5, shift: float = 1.5, power: float = 0.75) -> DataFrame:
    """query_id, weight (sum 1): more for rows that their neighbours' linear model misses by more.

    A row's miss is its residual over its neighbours' spread, or over the median distance of all targets from their
    mean where that spread is none. Misses are clipped to `clip` deviations from their median, shifted to be positive
    and raised to a power; where they hardly differ, weights are equal. Ties and repeated rows are rows of their own.
    """
    fits = stored(local_fits(df, neighbours, id_col, features, y), "local-fits")
    targets = df.join(fits.select(F.col("query_id").alias(id_col)), id_col, "left_semi").select(F.col(f"`{y}`").cast("double").alias("y"))
    mean = targets.agg(F.avg("y")).first()[0]
    if mean is None:
        return fits.select("query_id", F.lit(1.0).alias("weight"))
    overall = ordered.median(targets.select(F.abs(F.col("y") - F.lit(mean)).alias("d")), "d")
    scale = F.when(F.col("spread") > LEAST, F.col("spread")).otherwise(F.lit(overall)) + F.lit(LEAST)
    missed = stored(fits.select("query_id", (F.col("residual") / scale).alias("miss")), "local-misses")
    middle = ordered.median(missed, "miss")
    deviation = ordered.median(missed.select(F.abs(F.col("miss") - F.lit(middle)).alias("d")), "d")
    if deviation < LEAST:
        return missed.select("query_id", F.lit(1.0 / missed.count()).alias("weight"))
    held = F.greatest(F.lit(-clip * deviation), F.least(F.lit(clip * deviation), F.col("miss") - F.lit(middle)))
    raw = missed.select("query_id", F.pow(F.greatest(held + F.lit(shift * deviation), F.lit(LEAST)), F.lit(power)).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0]
    return raw.select("query_id", (F.col("raw") / F.lit(total)).alias("weight"))
