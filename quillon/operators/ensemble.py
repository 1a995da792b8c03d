"""Ensembles of models: choosing members, combining predictions, archives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .knn import BLOCK

#: Groups of individuals that meet two by two, the bytes of vectors that a group may hold before there are more, tasks, rows of a slice.
NOVELTY_GROUPS = 16
NOVELTY_BYTES = 64 << 20
NOVELTY_TASKS = 4000
NOVELTY_SLICE = 256


def combine(columns: Sequence[str], how: str = "mean", weights: Sequence[float] | None = None) -> Column:
    """Row-wise mean, median, weighted mean, std (population), lower (mean - std) or upper (mean + std)."""
    cols = [F.col(f"`{c}`").cast("double") for c in columns]
    n = float(len(cols))
    mean = reduce(lambda a, b: a + b, cols) / F.lit(n)
    if how == "mean":
        return mean
    if how == "weighted":
        total = sum(weights)
        return reduce(lambda a, b: a + b, (F.lit(w / total) * c for w, c in zip(weights, cols, strict=True)))
    if how == "median":
        ordered = F.array_sort(F.array(*cols))
        half = len(cols) // 2
        return F.get(ordered, F.lit(half)) if len(cols) % 2 else (F.get(ordered, F.lit(half - 1)) + F.get(ordered, F.lit(half))) / F.lit(2.0)
    std = F.sqrt(reduce(lambda a, b: a + b, ((c - mean) * (c - mean) for c in cols)) / F.lit(n))
    return {"std": std, "lower": mean - std, "upper": mean + std}[how]


def greedy(df: DataFrame, columns: Sequence[str], y: str, size: int, replacement: bool = True) -> list[str]:
    """Members added one by one, each time the one that makes the mean prediction's squared error least.

    All errors follow from the products of the predictions and y, taken in one pass.
    """
    names = [*columns, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*(F.sum(F.col(f"`{names[i]}`").cast("double") * F.col(f"`{names[j]}`").cast("double")).alias(f"s{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((len(names), len(names)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
    counts, chosen = np.zeros(len(columns)), []
    while len(chosen) < size:
        best, least = None, np.inf
        for i in range(len(columns)):
            if not replacement and counts[i]:
                continue
            w = counts.copy()
            w[i] += 1
            v = np.append(w / w.sum(), -1.0)
            error = float(v @ g @ v)
            if error < least - 1e-12 * abs(least if np.isfinite(least) else 0):
                best, least = i, error
        if best is None:
            break
        counts[best] += 1
        chosen.append(columns[best])
    return chosen


def drep_weights(df: DataFrame, columns: Sequence[str], y: str, rho: float = 0.3) -> dict[str, float]:
    """Equal weights over members picked by error and diversity: first the best; then, of the rho share of the rest
    most different from the ensemble's mean, the one that lowers its error most; until none does."""
    chosen: list[str] = []
    mse = lambda names: df.agg(F.avg((combine(names) - F.col(y)) ** 2)).first()[0]
    singles = df.agg(*(F.avg((F.col(c) - F.col(y)) ** 2).alias(c) for c in columns)).first().asDict()
    chosen.append(min(columns, key=lambda c: (singles[c], c)))
    error = singles[chosen[0]]
    while len(chosen) < len(columns):
        rest = [c for c in columns if c not in chosen]
        mean = combine(chosen)
        apart = df.agg(*(F.avg((F.col(c) - mean) ** 2).alias(c) for c in rest)).first().asDict()
        near = sorted(rest, key=lambda c: (-apart[c], c))[: max(1, int(rho * len(rest) + 0.999))]
        trial = {c: mse([*chosen, c]) for c in near}
        best = min(near, key=lambda c: (trial[c], c))
        if trial[best] >= error:
            break
        chosen.append(best)
        error = trial[best]
    return {c: (1.0 / len(chosen) if c in chosen else 0.0) for c in columns}


def hall_of_fame(population: DataFrame, k: int) -> DataFrame:
    """The k individuals of least fitness, ties to the smaller id."""
    return population.orderBy("fitness", "ind_id").limit(k)


def novelty_groups(n: int, width: int) -> int:
    return max(1, min(NOVELTY_GROUPS, -(-n // BLOCK)), -(-n * 8 * width // NOVELTY_BYTES))


def dominated_novelty(population: DataFrame, vector: str, k: int) -> DataFrame:
    """ind_id, novelty: mean cosine distance to the k nearest among fitter individuals; infinite for those without one.

    Fitter is a lower fitness, or the same with a smaller id. Rows are dealt to groups, any two of which meet in one
    task that gives each row its k nearest at most, so no pair of individuals leaves a task. Groups are NOVELTY_GROUPS
    until they reach NOVELTY_BYTES, so up to then a row travels to as many tasks at any size; distances are
    quadratic by nature. Vectors that are null, zero or not finite have no distance: they are nobody's neighbours and
    have none.
    """
    rows = population.select("ind_id", F.col("fitness").cast("double").alias("f"), F.col(f"`{vector}`").alias("v")).where("f IS NOT NULL AND NOT isnan(f) AND v IS NOT NULL")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    groups = novelty_groups(n, width)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("ind_id"), F.lit(groups)).cast("int"))
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), "g", "ind_id", "f", "v")
    dealt = met.repartition(min(groups * (groups + 1) // 2, NOVELTY_TASKS), "a", "b")  # by pairs of groups, whatever their bytes: the work is in the distances

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["g"] == frame["a"]
        sides = [frame[own], frame[~own]] if len(frame) and (frame["a"] != frame["b"]).iloc[0] else [frame]
        sides = [_directed(side).sort_values(["f", "ind_id"], kind="stable") for side in sides]
        return pd.concat([_nearest_fitter(x, y, k) for x, y in zip(sides, sides[::-1], strict=True)], ignore_index=True)

    kind = population.schema["ind_id"].dataType.simpleString()
    found = dealt.groupBy("a", "b").applyInPandas(near, f"ind_id {kind}, other {kind}, d double")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("ind_id").orderBy("d", "other"))).where(F.col("r") <= k)
    mean = best.groupBy("ind_id").agg(F.avg("d").alias("novelty"))
    return population.select("ind_id").distinct().join(mean, "ind_id", "left").select("ind_id", F.coalesce("novelty", F.lit(float("inf"))).alias("novelty"))


def _nearest_fitter(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """ind_id, other, d: of each row of a its k nearest of b's fitter rows, ties to the smaller id; both in order of f and ind_id, directed."""
    out = [pd.DataFrame({"ind_id": a["ind_id"].iloc[:0], "other": b["ind_id"].iloc[:0], "d": np.zeros(0)})]
    if not len(a) or not len(b):
        return out[0]
    # how many of b come before each row of a
    both = pd.concat([a[["f", "ind_id"]].assign(of_b=0), b[["f", "ind_id"]].assign(of_b=1)], ignore_index=True).sort_values(["f", "ind_id", "of_b"], kind="stable")
    ahead = np.cumsum(both["of_b"].to_numpy())[(both["of_b"] == 0).to_numpy()]
    x, y, ids, others = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), a["ind_id"].to_numpy(), b["ind_id"].to_numpy()
    by_id = np.argsort(np.argsort(others, kind="stable"), kind="stable")
    for at in range(0, len(x), NOVELTY_SLICE):
        first = ahead[at : at + NOVELTY_SLICE]
        end = int(first[-1])  # rows of b beyond are fitter than none of these
        if not end:
            continue
        d = 1.0 - x[at : at + NOVELTY_SLICE] @ y[:end].T
        for i in np.flatnonzero(first < end):
            d[i, first[i] :] = np.inf
        take = min(end, k)
        part = np.argpartition(d, take - 1, axis=1)[:, :take]
        last = np.take_along_axis(d, part, 1).max(1)
        for i in np.flatnonzero(((d <= last[:, None]).sum(1) > take) & np.isfinite(last)):  # as near as the last: the smaller ids
            part[i] = np.lexsort((by_id[:end], d[i]))[:take]
        far = np.take_along_axis(d, part, 1)
        row, col = np.nonzero(np.isfinite(far))
        out.append(pd.DataFrame({"ind_id": ids[at + row], "other": others[part[row, col]], "d": far[row, col]}))
    return pd.concat(out, ignore_index=True)


def _directed(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows whose vector has a direction, with the vector at length 1."""
    vectors = [np.asarray(v, np.float64) for v in rows["v"]]
    length = np.array([np.sqrt(v @ v) for v in vectors], np.float64)
    good = np.isfinite(length) & (length > 0)
    return rows[good].assign(v=[v / n for v, n, g in zip(vectors, length, good, strict=True) if g])
