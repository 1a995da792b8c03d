"""Linear models from one Gram aggregate.

All sums x_i x_j and x_i y that a solution needs come from a single pass over the rows; the solve is on the driver, on
a matrix whose side is the number of features plus one. Folds are hashes of the row id, and a fold's training sums are
the total less its own, so cross-validation is the same single pass grouped by fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ordered


def _sums(features: Sequence[str], y: str, weight: Column | None = None) -> list[Column]:
    one = F.lit(1.0)
    terms = [one, *(F.col(f"`{f}`").cast("double") for f in features), F.col(f"`{y}`").cast("double")]
    w = one if weight is None else weight
    return [F.sum(w * terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]


def _matrix(row, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def gram(df: DataFrame, features: Sequence[str], y: str, weight: Column | None = None) -> np.ndarray:
    """Sums of products of (1, features, y)."""
    return _matrix(df.agg(*_sums(features, y, weight)).first(), len(features) + 2)


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def column(self) -> Column:
        """The prediction."""
        terms = (F.lit(c) * F.col(f"`{f}`").cast("double") for f, c in zip(self.features, self.coefficients, strict=True))
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def shap(self, means: dict[str, float]) -> dict[str, Column]:
        """Each feature's share of a prediction: coefficient * (x - mean)."""
        return {f: F.lit(c) * (F.col(f"`{f}`").cast("double") - F.lit(means[f])) for f, c in zip(self.features, self.coefficients, strict=True)}


def solve_ridge(g: np.ndarray, features: Sequence[str], alpha: float) -> LinearModel:
    """Ridge on centred features, the intercept not penalised."""
    n, k = g[0, 0], len(features)
    mean, y_mean = g[0, 1 : k + 1] / n, g[0, k + 1] / n
    xx = g[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean)
    xy = g[1 : k + 1, k + 1] - n * mean * y_mean
    w = np.linalg.lstsq(xx + alpha * np.eye(k), xy, rcond=None)[0]
    return LinearModel(tuple(features), float(y_mean - mean @ w), tuple(float(v) for v in w))


def ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, weight: Column | None = None) -> LinearModel:
    return solve_ridge(gram(df, features, y, weight), features, alpha)


def loo_predictions(df: DataFrame, features: Sequence[str], y: str, alphas: Sequence[float] = (0.1, 1.0, 10.0)) -> tuple[DataFrame, float]:
    """df with loo, every row's prediction by the ridge of all other rows, and the alpha of least squared LOO error.

    The error of row i is e_i / (1 - h_i), with its leverage h_i as a quadratic form of the row; all alphas are
    compared in one pass.
    """
    g = gram(df, features, y)
    n, k = g[0, 0], len(features)
    mean = g[0, 1 : k + 1] / n
    xx = g[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean)
    centred = [F.col(f"`{f}`").cast("double") - F.lit(float(m)) for f, m in zip(features, mean, strict=True)]

    def error(alpha: float) -> Column:
        inverse = np.linalg.pinv(xx + alpha * np.eye(k))
        quad = [centred[i] * centred[j] * F.lit(float(inverse[i, j])) for i in range(k) for j in range(k)]
        leverage = reduce(lambda a, b: a + b, quad, F.lit(1.0 / n))
        return (F.col(f"`{y}`") - solve_ridge(g, features, alpha).column()) / (F.lit(1.0) - leverage)

    errors = [error(a) for a in alphas]
    sums = df.agg(*(F.sum(e * e).alias(f"e{i}") for i, e in enumerate(errors))).first()
    best = min(range(len(alphas)), key=lambda i: sums[i])
    return df.withColumn("loo", F.col(f"`{y}`") - errors[best]), alphas[best]


def fold_of(row_id: str, folds: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{row_id}`"), F.lit(seed)), F.lit(folds)).cast("int")


def cross_val_predict(df: DataFrame, features: Sequence[str], y: str, fold: Column, alpha: float = 1.0) -> DataFrame:
    """df with fold and cv, every row's prediction by the ridge of the other folds; folds: whole numbers, few."""
    folded = df.withColumn("fold", fold)
    rows = folded.groupBy("fold").agg(*_sums(features, y)).collect()
    parts = {r["fold"]: _matrix(r, len(features) + 2) for r in rows}
    total = sum(parts.values())
    models = {f: solve_ridge(total - own, features, alpha).column() for f, own in parts.items()}
    choice = reduce(lambda c, f: c.when(F.col("fold") == f, models[f]), models, F.when(F.lit(False), F.lit(0.0)))
    return folded.withColumn("cv", choice)


def ood_folds(df: DataFrame, y: str, folds: int = 5) -> Column:
    """Folds as quantile bins of the target, so each is outside the others' range."""
    edges = [e for e in ordered.quantiles(df, y, [i / folds for i in range(1, folds)]).values() if e is not None] if folds > 1 else []
    return ordered.bin_of(F.col(f"`{y}`").cast("double"), edges).cast("int")


def r2_drop(df: DataFrame, features: Sequence[str], y: str) -> dict[str, float]:
    """How much R2 falls without each feature: (1 - R2) t^2 / (t^2 + n - p - 1), with t from the Gram matrix."""
    g = gram(df, features, y)
    n, k = g[0, 0], len(features)
    mean, y_mean = g[0, 1 : k + 1] / n, g[0, k + 1] / n
    xx = g[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean)
    xy = g[1 : k + 1, k + 1] - n * mean * y_mean
    total = g[k + 1, k + 1] - n * y_mean**2
    inverse = np.linalg.pinv(xx)
    w = inverse @ xy
    residual = total - w @ xy
    r2, free = 1 - residual / total, n - k - 1
    t2 = w**2 / (residual / free * np.diag(inverse))
    return {f: float((1 - r2) * v / (v + n - k - 1)) for f, v in zip(features, t2, strict=True)}


def forward_selection(df: DataFrame, features: Sequence[str], y: str, keep: int, alpha: float = 1.0) -> list[str]:
    """Features added one by one, each time the one whose ridge has the least squared error; all from one Gram matrix."""
    g, chosen = gram(df, features, y), []
    at = {f: i + 1 for i, f in enumerate(features)}

    def error(names: list[str]) -> float:
        idx = [0, *(at[f] for f in names), len(features) + 1]
        part = g[np.ix_(idx, idx)]
        m = solve_ridge(part, names, alpha)
        beta = np.array([-m.intercept, *(-c for c in m.coefficients), 1.0])
        return float(beta @ part @ beta)

    while len(chosen) < min(keep, len(features)):
        chosen.append(min((f for f in features if f not in chosen), key=lambda f: error([*chosen, f])))
    return chosen


def leaf_ridge(df: DataFrame, leaf: str, features: Sequence[str], y: str, alpha: float = 1.0) -> DataFrame:
    """df with leaf_pred: a ridge per leaf; the leaves' models are a table joined back, solved from one aggregate by leaf."""
    sums = df.groupBy(leaf).agg(*_sums(features, y))
    k = len(features) + 2

    def solve(batches):
        import pandas as pd

        for frame in batches:
            models = [solve_ridge(_matrix(r, k), features, alpha) for _, r in frame.iterrows()]
            yield pd.DataFrame({"__leaf": frame[leaf], "__b": [m.intercept for m in models], "__w": [list(m.coefficients) for m in models]})

    kind = dict(df.dtypes)[leaf]
    models = sums.mapInPandas(solve, f"__leaf {kind}, __b double, __w array<double>")
    joined = df.join(models, df[leaf] == models["__leaf"], "left").drop("__leaf")
    terms = (F.get("__w", F.lit(i)) * F.col(f"`{f}`").cast("double") for i, f in enumerate(features))
    return joined.withColumn("leaf_pred", reduce(lambda a, b: a + b, terms, F.col("__b"))).drop("__b", "__w")


def bounded(prediction: Column, df: DataFrame, y: str) -> Column:
    """The prediction kept between the least and the greatest training target."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    return F.greatest(F.least(prediction, F.lit(high)), F.lit(low))


def linear_scaling(df: DataFrame, x: str, y: str) -> LinearModel:
    """Slope and intercept of y on one column."""
    row = df.agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
    return LinearModel((x,), float(row[1] or 0.0), (float(row[0] or 0.0),))
