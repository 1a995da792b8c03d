"""Learnt metrics for nearest neighbours: projections in which distances follow the differences of a target.

What these need are sums over all pairs of rows, and no pair is ever a row. Fourth moments of pair differences follow
from the rows' own fourth moments. Sums with |dy| come from the order of y: rows are dealt by ranges of y, a task folds
its range with running sums, and two ranges meet as products of their sums. Sums with a similarity exp(-gamma dy^2)
come from its Fourier series, whose terms are products of two rows' sines and cosines, so one aggregate a frequency is
enough. A solve is on matrices of the features' side, on the driver, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import knn, linear
from quillon.sources.scratch import stored

#: Features that a metric takes: their fourth moments are FEATURES^4 / 4 numbers.
MAX_FEATURES = 64
SLICE = 4096


@dataclass(frozen=True)
class Projection:
    """Standardised features times a matrix of one row a feature."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    matrix: tuple[tuple[float, ...], ...]

    def column(self) -> Column:
        """The projected row as an array; null where a feature is null or not finite."""
        x = [(F.col(f"`{f}`").cast("double") - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.means, self.scales, strict=True)]
        sums = [sum((F.lit(w[j]) * v for w, v in zip(self.matrix, x, strict=True)), F.lit(0.0)) for j in range(len(self.matrix[0]))]
        return F.when(_finite(self.features), F.array(*sums))

    def importance(self) -> dict[str, float]:
        """Each feature's share of the squared matrix."""
        w = (np.array(self.matrix) ** 2).sum(1)
        return dict(zip(self.features, (w / max(w.sum(), 1e-300)).tolist(), strict=True))


def _finite(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        ok &= F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # NaN is above infinity in Spark's order
    return ok


def _standard(df: DataFrame, features: Sequence[str], y: str) -> tuple[DataFrame, int, np.ndarray, np.ndarray, float, float, float, float]:
    """x (array) and y of the rows that are finite, y less its mean; rows, means, scales (1 for constants), y's mean, deviation, least and largest."""
    if not 0 < len(features) <= MAX_FEATURES:
        raise ValueError(f"a metric takes 1 to {MAX_FEATURES} features")
    rows = df.where(_finite([*features, y])).select(*(F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(f"`{y}`").cast("double").alias("y"))
    names = [f"x{i}" for i in range(len(features))] + ["y"]
    r = rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), *(F.avg(c) for c in names), *(F.stddev_pop(c) for c in names)).first()
    n, k = r[0], len(features)
    if n < 2:
        raise ValueError("a metric needs two rows with finite features and target")
    means, scales = np.array(r[3 : 4 + k]), np.array(r[4 + k :])
    scales = np.where(scales > 1e-12 * np.maximum(1.0, np.abs(means)), scales, 1.0)
    x = F.array(*((F.col(f"x{i}") - F.lit(float(means[i]))) / F.lit(float(scales[i])) for i in range(k)))
    centre = float(means[k])
    return rows.select(x.alias("x"), (F.col("y") - F.lit(centre)).alias("y")), n, means[:k], scales[:k], centre, float(r[-1]), r[1] - centre, r[2] - centre


def _terms(x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1, the features and their products, by row."""
    return np.concatenate([np.ones((len(x), 1)), x, x[:, pairs[0]] * x[:, pairs[1]]], axis=1)


def _met(f: np.ndarray, g: np.ndarray, k: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Products of differences, from two sides' sums of terms: f is one side's, g the other's."""
    a, b = pairs[0] + 1, pairs[1] + 1
    return f[..., k + 1 :] * g[..., :1] - f[..., a] * g[..., b] - f[..., b] * g[..., a] + f[..., :1] * g[..., k + 1 :]


@dataclass(frozen=True)
class PairMoments:
    """Means over pairs of different rows, of standardised features' differences d.

    fourth: of d_a d_b d_c d_e, by pairs (a <= b) and (c <= e); target: of d_a d_b |dy|; pairs: a and b of each.
    """

    rows: int
    means: np.ndarray
    scales: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]
    fourth: np.ndarray
    target: np.ndarray


def pair_moments(df: DataFrame, features: Sequence[str], y: str) -> PairMoments:
    """Moments over all pairs of rows; rows with a null or non-finite feature or target take no part."""
    rows, n, means, scales, *_ = _standard(df, features, y)
    k = len(features)
    pairs = np.triu_indices(k)
    size = len(pairs[0])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain, weighted = np.zeros(1 + k + size), np.zeros(1 + k + size)
        cross, fourth = np.zeros(size), np.zeros((size, size))
        lo, hi = None, None
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                x, t = np.stack(frame["x"].to_numpy()[at : at + SLICE]), frame["y"].to_numpy()[at : at + SLICE]
                lo, hi = t[0] if lo is None else lo, t[-1]
                u = _terms(x, pairs)
                v = u * t[:, None]
                before_u, before_v = plain + np.cumsum(u, axis=0) - u, weighted + np.cumsum(v, axis=0) - v
                cross += (_met(v, before_u, k, pairs) - _met(u, before_v, k, pairs)).sum(0)
                fourth += u[:, k + 1 :].T @ u[:, k + 1 :]
                plain, weighted = plain + u.sum(0), weighted + v.sum(0)
        if lo is not None:
            yield pd.DataFrame({"i": [-1], "lo": [lo], "hi": [hi], "values": [np.concatenate([plain, weighted, cross]).tobytes()]})
            yield pd.DataFrame({"i": np.arange(size), "lo": lo, "hi": hi, "values": [row.tobytes() for row in fourth]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(v) for v in frame["values"]), np.zeros(size))
        return pd.DataFrame({"i": frame["i"].iloc[:1], "values": [total.tobytes()]})

    dealt = rows.repartitionByRange("y", F.xxhash64("x")).sortWithinPartitions("y")
    folded = stored(dealt.mapInPandas(fold, "i int, lo double, hi double, values binary"), "pair-moments")
    ranges = folded.where("i < 0").orderBy("lo", "hi").collect()  # a row a range
    fourth = np.zeros((size, size))
    for r in folded.where("i >= 0").groupBy("i").applyInPandas(added, "i int, values binary").collect():
        fourth[r["i"]] = np.frombuffer(r["values"])
    plain, weighted, cross = np.zeros(1 + k + size), np.zeros(1 + k + size), np.zeros(size)
    for r in ranges:
        u, v, own = np.split(np.frombuffer(r["values"]), [1 + k + size, 2 * (1 + k + size)])
        cross += own + _met(v, plain, k, pairs) - _met(u, weighted, k, pairs)
        plain, weighted = plain + u, weighted + v
    second = np.zeros((k, k))
    second[pairs] = plain[k + 1 :]
    second = second + np.triu(second, 1).T
    a, b = pairs
    same = np.outer(second[a, b], second[a, b]) + second[np.ix_(a, a)] * second[np.ix_(b, b)] + second[np.ix_(a, b)] * second[np.ix_(b, a)]
    ordered = n * (n - 1.0)
    return PairMoments(n, means, scales, pairs, (2.0 * n * fourth + 2.0 * same) / ordered, 2.0 * cross / ordered)


def learnt_metric(df: DataFrame, features: Sequence[str], y: str, dimensions: int | None = None, ridge: float = 1e-5) -> Projection:
    """The projection whose squared distances are nearest, in squares over all pairs, to the target's differences.

    The metric is a ridge regression on products of differences, made positive semidefinite by dropping negative
    eigenvalues; its largest `dimensions` (all by default) are kept. Where none is positive, features stay as they are.
    """
    m = pair_moments(df, features, y)
    twice = np.where(m.pairs[0] == m.pairs[1], 1.0, 2.0)
    solved = np.linalg.lstsq(m.fourth * np.outer(twice, twice) + ridge * np.diag(twice), m.target * twice, rcond=None)[0]
    k = len(features)
    metric = np.zeros((k, k))
    metric[m.pairs] = solved
    metric = metric + np.triu(metric, 1).T
    values, vectors = np.linalg.eigh(metric)
    order = np.argsort(values)[::-1][: dimensions or k]
    w = vectors[:, order] * np.sqrt(np.maximum(values[order], 0.0))
    if not (w != 0).any():
        w = np.eye(k)[:, : dimensions or k]
    return _projection(features, m.means, m.scales, w)


def _projection(features: Sequence[str], means: np.ndarray, scales: np.ndarray, w: np.ndarray) -> Projection:
    return Projection(tuple(features), tuple(means.tolist()), tuple(scales.tolist()), tuple(tuple(row) for row in w.tolist()))


def partial_least_squares(df: DataFrame, features: Sequence[str], y: str, dimensions: int | None = None) -> Projection:
    """The scores of partial least squares with one target, found on one Gram matrix by deflating it."""
    k = len(features)
    g = linear.gram(df.where(_finite([*features, y])), features, y)
    n = g[0, 0]
    if n < 2:
        raise ValueError("a projection needs two rows with finite features and target")
    mean, y_mean = g[0, 1 : k + 1] / n, g[0, k + 1] / n
    xx, xy = g[1 : k + 1, 1 : k + 1] / n - np.outer(mean, mean), g[1 : k + 1, k + 1] / n - mean * y_mean
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
    scale = np.where(scale > 1e-9 * np.maximum(1.0, np.abs(mean)), scale, 1.0)
    xx, xy = xx / np.outer(scale, scale), xy / scale
    least, weights, loadings = 1e-10 * np.linalg.norm(xy), [], []
    for _ in range(dimensions or k):
        norm = np.linalg.norm(xy)
        if norm <= least:
            break
        w = xy / norm
        length = w @ xx @ w
        if length <= 1e-12:
            break
        p = xx @ w / length
        weights.append(w)
        loadings.append(p)
        xx, xy = xx - length * np.outer(p, p), xy - p * (w @ xy)
    if not weights:
        return _projection(features, mean, scale, np.eye(k)[:, : dimensions or k])
    w, p = np.stack(weights, axis=1), np.stack(loadings, axis=1)
    return _projection(features, mean, scale, w @ np.linalg.inv(p.T @ w))


def _frequencies(gamma: float, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies f and weights c with sum of c cos(f t) = exp(-gamma t^2) for |t| <= span, to about 1e-12."""
    step = 2.0 * np.pi / (span + 5.5 / np.sqrt(gamma))
    f = np.arange(0, int(np.ceil(11.0 * np.sqrt(gamma) / step)) + 1) * step
    c = step / np.sqrt(np.pi * gamma) * np.exp(-f * f / (4.0 * gamma))
    c[0] /= 2.0
    return f, c


def similarity_moments(df: DataFrame, features: Sequence[str], y: str, gamma: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """X'SX and X'DX of standardised features, S = exp(-gamma dy^2) over all pairs of rows, D its row sums; means, scales.

    gamma: 1 / variance of y by default. Frequencies grow with y's range over its deviation (about 30 for 10).
    """
    rows, _, means, scales, _, deviation, lo, hi = _standard(df, features, y)
    gamma = gamma or 1.0 / max(deviation * deviation, 1e-300)
    f, c = _frequencies(gamma, hi - lo)
    k, pairs = len(features), np.triu_indices(len(features))
    width = 1 + k + len(pairs[0])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(f), width))
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                u = _terms(np.stack(frame["x"].to_numpy()[at : at + SLICE]), pairs)
                angle = np.outer(f, frame["y"].to_numpy()[at : at + SLICE])
                total += np.stack([np.cos(angle) @ u, np.sin(angle) @ u])
        yield pd.DataFrame({"i": np.arange(len(f)), "values": [total[:, i].tobytes() for i in range(len(f))]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "values": [sum((np.frombuffer(v) for v in frame["values"]), np.zeros(2 * width)).tobytes()]})

    near, degrees = np.zeros((k, k)), np.zeros(len(pairs[0]))
    for r in rows.mapInPandas(fold, "i int, values binary").groupBy("i").applyInPandas(added, "i int, values binary").collect():  # a row a frequency
        for s in np.frombuffer(r["values"]).reshape(2, width):
            near += c[r["i"]] * np.outer(s[1 : k + 1], s[1 : k + 1])
            degrees += c[r["i"]] * s[0] * s[k + 1 :]
    whole = np.zeros((k, k))
    whole[pairs] = degrees
    return near, whole + np.triu(whole, 1).T, means, scales


def locality_preserving(df: DataFrame, features: Sequence[str], y: str, dimensions: int | None = None, gamma: float | None = None, ridge: float = 1e-8) -> Projection:
    """The projection that keeps rows of similar targets together: least w'X'(D - S)Xw for w'X'DXw = 1."""
    near, whole, means, scales = similarity_moments(df, features, y, gamma)
    k = len(features)
    root = np.linalg.cholesky(whole + max(ridge, 1e-12) * max(np.trace(whole), 1.0) / k * np.eye(k))
    inverse = np.linalg.inv(root)
    values, vectors = np.linalg.eigh(inverse @ (whole - near) @ inverse.T)
    order = np.argsort(values)[: dimensions or max(1, k - 1)]
    w = inverse.T @ vectors[:, order]
    return _projection(features, means, scales, w / np.linalg.norm(w[:, 0]))


PROJECTIONS = {"learnt": learnt_metric, "pls": partial_least_squares, "lpp": locality_preserving}


def adaptive_k(df: DataFrame, y: str) -> int:
    """20 neighbours for targets of at most 50 values, 5 for others."""
    return 20 if df.select(F.col(f"`{y}`")).distinct().limit(51).count() <= 50 else 5


def projected_predict(queries: DataFrame, data: DataFrame, projection: Projection, y: str, id_col: str, k: int = 5, weights: str = "uniform", skip_self: bool = True) -> DataFrame:
    """query_id, prediction: the weighted mean of the k nearest rows' targets, by the projection.

    Rows with a null or non-finite feature or a null target are no one's neighbours; queries with one get no row.
    """
    q = queries.select(F.col(f"`{id_col}`").alias("id"), projection.column().alias("v")).where("v IS NOT NULL")
    d = data.where(F.col(f"`{y}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), projection.column().alias("v"), F.col(f"`{y}`").cast("double").alias("target")).where("v IS NOT NULL")
    near = knn.knn(q, d, k, "id", "v", skip_self)
    return knn.knn_predict(near, d, "id", "target", k, weights)


def ridge_boosted_predict(queries: DataFrame, data: DataFrame, features: Sequence[str], y: str, id_col: str, kind: str = "learnt", k: int | None = None, alpha: float = 1.0, weights: str = "uniform", skip_self: bool = True) -> DataFrame:
    """query_id, prediction: a ridge's, plus the mean residual of the nearest rows in a projection learnt on residuals.

    kind: a name of PROJECTIONS. k: adaptive_k by default. A query without neighbours gets the ridge's alone.
    """
    usable = data.where(_finite([*features, y]))
    model = linear.ridge(usable, features, y, alpha)
    names = [F.col(f"`{c}`") for c in dict.fromkeys([id_col, *features])]
    rest = usable.select(*names, (F.col(f"`{y}`").cast("double") - model.column()).alias("__residual"))
    projection = PROJECTIONS[kind](rest, features, "__residual")
    near = projected_predict(queries, rest, projection, "__residual", id_col, k or adaptive_k(data, y), weights, skip_self)
    base = queries.where(_finite(features)).select(F.col(f"`{id_col}`").alias("query_id"), model.column().alias("base"))
    return base.join(near, "query_id", "left").select("query_id", (F.col("base") + F.coalesce("prediction", F.lit(0.0))).alias("prediction"))
