"""Fit-then-transform scalers: parameters from one aggregate, then a projection with literals."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.primitives import sanitise
from quillon.operators import ordered


@dataclass(frozen=True)
class Scaler:
    """Fitted scaling of some columns; apply(df) replaces them, or adds them with a suffix."""

    expressions: dict[str, Callable[[Column], Column]]

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: f(F.col(f"`{c}`").cast("double")) for c, f in self.expressions.items()})


def _stats(df: DataFrame, columns: Sequence[str], **stats: Callable[[Column], Column]) -> dict[str, dict[str, float]]:
    row = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{c}\x00{s}") for c in columns for s, f in stats.items())).first()
    return {c: {s: row[f"{c}\x00{s}"] for s in stats} for c in columns}


def _affine(shift: float | None, scale: float | None) -> Callable[[Column], Column]:
    shift, scale = shift or 0.0, scale if scale and math.isfinite(scale) else 1.0
    return lambda x: (x - F.lit(shift)) / F.lit(scale)


def _quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float] | None:
    """Exact quantiles from ranks by ranges; nothing for a column without a value."""
    found = list(ordered.quantiles(df, column, at).values())
    return None if found[0] is None else found


def standard(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """(x - mean) / population deviation; a constant column is only centred."""
    s = _stats(df, columns, m=F.avg, d=F.stddev_pop)
    return Scaler({c: _affine(v["m"], v["d"]) for c, v in s.items()})


def min_max(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """(x - min) / (max - min)."""
    s = _stats(df, columns, lo=F.min, hi=F.max)
    return Scaler({c: _affine(v["lo"], (v["hi"] or 0) - (v["lo"] or 0)) for c, v in s.items()})


def robust(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """(x - median) / interquartile range."""
    s = {c: _quantiles(df, c, (0.25, 0.5, 0.75)) for c in columns}
    return Scaler({c: _affine(q[1], q[2] - q[0]) if q else _affine(0, 1) for c, q in s.items()})


def max_abs(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """x / max |x|."""
    s = _stats(df, columns, m=lambda x: F.max(F.abs(x)))
    return Scaler({c: _affine(0, v["m"]) for c, v in s.items()})


def safety(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Standard scaling that only centres where the deviation is at most 1e-10, with NaN and infinities as 0."""
    s = _stats(df, columns, m=F.avg, d=F.stddev_pop)

    def scale(v: dict[str, float]) -> Callable[[Column], Column]:
        f = _affine(v["m"], v["d"] if v["d"] and v["d"] > 1e-10 else 1.0)
        return lambda x: sanitise(f(x))

    return Scaler({c: scale(v) for c, v in s.items()})


def robust_clip(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """z = (x - median) * s, s from the interquartile range, else twice the reciprocal range, else 0; then z / sqrt(1 + (z/3)^2)."""
    s = {c: _quantiles(df, c, (0.0, 0.25, 0.5, 0.75, 1.0)) or [0.0] * 5 for c in columns}

    def scale(q: list[float]) -> Callable[[Column], Column]:
        iqr, span = q[3] - q[1], q[4] - q[0]
        factor = 1 / iqr if iqr > 0 else 2 / span if span > 0 else 0.0

        def f(x: Column) -> Column:
            z = (x - F.lit(q[2])) * F.lit(factor)
            return z / F.sqrt(F.lit(1.0) + (z / F.lit(3.0)) * (z / F.lit(3.0)))

        return f

    return Scaler({c: scale(q) for c, q in s.items()})


def skew(df: DataFrame, columns: Sequence[str], limit: float = 0.5) -> Scaler:
    """Square root where skewness exceeds limit, square where it is below -limit, of the values moved to start at 0."""
    s = _stats(df, columns, k=F.skewness, lo=F.min)

    def f(v: dict[str, float]) -> Callable[[Column], Column]:
        k, lo = v["k"] or 0.0, v["lo"] or 0.0
        if k > limit:
            return lambda x: F.sqrt(F.greatest(x - F.lit(lo), F.lit(0.0)))
        if k < -limit:
            return lambda x: (x - F.lit(lo)) * (x - F.lit(lo))
        return lambda x: x

    return Scaler({c: f(v) for c, v in s.items()})


def sigmoid(df: DataFrame, columns: Sequence[str], edge: float = 1e-3) -> Scaler:
    """Logit of the min-max scaled value, kept from edge to 1 - edge."""
    s = _stats(df, columns, lo=F.min, hi=F.max)

    def f(v: dict[str, float]) -> Callable[[Column], Column]:
        unit = _affine(v["lo"], (v["hi"] or 0) - (v["lo"] or 0))

        def g(x: Column) -> Column:
            p = F.greatest(F.least(unit(x), F.lit(1 - edge)), F.lit(edge))
            return F.ln(p / (F.lit(1.0) - p))

        return g

    return Scaler({c: f(v) for c, v in s.items()})


def bounds(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Clip to the fitted minimum and maximum."""
    s = _stats(df, columns, lo=F.min, hi=F.max)
    return Scaler({c: (lambda x, v=v: F.greatest(F.least(x, F.lit(v["hi"])), F.lit(v["lo"]))) for c, v in s.items()})


def quantile_uniform(df: DataFrame, column: str, quantiles: int = 1000) -> Scaler:
    """The share of the fitted distribution below x, interpolated between quantiles; the number of quantiles is bounded."""
    grid = [i / (quantiles - 1) for i in range(quantiles)]
    found = _quantiles(df, column, grid) or [0.0] * quantiles

    def f(x: Column) -> Column:
        edges = F.lit(found)
        below = F.size(F.filter(edges, lambda e: e <= x))
        low, high = F.get(edges, below - 1), F.get(edges, below)
        inner = (below - 1 + F.try_divide(x - low, high - low)) / F.lit(float(quantiles - 1))
        return F.when(below <= 0, F.lit(0.0)).when(below >= quantiles, F.lit(1.0)).otherwise(inner)

    return Scaler({column: f})


def std_and_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with a standardised and a min-max scaled copy of every column (suffixes _std and _mm)."""
    return min_max(df, columns).apply(standard(df, columns).apply(df, "_std"), "_mm")


def drop_constant(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with more than one value, from one aggregate."""
    s = _stats(df, columns, lo=F.min, hi=F.max)
    return [c for c, v in s.items() if v["lo"] is not None and v["lo"] != v["hi"]]


def column_kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Boolean for exactly 2 distinct values, Categorical for at most 10 that are all whole numbers, else Numerical."""
    s = _stats(df, columns, n=F.count_distinct, broken=lambda x: F.max((x != F.floor(x)).cast("int")))
    return {c: "Boolean" if v["n"] == 2 else "Categorical" if v["n"] <= 10 and not v["broken"] else "Numerical" for c, v in s.items()}


def unscaled(columns: Sequence[str]) -> Scaler:
    """The values as they are."""
    return Scaler({c: (lambda x: x) for c in columns})


def one_hot_standard(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """(x - mean) / population deviation, but columns of zeros and ones stay as they are."""
    s = _stats(df, columns, m=F.avg, d=F.stddev_pop, other=lambda x: F.max((~x.isin(0.0, 1.0)).cast("int")))
    return Scaler({c: _affine(v["m"], v["d"]) if v["other"] else (lambda x: x) for c, v in s.items()})


def whole_targets(df: DataFrame, column: str) -> Scaler:
    """Predictions of a whole-number target: rounded half to even and kept between its fitted least and greatest value."""
    v = _stats(df, [column], lo=F.min, hi=F.max)[column]
    return Scaler({column: lambda x: F.greatest(F.least(F.rint(x), F.lit(v["hi"])), F.lit(v["lo"]))})


def linear_layer(columns: Sequence[Column], weights: Sequence[float], bias: float = 0.0) -> Column:
    """The weighted sum of the columns."""
    return sum((F.lit(float(w)) * c for c, w in zip(columns, weights, strict=True)), F.lit(float(bias)))


def clip(x: Column, low: float, high: float) -> Column:
    """x kept between low and high."""
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))
