"""Complexity and generalisation measures of predictions and features, as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def tikhonov(df: DataFrame, prediction: str) -> DataFrame:
    """One row: the Euclidean norm of the predictions."""
    return df.agg(F.sqrt(F.sum(F.col(prediction) * F.col(prediction))).alias("tikhonov"))


def _sign(row_id: str, r: int, seed: int) -> Column:
    return F.when(F.xxhash64(row_id, F.lit(r), F.lit(seed)).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def rademacher(df: DataFrame, loss: str, row_id: str, rounds: int = 50, seed: int = 3) -> DataFrame:
    """One row: the mean over rounds of |mean of sign * loss|, signs by hash; all rounds in one pass."""
    sums = df.agg(*(F.abs(F.avg(_sign(row_id, r, seed) * F.col(loss))).alias(f"r{r}") for r in range(rounds)))
    total = sum((F.col(f"r{r}") for r in range(rounds)), F.lit(0.0))
    return sums.select((total / F.lit(float(rounds))).alias("rademacher"))


def sharpness(df: DataFrame, prediction: Column, perturbed: Sequence[Column], how: str = "max") -> DataFrame:
    """One row: the mean over rows of the largest (or mean) squared change of the prediction under perturbations."""
    gaps = [(prediction - p) * (prediction - p) for p in perturbed]
    row = F.greatest(*gaps) if how == "max" and len(gaps) > 1 else sum(gaps, F.lit(0.0)) / F.lit(float(len(gaps)))
    return df.agg(F.avg(row).alias("sharpness"))


def kl_term(norm: float, sigma: float, n: int, delta: float = 0.1) -> float:
    """4 * sqrt((|w|^2 / (2 sigma^2) + ln(2 n / delta)) / n)."""
    return 4 * math.sqrt((norm * norm / (2 * sigma * sigma) + math.log(2 * n / delta)) / n)


def igci(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """One row: the mean of ln |dy / dx| over neighbours in order of x, after scaling both to 0..1; steps of 0 are left out."""
    lo_x, hi_x, lo_y, hi_y = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    unit = df.select(((F.col(x) - F.lit(lo_x)) / F.lit((hi_x - lo_x) or 1.0)).alias("x"), ((F.col(y) - F.lit(lo_y)) / F.lit((hi_y - lo_y) or 1.0)).alias("y"), F.col(tie).alias("tie"))
    steps = ordered.with_previous(unit, "x", "y", "tie").select((F.col("x") - F.col("x1")).alias("dx"), (F.col("y") - F.col("y1")).alias("dy")).where("dx <> 0 AND dy <> 0")
    return steps.agg(F.avg(F.ln(F.abs(F.col("dy") / F.col("dx")))).alias("igci"))


def cv_gap(df: DataFrame, y: str, train: str, cross: str) -> DataFrame:
    """One row: mean squared errors of the training and the cross-validated predictions, and their difference."""
    err = lambda p: F.avg((F.col(y) - F.col(p)) ** 2)
    return df.agg(err(train).alias("train"), err(cross).alias("cross"), (err(cross) - err(train)).alias("gap"))
