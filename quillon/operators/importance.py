"""Feature importance, and choosing columns by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .linear import LinearModel


def ensemble_importance(genes: DataFrame, how: str = "sum") -> DataFrame:
    """gene, importance from (hash, gene, gene_size, coef, weight): |coef| * weight summed (or averaged) per semantic
    hash, named by the hash's smallest gene, and scaled to sum 1."""
    value = F.abs(F.col("coef")) * F.col("weight")
    by_hash = genes.groupBy("hash").agg((F.sum(value) if how == "sum" else F.avg(value)).alias("v"), F.min_by("gene", F.struct("gene_size", "gene")).alias("gene"))
    return by_hash.select("gene", (F.col("v") / F.sum("v").over(W.partitionBy())).alias("importance"))


def top_by_quantile(importance: DataFrame, ratio: float) -> DataFrame:
    """The genes whose importance is at least the (1 - ratio) quantile."""
    edge = importance.agg(F.percentile("importance", F.lit(1 - ratio))).first()[0]
    return importance.where(F.col("importance") >= edge)


def mean_replacement(df: DataFrame, model: LinearModel, y: str) -> DataFrame:
    """feature, importance: how much the mean squared error grows when the column is replaced by its mean."""
    means = df.agg(*(F.avg(f).alias(f) for f in model.features)).first().asDict()
    p = model.column()
    parts = []
    for f, c in zip(model.features, model.coefficients, strict=True):
        moved = p + F.lit(c) * (F.lit(means[f]) - F.col(f))
        parts.append(F.struct(F.lit(f).alias("feature"), (F.avg((F.col(y) - moved) ** 2) - F.avg((F.col(y) - p) ** 2)).alias("importance")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def linear_shap(df: DataFrame, model: LinearModel) -> DataFrame:
    """feature, importance: mean |coefficient * (x - mean)|."""
    means = df.agg(*(F.avg(f).alias(f) for f in model.features)).first().asDict()
    parts = [F.struct(F.lit(f).alias("feature"), F.avg(F.abs(e)).alias("importance")) for f, e in model.shap(means).items()]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def most_redundant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """one, two, r: the pairs of columns by falling |correlation|, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.corr(a, b).alias("r")) for a, b in pairs)).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*").orderBy(F.abs("r").desc(), "one", "two")


def residual_match(df: DataFrame, residual: str, candidates: Sequence[str]) -> DataFrame:
    """column, r of the candidate whose |correlation| with the residual is largest."""
    row = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.corr(residual, c).alias("r")) for c in candidates)).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*").orderBy(F.abs("r").desc(), "column").limit(1)
