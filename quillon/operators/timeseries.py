"""Time-series operators over (series, time, value) tables; windows are per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _by(series: Sequence[str], time: str):
    return W.partitionBy(*series).orderBy(time)


def lags(df: DataFrame, series: Sequence[str], time: str, y: str, k: int) -> DataFrame:
    """df with lag_1 .. lag_k, without the rows that lack one."""
    by = _by(series, time)
    return df.withColumns({f"lag_{i}": F.lag(y, i).over(by) for i in range(1, k + 1)}).where(F.col(f"lag_{k}").isNotNull())


def increments(df: DataFrame, series: Sequence[str], time: str, y: str) -> DataFrame:
    """df with increment, the difference to the value before; null at the start."""
    return df.withColumn("increment", F.col(y) - F.lag(y).over(_by(series, time)))


def interpolate(df: DataFrame, series: Sequence[str], time: str, y: str, k: int) -> DataFrame:
    """The rows with k points on the straight line to the next row inserted after each: series, time, step (0..k), value."""
    by = _by(series, time)
    step = df.select(*series, time, y, F.lead(y).over(by).alias("__next"))
    points = step.withColumn("step", F.explode(F.when(F.col("__next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(k)))))
    return points.select(*series, time, "step", F.when(F.col("step") == 0, F.col(y)).otherwise(F.col(y) + (F.col("__next") - F.col(y)) * F.col("step") / F.lit(float(k + 1))).alias("value"))


def reconstruct(df: DataFrame, series: Sequence[str], time: str, increment: str, start: Column) -> DataFrame:
    """df with value: start plus the running sum of the increments, null ones as 0."""
    upto = _by(series, time).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("value", start + F.sum(F.coalesce(F.col(increment), F.lit(0.0))).over(upto))


def moving_average(df: DataFrame, series: Sequence[str], time: str, y: str, width: int) -> DataFrame:
    return df.withColumn("moving_average", F.avg(y).over(_by(series, time).rowsBetween(1 - width, 0)))


def running_moments(df: DataFrame, series: Sequence[str], time: str, y: str) -> DataFrame:
    """df with the mean and the population variance of all values so far."""
    upto = _by(series, time).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"running_mean": F.avg(y).over(upto), "running_var": F.var_pop(y).over(upto)})


def forecast(last: DataFrame, coefficients: Sequence[float], intercept: float, horizon: int, values: str = "lags") -> DataFrame:
    """df with forecast: `horizon` values, each a linear model of the ones before (values: an array, latest first)."""
    w = F.lit([float(c) for c in coefficients])
    k = len(coefficients)

    def step(state: Column, _: Column) -> Column:
        window = F.slice(state, 1, k)
        nxt = F.aggregate(F.zip_with(window, w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, x: s + x)
        return F.concat(F.array(nxt), state)

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col(values).cast("array<double>"), step)
    return last.withColumn("forecast", F.reverse(F.slice(whole, 1, horizon)))
