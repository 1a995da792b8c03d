"""Categorical encoders, group features, crosses and binning.

A fitted encoder is a table with one row per category that is left-joined to the rows, so its size does not matter:
Spark broadcasts it where it is small. Null is a category of its own in joins; unseen categories get the default named
by each encoder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import ordered


def _look_up(df: DataFrame, table: DataFrame, cat: str, outputs: dict[str, Column | None]) -> DataFrame:
    looked = table.select(F.col(f"`{cat}`").alias("__k"), *outputs)
    joined = df.join(looked, df[f"`{cat}`"].eqNullSafe(looked["__k"]), "left").drop("__k")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in outputs.items() if d is not None})


def codes(df: DataFrame, cat: str) -> DataFrame:
    """Categories in order with code from 0; nulls have none. The window runs over one row per category."""
    found = df.select(f"`{cat}`").where(F.col(f"`{cat}`").isNotNull()).distinct()
    return found.withColumn("code", F.row_number().over(W.orderBy(f"`{cat}`")) - 1)


def ordinal(df: DataFrame, table: DataFrame, cat: str, output: str) -> DataFrame:
    """The category's code; unseen gives -1. table: from codes()."""
    return _look_up(df, table.withColumnRenamed("code", output), cat, {output: F.lit(-1)})


def binary(df: DataFrame, table: DataFrame, cat: str, prefix: str) -> DataFrame:
    """The bits of the code, most significant first: ceil(log2(n + 1)) columns; unseen gives all ones."""
    n = table.count()
    width = max(1, math.ceil(math.log2(n + 1)))
    coded = ordinal(df, table, cat, "__code")
    return coded.withColumns({f"{prefix}{i}": F.shiftright(F.col("__code"), width - 1 - i).bitwiseAND(F.lit(1)) for i in range(width)}).drop("__code")


def one_hot(df: DataFrame, categories: Sequence, cat: str, prefix: str, drop_first: bool = False) -> DataFrame:
    """One 0/1 column per listed category; unseen rows have all 0."""
    chosen = list(categories)[1:] if drop_first else list(categories)
    return df.withColumns({f"{prefix}{c}": F.coalesce((F.col(f"`{cat}`") == F.lit(c)).cast("int"), F.lit(0)) for c in chosen})


def count(train: DataFrame, df: DataFrame, cat: str, output: str) -> DataFrame:
    """How often the category occurs in train; unseen gives 0."""
    return _look_up(df, train.groupBy(f"`{cat}`").agg(F.count(F.lit(1)).alias(output)), cat, {output: F.lit(0)})


def target(train: DataFrame, df: DataFrame, cat: str, y: str, output: str, min_samples: float = 20.0, smoothing: float = 10.0) -> DataFrame:
    """The category's mean of y, shrunk to the mean of all: weight 1 / (1 + exp(-(n - min_samples) / smoothing))."""
    mean = train.agg(F.avg(y)).first()[0]
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.count(F.lit(1)) - F.lit(min_samples)) / F.lit(smoothing)))
    table = train.groupBy(f"`{cat}`").agg((weight * F.avg(y) + (F.lit(1.0) - weight) * F.lit(mean)).alias(output))
    return _look_up(df, table, cat, {output: F.lit(mean)})


def m_estimate(train: DataFrame, df: DataFrame, cat: str, y: str, output: str, m: float = 1.0) -> DataFrame:
    """(sum of y + m * mean) / (n + m)."""
    mean = train.agg(F.avg(y)).first()[0]
    table = train.groupBy(f"`{cat}`").agg(((F.sum(y) + F.lit(m * mean)) / (F.count(F.lit(1)) + F.lit(m))).alias(output))
    return _look_up(df, table, cat, {output: F.lit(mean)})


def james_stein(train: DataFrame, df: DataFrame, cat: str, y: str, output: str) -> DataFrame:
    """(1 - B) * group mean + B * mean of all, B = var(group) / (var(group) + var of all), by sample size n of the group."""
    mean, var = train.agg(F.avg(y), F.var_pop(y)).first()
    own = F.var_pop(y) / F.count(F.lit(1))
    b = F.when(own + F.lit(var) > 0, own / (own + F.lit(var))).otherwise(F.lit(1.0))
    table = train.groupBy(f"`{cat}`").agg(((F.lit(1.0) - b) * F.avg(y) + b * F.lit(mean)).alias(output))
    return _look_up(df, table, cat, {output: F.lit(mean)})


def leave_one_out(df: DataFrame, cat: str, y: str, output: str) -> DataFrame:
    """The mean of y over the category's other rows; the mean of all where it is alone."""
    sums = df.groupBy(f"`{cat}`").agg(F.sum(y).alias("__s"), F.count(F.lit(1)).alias("__n"))
    mean = df.agg(F.avg(y)).first()[0]
    joined = _look_up(df, sums, cat, {"__s": None, "__n": None})
    return joined.withColumn(output, F.when(F.col("__n") > 1, (F.col("__s") - F.col(y)) / (F.col("__n") - 1)).otherwise(F.lit(mean))).drop("__s", "__n")


def ordered_target(df: DataFrame, cat: str, y: str, order: str, output: str, prior_weight: float = 1.0) -> DataFrame:
    """Running mean of y over the category's earlier rows, with the mean of all as prior: (sum + a * mean) / (n + a)."""
    mean = df.agg(F.avg(y)).first()[0]
    before = W.partitionBy(f"`{cat}`").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(output, (F.coalesce(F.sum(y).over(before), F.lit(0.0)) + F.lit(prior_weight * mean)) / (F.count(F.lit(1)).over(before) + F.lit(prior_weight)))


def quantile_target(train: DataFrame, df: DataFrame, cat: str, y: str, output: str, q: float = 0.5, m: float = 1.0) -> DataFrame:
    """The category's quantile of y, shrunk to that of all by n / (n + m)."""
    whole = ordered.quantile(train, y, q)
    n = F.count(F.lit(1))
    table = train.groupBy(f"`{cat}`").agg(((n * F.percentile(F.col(y).cast("double"), F.lit(q)) + F.lit(m * whole)) / (n + F.lit(m))).alias(output))
    return _look_up(df, table, cat, {output: F.lit(whole)})


def hashing(df: DataFrame, cat: str, prefix: str, n: int = 8) -> DataFrame:
    """0/1 columns by the category's CRC-32 modulo n."""
    slot = F.crc32(F.col(f"`{cat}`").cast("string").cast("binary")) % n
    return df.withColumns({f"{prefix}{i}": F.coalesce((slot == i).cast("int"), F.lit(0)) for i in range(n)})


def contrast(df: DataFrame, table: DataFrame, cat: str, prefix: str, kind: str) -> DataFrame:
    """Contrast columns of the code among n categories: sum, helmert, backward_difference or polynomial; unseen gives 0."""
    import numpy as np

    n = table.count()
    coded = ordinal(df, table, cat, "__code")
    rows = np.zeros((n, max(0, n - 1)))
    for j in range(n - 1):
        if kind == "sum":
            rows[j, j], rows[n - 1, j] = 1.0, -1.0
        elif kind == "helmert":
            rows[: j + 1, j], rows[j + 1, j] = -1.0, j + 1.0
        elif kind == "backward_difference":
            rows[: j + 1, j], rows[j + 1 :, j] = -(n - j - 1) / n, (j + 1) / n
        elif kind != "polynomial":
            raise ValueError(f"unknown contrast {kind!r}")
    if kind == "polynomial" and n > 1:
        basis, _ = np.linalg.qr(np.vander(np.arange(n) - (n - 1) / 2, n, increasing=True))
        rows = basis[:, 1:] * np.sign(basis[-1, 1:])
    level = lambda j: F.coalesce(F.get(F.lit([float(v) for v in rows[:, j]]), F.col("__code")), F.lit(0.0))
    return coded.withColumns({f"{prefix}{j}": level(j) for j in range(n - 1)}).drop("__code")


def cross(df: DataFrame, cats: Sequence[str], output: str) -> DataFrame:
    """The categories joined by underscores."""
    return df.withColumn(output, F.concat_ws("_", *(F.col(f"`{c}`").cast("string") for c in cats)))


def group_numeric(train: DataFrame, df: DataFrame, cat: str, columns: Sequence[str]) -> DataFrame:
    """Mean, median, sample deviation, maximum and minimum of each column per category: {cat}_{what}_{column}."""
    made = {}
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        made |= {f"{cat}_mean_{c}": F.avg(x), f"{cat}_median_{c}": F.percentile(x, F.lit(0.5)), f"{cat}_std_{c}": F.stddev_samp(x), f"{cat}_max_{c}": F.max(x), f"{cat}_min_{c}": F.min(x)}
    return _look_up(df, train.groupBy(f"`{cat}`").agg(*(e.alias(n) for n, e in made.items())), cat, dict.fromkeys(made))


def group_categorical(train: DataFrame, df: DataFrame, cat: str, columns: Sequence[str]) -> DataFrame:
    """Mode (the smallest of several), number of distinct values and count of other categoricals per category."""
    out = df
    for c in columns:
        counts = train.groupBy(f"`{cat}`", f"`{c}`").agg(F.count(F.lit(1)).alias("n"))
        mode = F.min_by(F.col(f"`{c}`"), F.struct(-F.col("n"), F.col(f"`{c}`")))
        table = counts.where(F.col(f"`{c}`").isNotNull()).groupBy(f"`{cat}`").agg(mode.alias(f"{cat}_mode_{c}"), F.count(F.lit(1)).alias(f"{cat}_nunique_{c}"), F.sum("n").alias(f"{cat}_count_{c}"))
        out = _look_up(out, table, cat, {f"{cat}_mode_{c}": None, f"{cat}_nunique_{c}": None, f"{cat}_count_{c}": None})
    return out


def combined(train: DataFrame, df: DataFrame, one: str, two: str, limit: int = 100) -> DataFrame:
    """The cross of two categories as code and count; unseen gives -1 and 0. Crosses of more than `limit` values are left out."""
    name = f"{one}_{two}"
    crossed = cross(train, [one, two], name)
    if crossed.select(name).distinct().limit(limit + 1).count() > limit:
        return df
    coded = ordinal(cross(df, [one, two], name), codes(crossed, name), name, f"{name}_code")
    return count(crossed, coded, name, f"{name}_count").drop(name)


def impute(train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Nulls as the column's mean, or as "missing"."""
    means = train.agg(*(F.avg(f"`{c}`").alias(c) for c in numeric)).first().asDict() if numeric else {}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in means.items()} | {c: F.coalesce(F.col(f"`{c}`"), F.lit("missing")) for c in categorical})


def quantile_bins(train: DataFrame, df: DataFrame, column: str, output: str, bins: int | None = None) -> DataFrame:
    """The number of the quantile bin, from 0; ceil(sqrt(n)) bins unless given."""
    x = F.col(f"`{column}`").cast("double")
    bins = bins or max(1, math.ceil(math.sqrt(train.count())))
    edges = _edges(train, column, bins)
    return df.withColumn(output, F.when(x.isNotNull(), ordered.bin_of(x, edges)) if edges else F.lit(0))


def _edges(train: DataFrame, column: str, bins: int) -> list[float]:
    """The distinct edges between equally full bins; none where there is no value."""
    return sorted({e for e in ordered.quantiles(train, column, [i / bins for i in range(1, bins)]).values() if e is not None}) if bins > 1 else []


def histogram_bins(df: DataFrame, column: str, output: str, bins: int = 10) -> DataFrame:
    """Equal-width bin numbers from 0 to bins - 1 between the least and the greatest value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    place = F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) or 1.0) * bins)
    return df.withColumn(output, F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))


def nearest_value(train: DataFrame, df: DataFrame, column: str, output: str, buckets: int = 200) -> DataFrame:
    """The training value nearest to each value, ties to the lower: an as-of lookup in both directions.

    Both sides are cut at common quantile edges; within a bucket, windows carry the neighbours, and each bucket also
    gets the last training value before it and the first after it, so no window spans all rows.
    """
    x = F.col(f"`{column}`").cast("double")
    edges = _edges(train, column, buckets)
    bucket = ordered.bin_of(x, edges)
    known = train.where(x.isNotNull()).select(x.alias("__v")).distinct().withColumn("__b", ordered.bin_of(F.col("__v"), edges))
    ends = known.groupBy("__b").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    spread = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("__b")).join(ends, "__b", "left")
    span = W.orderBy("__b")  # one row per bucket
    around = spread.select("__b", F.last("hi", True).over(span.rowsBetween(W.unboundedPreceding, -1)).alias("__before"), F.first("lo", True).over(span.rowsBetween(1, W.unboundedFollowing)).alias("__after"))
    both = df.withColumns({"__x": x, "__b": bucket, "__t": F.lit(None).cast("double")}).unionByName(known.select(F.col("__v").alias("__x"), "__b", F.col("__v").alias("__t")), allowMissingColumns=True)
    both = both.withColumn("__own", F.col("__t").isNull())
    inside = W.partitionBy("__b").orderBy("__x", "__own")
    low = F.last("__t", True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    high = F.first("__t", True).over(W.partitionBy("__b").orderBy("__x", F.col("__own").desc()).rowsBetween(0, W.unboundedFollowing))
    seen = both.withColumns({"__low": low, "__high": high}).where("__own").join(F.broadcast(around), "__b")
    low, high = F.coalesce("__low", "__before"), F.coalesce("__high", "__after")
    near = F.when(low.isNull(), high).when(high.isNull(), low).when(F.col("__x") - low <= high - F.col("__x"), low).otherwise(high)
    return seen.withColumn(output, near).select(*(F.col(f"`{c}`") for c in df.columns), output)
