"""Losses and scores as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from . import ordered


def r2(y: Column, p: Column, df: DataFrame) -> Column:
    """1 - residual sum / total sum, in one pass: the total is n * var_pop(y)."""
    return F.lit(1.0) - F.sum((y - p) * (y - p)) / (F.count(y) * F.var_pop(y))


def weighted_r2(y: Column, p: Column, w: Column) -> Column:
    total = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    return F.lit(1.0) - F.sum(w * (y - p) * (y - p)) / total


#: Per-row losses by name, of target y and prediction p.
CASE_LOSSES = {
    "squared": lambda y, p: (y - p) * (y - p),
    "absolute": lambda y, p: F.abs(y - p),
    "exp_squared": lambda y, p: F.exp(F.least(F.greatest((y - p) * (y - p), F.lit(0.0)), F.lit(10.0))),
    "log_squared": lambda y, p: F.ln(F.lit(1.0) + (y - p) * (y - p)),
    "quad": lambda y, p: (y - p) * (y - p) * (y - p) * (y - p),
    "bounded": lambda y, p: F.least(F.greatest((y - p) * (y - p), F.lit(0.0)), F.lit(1.0)),
}


def zero_one(labels: Column, probabilities: Column) -> Column:
    """1 where the most probable class, the first of several, is not the label."""
    best = F.array_position(probabilities, F.array_max(probabilities)) - 1
    return (best != labels).cast("double")


def cross_entropy(labels: Column, probabilities: Column) -> Column:
    return -F.ln(F.greatest(F.get(probabilities, labels.cast("int")), F.lit(1e-8)))


def average_rank(df: DataFrame, column: str, output: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean: counts per value, summed within buckets of values and over the buckets."""
    counts = df.groupBy(F.col(f"`{column}`").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered.ranks(counts, "__v", "__n").select("__v", (F.col("upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(output))
    return df.join(ranked, df[f"`{column}`"] == ranked["__v"]).drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the rank correlation, ties by mean rank."""
    ranked = average_rank(average_rank(df.select(a, b).dropna(), a, "__ra"), b, "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("spearman"))


def smoothness(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Mean squared first and second differences of y in order of x."""
    rows = ordered.with_previous(df, x, y, tie)
    both = rows.select((F.col("y") - F.col("y1")).alias("d1"), (F.col("y") - 2 * F.col("y1") + F.col("y2")).alias("d2"))
    return both.agg(F.avg(F.col("d1") * F.col("d1")).alias("first_order"), F.avg(F.col("d2") * F.col("d2")).alias("second_order"))


def bootstrap_error(df: DataFrame, loss: str, row_id: str, rounds: int = 50, seed: int = 7) -> DataFrame:
    """Mean loss per bootstrap round, rows weighted by Poisson(1) draws from hashes; rounds are columns of one pass."""
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]

    def weight(r: int) -> Column:
        u = F.pmod(F.xxhash64(row_id, F.lit(r), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return sum(((u > s).cast("double") for s in steps), F.lit(0.0))

    row = df.agg(*((F.sum(weight(r) * F.col(loss)) / F.sum(weight(r))).alias(f"r{r}") for r in range(rounds)))
    return row.select(F.explode(F.array(*row.columns)).alias("error"))


def outlier_free_mean(df: DataFrame, column: str) -> DataFrame:
    """The mean of the values within 1.5 interquartile ranges of the quartiles."""
    q1, q3 = ordered.quantiles(df, column, (0.25, 0.75)).values()
    if q1 is None:
        return df.agg(F.lit(None).cast("double").alias("mean"))
    reach = 1.5 * (q3 - q1)
    return df.where(F.col(column).between(q1 - reach, q3 + reach)).agg(F.avg(column).alias("mean"))


def generation_statistics(df: DataFrame, column: str) -> DataFrame:
    """avg, std (population), quartiles, min and max."""
    x = F.col(column).cast("double")
    q = [F.lit(v).cast("double") for v in ordered.quantiles(df, column, (0.25, 0.5, 0.75)).values()]
    return df.agg(F.avg(x).alias("avg"), F.stddev_pop(x).alias("std"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.min(x).alias("min"), F.max(x).alias("max"))


def weighted_mean_std(df: DataFrame, value: str, weight: str) -> DataFrame:
    v, w = F.col(value), F.col(weight)
    mean = F.sum(v * w) / F.sum(w)
    return df.agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(w * v * v) / F.sum(w) - mean * mean, F.lit(0.0))).alias("std"))


def instance_weights(losses: DataFrame, row_id: str, loss: str, how: str = "median", hard: bool = True) -> DataFrame:
    """Weights of rows from the losses of many models (long form): per row the minimum or median, or 1 over it, normalised to sum 1."""
    stat = F.min(loss) if how == "min" else F.percentile(F.col(loss), F.lit(0.5))
    by_row = losses.groupBy(row_id).agg(stat.alias("s"))
    raw = by_row.withColumn("raw", F.col("s") if hard else F.lit(1.0) / (F.col("s") + F.lit(1e-10)))
    total = raw.agg(F.sum("raw")).first()[0]
    return raw.select(row_id, (F.col("raw") / F.lit(total)).alias("weight"))


def semantic_fingerprint(df: DataFrame, columns: Sequence[str], row_id: str, digits: int = 9) -> DataFrame:
    """(gene, fingerprint) per column: equal for columns whose standardised values agree to `digits` digits on every row."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()

    def one(c: str) -> Column:
        z = (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)
        return F.sum(F.xxhash64(row_id, F.rint(z * 10.0**digits).cast("long")).cast("decimal(38,0)"))

    row = df.agg(*(one(c).cast("string").alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("gene"), F.col(c).alias("fingerprint")) for c in columns))).alias("x")).select("x.*")


def task_r2(df: DataFrame, y: str, prediction: str, task: str) -> DataFrame:
    """One row: the mean over tasks of each task's R2; tasks with one value of y take no part."""
    miss = F.sum((F.col(y) - F.col(prediction)) ** 2)
    by_task = df.groupBy(task).agg((F.lit(1.0) - miss / (F.count(y) * F.var_pop(y))).alias("r2"), F.var_pop(y).alias("v")).where("v > 0")
    return by_task.agg(F.avg("r2").alias("task_r2"))


def sized_score(score: Column, size: Column, weight: float = 0.01) -> Column:
    """A score less a weight for each node, or each feature, that earned it."""
    return score - F.lit(weight) * size
