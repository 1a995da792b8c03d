"""Row sampling and splits by hashes and windows, never by driver-side choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import ordered


def mini_batch(df: DataFrame, row_id: str, generation: int, n: int, size: int = 32, step: int = 8) -> DataFrame:
    """The cyclic slice of `size` rows from place generation * step mod n, by row ids 0 to n-1."""
    start = generation * step % n
    return df.where(F.pmod(F.col(row_id) - F.lit(start), F.lit(n)) < size)


def split(row_id: str, shares: dict[str, int], seed: int = 0) -> Column:
    """A part's name for every row, by hash; shares are per cent and sum to 100."""
    u = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(100))
    out, upto = F.when(F.lit(False), F.lit("")), 0
    for name, share in shares.items():
        upto += share
        out = out.when(u < upto, F.lit(name))
    return out


def random_subset(df: DataFrame, row_id: str, k: int, seed: int = 0) -> DataFrame:
    """k rows by the order of a hash."""
    return df.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id).limit(k)


def quantile_sample(df: DataFrame, column: str, row_id: str, bins: int) -> DataFrame:
    """One row per quantile bin of the column: the one with the smallest hash."""
    edges = [e for e in ordered.quantiles(df, column, [i / bins for i in range(1, bins)]).values() if e is not None] if bins > 1 else []
    place = ordered.bin_of(F.col(f"`{column}`").cast("double"), edges)
    return df.withColumn("bin", place).withColumn("__r", F.row_number().over(W.partitionBy("bin").orderBy(F.xxhash64(row_id), row_id))).where("__r = 1").drop("__r")


def equal_width_sample(df: DataFrame, column: str, row_id: str, bins: int, per_bin: int) -> DataFrame:
    """At most per_bin rows of each equal-width bin, in order of id."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) or 1.0) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", place).withColumn("__r", F.row_number().over(W.partitionBy("bin").orderBy(row_id))).where(F.col("__r") <= per_bin).drop("__r")


def hard_rows(losses: DataFrame, k: int, how: str = "hard") -> DataFrame:
    """k rows by their losses over many models: hard (largest median), easy (smallest), stable (smallest deviation) or diverse (largest)."""
    stat = F.percentile(F.col("loss").cast("double"), F.lit(0.5)) if how in ("hard", "easy") else F.stddev_pop("loss")
    by_row = losses.groupBy("row_id").agg(stat.alias("score"))
    order = F.col("score").desc() if how in ("hard", "diverse") else F.col("score").asc()
    return by_row.orderBy(order, "row_id").limit(k)


def mixup(df: DataFrame, row_id: str, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """Each row mixed with another by a hashed share: x * l + x' * (1 - l); the partner is a hash-chosen row id below n.

    A row whose partner's id is not there stays as it is, so no row goes where ids are not dense.
    """
    partner = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(n))
    share = F.pmod(F.xxhash64(row_id, F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    own = df.select(row_id, *columns).withColumns({"__p": partner, "__l": share})
    other = df.select(F.col(row_id).alias("__p"), *(F.col(c).alias(f"__o_{c}") for c in columns))
    mixed = own.join(other, "__p", "left")
    return mixed.select(row_id, *((F.col(c) * F.col("__l") + F.coalesce(f"__o_{c}", c) * (F.lit(1.0) - F.col("__l"))).alias(c) for c in columns))
