"""Running mean and variance by key that forget: each value weighs `decay` times as much as the next one of its key.

A stretch of values is the triple of its weight, mean and squared deviations, and two stretches that follow each other
merge exactly, so neither a table nor a stream need be taken value by value. A table is dealt by ranges of key and
order, a hot key over many ranges, whose triples are folded in order. A stream keeps one triple a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.ordered import by_range

_TRIPLE = "n double, mean double, m2 double, rows long"


def decayed_moments(df: DataFrame, key: str, order: str, tie: str, value: str, decay: float) -> DataFrame:
    """key, n (sum of weights), mean, var, rows: after the last value of each key in order of `order`, then `tie`.

    Null and non-finite values are skipped, a null key is a key, and nulls of the order come first. Rows equal in order
    and tie follow each other in any order. An empty table gives no rows.
    """
    if not 0.0 < decay <= 1.0:
        raise ValueError("decay must be above 0 and at most 1")
    x = F.col(f"`{value}`").cast("double")
    rows = df.where(F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))).select(F.col(f"`{key}`").alias("key"), F.col(f"`{order}`").alias("at"), F.col(f"`{tie}`").alias("tie"), x.alias("x"))
    parts = by_range(rows, ["key", "at", "tie"], "decayed")
    inside = W.partitionBy("part", "key")
    ahead = F.count(F.lit(1)).over(inside) - F.row_number().over(inside.orderBy(F.col("at").asc_nulls_first(), F.col("tie").asc_nulls_first()))
    weighed = parts.select("part", "key", (F.col("x") - F.avg("x").over(inside)).alias("d"), F.avg("x").over(inside).alias("c"), F.pow(F.lit(float(decay)), ahead).alias("w"))
    sums = weighed.groupBy("part", "key").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("d")).alias("s"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("q"), F.first("c").alias("c"), F.count(F.lit(1)).alias("rows"))
    stretch = F.struct("part", F.col("n"), (F.col("c") + F.col("s") / F.col("n")).alias("mean"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("m2"), F.col("rows"))
    listed = sums.groupBy("key").agg(F.sort_array(F.collect_list(stretch)).alias("all"))  # an entry a range

    def merge(a, b):
        kept = a["n"] * F.pow(F.lit(float(decay)), b["rows"])
        n, gap = kept + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] * F.pow(F.lit(float(decay)), b["rows"]) + b["m2"] + gap * gap * kept * b["n"] / n).alias("m2"), (a["rows"] + b["rows"]).alias("rows"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0).cast("long").alias("rows"))
    done = listed.select("key", F.aggregate("all", none, merge).alias("t"))
    return done.select(F.col("key").alias(key), F.col("t.n").alias("n"), F.col("t.mean").alias("mean"), F.greatest(F.lit(0.0), F.col("t.m2") / F.col("t.n")).alias("var"), F.col("t.rows").alias("rows"))


class DecayedMoments(StatefulProcessor):
    """One triple a key."""

    def __init__(self, decay: float) -> None:
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.triple = handle.getValueState("triple", _TRIPLE)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        frame = pd.concat(list(rows), ignore_index=True)
        x = frame["x"].to_numpy()[np.lexsort((frame["tie"].to_numpy(), frame["at"].to_numpy()))]
        w = self.decay ** np.arange(len(x) - 1, -1, -1.0)
        n, fade = w.sum(), self.decay ** len(x)
        mean = float(x[0] + (w * (x - x[0])).sum() / n)
        m2, count = (w * (x - mean) ** 2).sum(), len(x)
        if self.triple.exists():
            old_n, old_mean, old_m2, old_rows = self.triple.get()
            kept, gap = old_n * fade, mean - old_mean
            m2 = old_m2 * fade + m2 + gap * gap * kept * n / (kept + n)
            mean, n, count = old_mean + gap * n / (kept + n), kept + n, old_rows + count
        self.triple.update((float(n), float(mean), float(m2), int(count)))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [mean], "var": [max(m2 / n, 0.0)], "rows": [count]})

    def close(self) -> None:
        pass


def decayed_stream(stream: DataFrame, key: str, order: str, tie: str, value: str, decay: float) -> DataFrame:
    """key, n, mean, var, rows of each key that a micro-batch has values of, after it: rows of a stream in update mode.

    Within a micro-batch values go in order of `order`, then `tie` (numbers or times, not null; rows with one are
    skipped, as are null keys and null or non-finite values); later batches' values follow, as values that arrive late
    do. A micro-batch's values of one key are in one task, so the source bounds them (maxFilesPerTrigger).
    """
    if not 0.0 < decay <= 1.0:
        raise ValueError("decay must be above 0 and at most 1")
    x = F.col(f"`{value}`").cast("double")
    whole = F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & F.col(f"`{key}`").isNotNull() & F.col(f"`{order}`").isNotNull() & F.col(f"`{tie}`").isNotNull()
    rows = stream.where(whole).select(F.col(f"`{key}`").alias("key"), F.col(f"`{order}`").alias("at"), F.col(f"`{tie}`").alias("tie"), x.alias("x"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(DecayedMoments(decay), f"key {kind}, n double, mean double, var double, rows long", "Update", "None")
    return out.withColumnRenamed("key", key)
