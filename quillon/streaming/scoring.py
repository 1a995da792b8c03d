"""Streams: scoring rows with genes, and windowed statistics with late data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.primitives import sanitise
from quillon.plans.compiler import to_column


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score(stream: DataFrame, genes: Sequence[str], names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The stream's rows with one column per gene; genes are stateless, so this is a projection."""
    return stream.select(*(F.col(f"`{k}`") for k in keep), *(sanitise(to_column(g)).alias(n) for g, n in zip(genes, names, strict=True)))


def windowed_moments(stream: DataFrame, time: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """Count, mean and population variance per key and event-time window; rows later than `late` are left out."""
    by = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(key))
    return by.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write to Parquet, exactly once, until the files present are done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
