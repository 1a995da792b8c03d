"""Reading tables and writing features and models."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """A table of one of FORMATS; csv and json without a schema are scanned for one."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=header, inferSchema=schema is None)
    return getattr(reader, kind)(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a table of one of FORMATS."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    writer.csv(path, header=True) if kind == "csv" else getattr(writer, kind)(path)


def check_features(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise for columns that are missing or not numeric or boolean."""
    kinds = dict(df.dtypes)
    for c in columns:
        if c not in kinds:
            raise ValueError(f"no column {c!r}")
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"{c} is {kinds[c]}; features are numeric or boolean")


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """A fitted model's description as JSON, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def doubles(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns as doubles, and `keep` as they are."""
    return df.select(*(F.col(f"`{k}`") for k in keep), *(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
