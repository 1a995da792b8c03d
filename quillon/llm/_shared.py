"""What several operators of this subpackage use: shared scratch tables, words, row keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset.

    A folder of our own is shared only where everything runs on one machine, so elsewhere an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_quillon_scratch", None) or "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark._quillon_scratch = root
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def written(spark: SparkSession, path: str) -> None:
    """Note a folder that the process is to delete when it ends."""
    _made.append((spark, path))


def discard(df: DataFrame) -> None:
    """Delete a table made by materialise() that nothing reads any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of finished steps at once: their plans, and with these the shuffle files and broadcasts that Spark drops once
    the driver has collected its garbage. A long chain of steps otherwise fills the driver's heap with them first."""
    trim_worker(keep=True)
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


def carries_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator(df, ...) for df with any column names: its own columns begin with two underscores, so a caller's that
    do so have other names meanwhile, in arguments too, and their own again in the result. Other tables are not touched."""

    @wraps(operator)
    def call(df: DataFrame, *args, **options) -> DataFrame:
        held = {c for c in df.columns if c.startswith("__")}
        if not held:
            return operator(df, *args, **options)
        taken, other = {c.lower() for c in df.columns}, {}
        for c in sorted(held):
            n = len(other)
            while f"carried_{n}" in taken:
                n += 1
            other[c] = f"carried_{n}"
            taken.add(other[c])
        own = {v: k for k, v in other.items()}

        def renamed(v):
            return [other.get(c, c) for c in v] if isinstance(v, list) else other.get(v, v) if isinstance(v, str) else v

        out = operator(df.toDF(*(other.get(c, c) for c in df.columns)), *(renamed(v) for v in args), **{k: renamed(v) for k, v in options.items()})
        return out.toDF(*(own.get(c, c) for c in out.columns))

    return call


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where lambdas inside body use it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """True for the rows kept from learning: crc32 of the id's decimal text has remainder 2 modulo 4. A null id gives false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for the rows a model may learn from: those with an id whose remainder is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an expression whose text is ASCII; null gives null. DuckDB has no such function."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)"
    byte = "list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, 4294967295), 4294967295)"


def trim_worker(keep: bool = False) -> None:
    """In a Python worker or the driver: drop the token cache that an earlier task left, unless told to keep it, and give freed memory back.

    Workers outlive tasks and are shared by all operators; a task with large arrays of its own begins with this.
    """
    tokens = sys.modules.get("quillon.llm.tokens")
    if tokens is not None and not keep:
        tokens._encoders.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)
