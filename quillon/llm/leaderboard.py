"""A change feed of leaderboards over a stream of amounts: who entered, left or moved on a board after each day.

Batches of lines are files that are fed in turn to one Structured Streaming query with state, started anew for each
batch on one checkpoint. Its state keeps, per board and shard of its items, the running revenues (a map state, packed
into a few buckets) and the shard's last board; a batch's days are replayed in order on a list of (negative revenue,
item) kept sorted by bisection, and what changed among the shard's first is emitted. Items lie in one shard each, so a
board's first are among its shards' first: a last step replays what the shards of a board emitted and gives the
differences of ranks.

A board with a third of all rows is spread over its shards, and rows of one item and day are summed within each task
before the shuffle, so that a hot item or vendor is a few rows a task. The last step sees at most `top` items of each
shard and day, entering or leaving, however many rows came in. Sums of whole numbers are exact in doubles below 2^53, so their order and
reruns change nothing.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ._shared import materialise, scratch_root, written

LINES = "board int, item long, day long, arrival long, amount double"
CHANGES = "board int, arrival long, item long, batch int, change string, old_rank int, new_rank int, amount double"

_SHARD_ROWS = "board int, arrival long, item long, amount double, listed boolean"
#: Map entries that the revenues of a shard are packed into.
BUCKETS = 8
#: Arrow batches of which a task sums equal keys together before they are shuffled.
SUMMED_BATCHES = 64

#: A query takes one batch and ends, so its stores are closed at the commit, not kept open for a next one.
_CONF = {
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Board:
    """Amounts by item with the positive ones in order: largest first, ties to the smaller item."""

    def __init__(self, amounts: dict[int, float]) -> None:
        self.amounts = amounts
        self.order = sorted((-v, k) for k, v in amounts.items() if v > 0)

    def put(self, item: int, amount: float) -> None:
        self.drop(item)
        self.amounts[item] = amount
        if amount > 0:
            insort(self.order, (-amount, item))

    def drop(self, item: int) -> None:
        old = self.amounts.pop(item, 0.0)
        if old > 0:
            del self.order[bisect_left(self.order, (-old, item))]

    def top(self, n: int) -> list[tuple[float, int]]:
        return self.order[:n]


def _pack(values: Iterable, kind: type) -> bytes:
    return np.array(list(values), kind).tobytes()


def _days(frames: Iterator, *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of the group's frames by arrival day, in order."""
    parts = list(frames)
    day = np.concatenate([p["arrival"].to_numpy() for p in parts])
    turn = np.argsort(day, kind="stable")
    day = day[turn]
    values = [np.concatenate([p[c].to_numpy() for p in parts])[turn].tolist() for c in columns]
    edges = [0, *(np.flatnonzero(np.diff(day)) + 1).tolist(), len(day)]
    for at, upto in zip(edges, edges[1:], strict=False):
        yield int(day[at]), list(zip(*(v[at:upto] for v in values), strict=True))


class ShardState(StatefulProcessor):
    """Running revenues of a shard's items; emits the items whose place or amount among its first `top` changed."""

    def __init__(self, top: int) -> None:
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "bucket int", "items binary, amounts binary")
        self.board = handle.getValueState("board", "items binary, amounts binary")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        kept: dict[int, float] = {}
        for _, (items, amounts) in self.revenues.iterator():
            kept.update(zip(np.frombuffer(items, np.int64).tolist(), np.frombuffer(amounts, np.float64).tolist(), strict=True))
        board, out, touched = Board(kept), [], set()
        last: list[tuple[float, int]] = []
        if self.board.exists():
            items, amounts = self.board.get()
            last = list(zip((-np.frombuffer(amounts, np.float64)).tolist(), np.frombuffer(items, np.int64).tolist(), strict=True))
        for day, lines in _days(rows, "item", "amount"):
            for item, amount in lines:
                board.put(item, board.amounts.get(item, 0.0) + amount)
                touched.add(item % BUCKETS)
            now = board.top(self.top)
            if now != last:
                old, listed = set(last), {item for _, item in now}
                out += [(key[0], day, item, -minus, True) for minus, item in now if (minus, item) not in old]
                out += [(key[0], day, item, board.amounts[item], False) for _, item in last if item not in listed]
                last = now
        parts: dict[int, list[int]] = {b: [] for b in touched}
        for item in board.amounts:
            if item % BUCKETS in parts:
                parts[item % BUCKETS].append(item)
        for bucket, items in parts.items():
            self.revenues.updateValue((bucket,), (_pack(items, np.int64), _pack((board.amounts[i] for i in items), np.float64)))
        self.board.update((_pack((i for _, i in last), np.int64), _pack((-m for m, _ in last), np.float64)))
        if out:
            yield pd.DataFrame(out, columns=["board", "arrival", "item", "amount", "listed"])

    def close(self) -> None:
        pass


def _board_changes(top: int):
    """The changes of one board from what its shards emitted on all days, in order of days."""

    def changes(frame):
        import pandas as pd

        board, ranks, out = Board({}), {}, []
        for day, lines in _days(iter([frame]), "item", "amount", "listed", "batch"):
            left = {}
            for item, amount, listed, _ in lines:
                if listed:
                    board.put(item, amount)
                else:
                    board.drop(item)
                    left[item] = amount
            now = {item: r for r, (_, item) in enumerate(board.top(top), 1)}
            for item in sorted(ranks.keys() | now.keys()):
                old, new = ranks.get(item), now.get(item)
                if old != new:
                    change = "enter" if old is None else "exit" if new is None else "move"
                    out.append((frame["board"].iloc[0], day, item, lines[0][3], change, old, new, left[item] if item in left else board.amounts[item]))
            ranks = now
        return pd.DataFrame(out, columns=["board", "arrival", "item", "batch", "change", "old_rank", "new_rank", "amount"]).astype({"old_rank": "Int32", "new_rank": "Int32"})

    return changes


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Amounts by board, item and arrival day, of some batches of a task together."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by(["board", "item", "arrival"]).aggregate([("amount", "sum")]).rename_columns(["board", "item", "arrival", "amount"])
        held.clear()
        yield from sums.to_batches(max_chunksize=100_000)

    for batch in batches:
        held.append(batch)
        if len(held) == SUMMED_BATCHES:
            yield from flush()
    if held:
        yield from flush()


def change_feed(lines: DataFrame, batch: str = "batch", top: int = 10, lateness: int = 3, shards: int = 16) -> DataFrame:
    """The changes of every board's first `top` items after each arrival day, as CHANGES.

    lines has the columns of LINES and a number of the batch by which it is fed, in ascending order; a batch must hold
    all lines of its arrival days, and later batches later days. Lines with day + lateness below the largest day of all
    earlier batches' lines are dropped; those without a board or an item count for that largest day alone. A null
    amount adds 0. A board lists its largest positive running amounts, ties to the smaller item; change is enter, exit
    or move, a rank null where the item is off the board, and amount the item's running amount after the day. Repeated
    lines count as often as they come; other columns are ignored; no lines give no changes.
    shards: parts of each board's items; the items of one part (number of items / shards) are in a task's memory.
    """
    spark = lines.sparkSession
    root = f"{scratch_root(spark)}/quillon-leaderboard-{uuid.uuid4().hex}"
    fed = lines.select(F.col("board").cast("int"), F.col("item").cast("long"), F.col("day").cast("long"), F.col("arrival").cast("long"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), F.col(f"`{batch}`").cast("int").alias("batch"))
    fed.write.partitionBy("batch").parquet(f"{root}/cut")
    written(spark, root)
    schema = f"{LINES}, batch int"
    latest = spark.read.schema(schema).parquet(f"{root}/cut").groupBy("batch").agg(F.max("day")).orderBy("batch").collect()  # a row per batch
    conf = {k: spark.conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            spark.conf.set(k, v)
        high = None
        for number, day in latest:
            _move(spark, f"{root}/cut/batch={number}", f"{root}/incoming/batch={number}")
            _feed(spark, root, schema, number, high, top, lateness, shards)
            high = day if high is None else max(high, day) if day is not None else high
    finally:
        for k, v in conf.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if not latest:
        return spark.createDataFrame([], CHANGES)
    listed = spark.read.schema(f"{_SHARD_ROWS}, batch int").parquet(f"{root}/changes")
    return listed.groupBy("board").applyInPandas(_board_changes(top), CHANGES)


def _feed(spark: SparkSession, root: str, schema: str, number: int, high: int | None, top: int, lateness: int, shards: int) -> None:
    """Start the query on its checkpoint, let it take the files of one batch, and wait until it has."""
    stream = spark.readStream.schema(schema).parquet(f"{root}/incoming")
    used = F.col("board").isNotNull() & F.col("item").isNotNull()
    if high is not None:
        used &= F.col("day") + lateness >= high
    sums = stream.where(used).select("board", "item", "arrival", "amount").mapInArrow(_summed, "board int, item long, arrival long, amount double")
    parts = sums.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")).groupBy("board", "shard").transformWithStateInPandas(ShardState(top), _SHARD_ROWS, "Append", "None")
    out = parts.withColumn("batch", F.lit(number).cast("int"))
    query = out.writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def with_looked_up(lines: DataFrame, table: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """lines with values of a table's row with the same key, and `found`; null and unknown keys give nulls and false.

    The table may be as large as it likes: both sides are shuffled, and the partition of a hot key is split by adaptive
    execution. values: aggregate expressions by name, for keys with several rows.
    """
    own = materialise(table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(*(F.expr(v).alias(k) for k, v in values.items())), "lookup")
    joined = lines.join(own.hint("shuffle_hash"), F.col(key) == F.col("__key"), "left")
    return joined.withColumn("found", F.col("__key").isNotNull()).drop("__key")
