"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: slot (offset + k * skip) mod size for
k = 0, 1, ..., with offset and skip from a digest of its name. The shards take turns, each claiming its most
preferred free slot, until the table is full. A key is placed by one table lookup, so placement takes constant time,
shards get equally many slots (within one), and adding or removing a shard moves few keys besides its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table is broadcast; its size is checked against this bound.
MAX_TABLE = 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(*parts: str) -> int:
    return int(hashlib.md5("\x1f".join(parts).encode()).hexdigest()[:15], 16)


def shard_table(shards: Sequence[str], size: int = 65537) -> list[int]:
    """The filled table: for each slot the position in `shards` of its shard.

    size must be a prime of at most MAX_TABLE and no less than the number of shards; names must be distinct.
    """
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table's size must be a prime from {len(shards)} to {MAX_TABLE}")
    skip = [_number("skip", s) % (size - 1) + 1 for s in shards]
    at = [_number("offset", s) % size for s in shards]
    table, free = [-1] * size, size
    while True:
        for i, step in enumerate(skip):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot], at[i] = i, (slot + step) % size
            free -= 1
            if not free:
                return table


def key_text(*keys: Column) -> Column:
    """One string for the key columns; nulls differ from every value, also from the empty string."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys))


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key string: the first 15 hex digits of its MD5 modulo the table's size."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = 65537) -> DataFrame:
    """df with columns slot and shard (position in `shards`) appended; columns of these names in df are replaced.

    Equal keys go to the same shard, null keys too, and rows are neither dropped nor moved: the plan has no shuffle.
    An empty df gives an empty result. Hot keys make hot shards, as any placement by key does.
    """
    table = shard_table(shards, size)
    lookup = df.sparkSession.createDataFrame(list(enumerate(table)), "slot int, shard int")
    kept = df.drop("slot", "shard")
    slotted = kept.withColumn("slot", slot_of(key_text(*(F.col(f"`{k}`") for k in keys)), size))
    return slotted.join(F.broadcast(lookup), "slot").select(*(f"`{c}`" for c in kept.columns), "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write placed rows into one folder per shard; files_per_shard splits large shards over several tasks."""
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in placed.columns if c not in ("slot", "shard"))), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
