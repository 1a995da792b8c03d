"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Pieces are range-sorted by length and ranked within their length by distributed counts. A round sweeps the sorted
lengths and the sorted gaps together, from small to large: every gap meets the longest waiting piece that fits, which
is the piece whose next gap it is. Pieces of one length that meet gaps of one size are paired by rank, the gaps shrink
by what they took, and the next round begins; when nothing fits any more, new sequences open for the longest pieces.

Lengths and gaps are whole numbers up to the capacity, so the sorted order is run-length coded: a sweep handles runs
(length, how many), not pieces. Its work is bounded by the capacity, whatever the number of pieces, and its outcome,
a list of runs "pieces r to r+n of this length go to sequences s to s+n at this offset", is looked up by every piece
where it lies. No piece, gap or rank goes to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import carries_columns, materialise, trim_worker
from .tokens import encoder, slices, with_end

#: The looked-up runs are broadcast; beyond so many they are joined by shuffling instead.
MAX_BROADCAST_RUNS = 200_000


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece (from 0), start, length, ids.

    A document is its ids and end_id; it is cut after every `capacity` ids, so only longer ones are. ids is binary,
    little-endian unsigned 32-bit. Null texts count as empty: one piece that holds the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker(keep=True)
        for batch in (b.slice(at, end - at) for b in batches for at, end in slices(b.column(1))):
            ids, counts = with_end(*encoder(vocabulary).encode(batch.column(1)), end_id)
            n_pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            for at in range(0, len(doc), 4096):  # binary columns hold 2 GB at most
                part = slice(at, at + 4096)
                first = np.concatenate([[0], np.cumsum(length[part])])
                base = int(length[:at].sum())
                raw = ids[base : base + int(first[-1])].astype("<u4")
                held = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(raw)])
                columns = [batch.column(0).take(pa.array(doc[part])), pa.array(piece[part].astype(np.int32)), pa.array(start[part]), pa.array(length[part]), held]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def schedule(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: runs (length, first rank, how many, first sequence, offset).

    counts: how many pieces there are of each length from 1 to capacity. Consecutive ranks of a run go to consecutive
    sequences, all at the same offset.
    """
    left = {s: n for s, n in counts.items() if n}
    rank: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many)
    opened = 0

    def put(length: int, n: int, sequence: int, gap: int) -> None:
        runs.append((length, rank[length], n, sequence, capacity - gap))
        rank[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def open_for(length: int, n: int) -> None:
        nonlocal opened
        put(length, n, opened, capacity)
        if length < capacity:
            gaps[capacity - length].append((opened, n))
        opened += n

    for length in sorted(left, reverse=True):  # no two of these share a sequence
        if 2 * length > capacity:
            open_for(length, left[length])
    while left:
        lengths, waiting, matched = sorted(left), [], False
        nxt, after = 0, defaultdict(list)
        for gap in sorted(gaps):
            while nxt < len(lengths) and lengths[nxt] <= gap:
                waiting.append(lengths[nxt])
                nxt += 1
            for sequence, n in gaps[gap]:
                while n and waiting:
                    length = waiting[-1]
                    take = min(n, left[length])
                    room = gap
                    again = max(1, min(gap // length, left[length] // take)) if 64 * length <= capacity else 1
                    for _ in range(again):  # many short pieces: as many rounds at once
                        put(length, take, sequence, room)
                        room -= length
                    matched = True
                    if length not in left:
                        waiting.pop()
                    if room:
                        after[room].append((sequence, take))
                    sequence, n = sequence + take, n - take
                if n:
                    after[gap].append((sequence, n))
        gaps = after
        if not matched and left:
            need = -(-sum(s * n for s, n in left.items()) // capacity)
            for length in sorted(left, reverse=True):
                take = min(need, left[length])
                open_for(length, take)
                need -= take
                if not need:
                    break
    return runs


@carries_columns
def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset appended (columns of these names are replaced): every piece in one sequence
    of at most `capacity`, offsets without gaps from 0.

    length must be a whole number from 1 to capacity in every row; rows of other lengths, or without one, go into no
    sequence and get null in both columns. `order` names columns that break ties between equal lengths; rows equal in
    them all are placed in any order. An empty table gives an empty result.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fits = F.col(f"`{length}`").between(1, capacity)
    kept = materialise(pieces.select(*(F.col(f"`{c}`") for c in columns)), "pack-pieces")  # read three times below
    by = [F.col(f"`{length}`").desc(), *(F.col(f"`{c}`") for c in order)]
    sorted_pieces = materialise(kept.where(fits).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "pack-sorted")
    part_counts = sorted_pieces.groupBy(F.col(f"`{length}`").alias("__len"), "__part").agg(F.count(F.lit(1)).alias("__n"))
    part_counts = materialise(part_counts, "pack-counts")
    counts = {int(r[0]): int(r[1]) for r in part_counts.groupBy("__len").agg(F.sum("__n")).collect()}  # at most `capacity` rows
    runs = schedule(counts, capacity)
    found = pieces.sparkSession.createDataFrame(runs, "__len long, __from long, __many long, __sequence long, offset long")
    found = F.broadcast(found) if len(runs) <= MAX_BROADCAST_RUNS else found
    before = part_counts.withColumn("__before", F.sum("__n").over(W.partitionBy("__len").orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    local = W.partitionBy("__part", f"`{length}`").orderBy(*(F.col(f"`{c}`") for c in order))
    ranked = sorted_pieces.withColumn("__local", F.row_number().over(local) - 1).withColumnRenamed(length, "__len")
    ranked = ranked.join(before.select("__len", F.col("__part"), "__before"), ["__len", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__local"))
    held = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__many"))
    placed = ranked.join(found, "__len").where(held).withColumn("sequence_id", F.col("__sequence") + F.col("__rank") - F.col("__from"))
    out = placed.select(*(F.col("__len").alias(c) if c == length else F.col(f"`{c}`") for c in columns), "sequence_id", "offset")
    rest = kept.where(~F.coalesce(fits, F.lit(False)))
    return out.unionByName(rest.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))

