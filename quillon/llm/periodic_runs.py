"""Periodic runs in the words of a text: maximal stretches that repeat with some period, on a harmonic grid.

A run of period p that is at least twice as long as p covers two neighbours of the grid 0, p, 2p, ... Each such pair
of places (jp, (j+1)p) is asked how far the words from both agree forward and how far the words before both agree
backward (longest common extensions). Where the two together reach p, they bound a maximal stretch of period p. There
are n/2 + n/3 + ... pairs, O(n log n) for n words. An extension is one range minimum over the common prefixes of
neighbours in a suffix array: the array of the words forward, that of the reversed words backward.

Texts of a batch are laid end to end with separators that occur once, so that no extension leaves its text, and all
steps are array operations over many short texts or one long one. A text is worked on whole, within its row: there is
no shuffle, and memory is in proportion to the texts of one lot, or to the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import trim_worker

#: Texts are worked on together up to about so many words, longer ones alone.
LOT_WORDS = 60_000
#: Pairs of the grid that are looked at in one step.
GRID_STEP = 1 << 20

FOUND = T.StructType(
    [
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
        T.StructField("collapsed", T.BinaryType()),
    ]
)


class Extensions:
    """Longest common extensions of places in a string of small whole numbers, whose last is found nowhere else."""

    def __init__(self, text: np.ndarray) -> None:
        order, self.rank, levels = _suffix_array(text)
        low = _common_prefixes(text, order, levels)
        self.table = [low]
        for k in range(max(0, len(low).bit_length() - 1)):
            row, step = self.table[-1], 1 << k
            self.table.append(np.minimum(row[: len(row) - step], row[step:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many entries from places a and from places b on agree; a and b differ."""
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.table[level]
            out[at] = np.minimum(row[lo[at]], row[hi[at] + 1 - (1 << level)])
        return out


def _suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes in order, their ranks, and for each length compared on the way the ranks that it gave."""
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    packed = max(1, 62 // bits)
    padded = np.concatenate([text + 1, np.zeros(packed, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank, tied = np.empty(n, np.int64), _rank(key[order], np.arange(n))
    rank[order] = tied[0]
    slots, levels, done = tied[1], [(packed, rank.copy())], packed
    while len(slots):
        places = order[slots]
        ahead = places + done
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        turn = np.lexsort((second, rank[places]))
        places, second = places[turn], second[turn]
        order[slots] = places
        head = rank[places]
        fresh = np.concatenate([[True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[places] = slots[first]
        alone = fresh & np.append(fresh[1:], True)
        slots, done = slots[~alone], 2 * done
        levels.append((done, rank.copy()))
    return order, rank, levels


def _rank(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys the place of each one's first equal, and the places that are not alone."""
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(fresh, at, 0)), np.flatnonzero(~(fresh & np.append(fresh[1:], True)))


def _common_prefixes(text: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each place in the suffix array how much it shares with the one before it."""
    n = len(text)
    out = np.zeros(n, np.int32)
    a, b, live = order[:-1].copy(), order[1:].copy(), np.arange(1, n)
    size, rank = levels[0]
    long = rank[a] == rank[b]
    for size, rank in reversed(levels):
        hit = np.flatnonzero(long)
        hit = hit[(a[hit] < n) & (b[hit] < n)]
        hit = hit[rank[a[hit]] == rank[b[hit]]]
        out[live[hit]] += size
        a[hit] += size
        b[hit] += size
    for _ in range(levels[0][0]):
        on = np.flatnonzero((a < n) & (b < n))
        on = on[text[a[on]] == text[b[on]]]
        if not len(on):
            break
        a, b, live = a[on] + 1, b[on] + 1, live[on]
        out[live] += 1
    return out


def find_runs(words: list[np.ndarray], min_length: int, min_periods: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all texts (word numbers each): the text's number, start, length and smallest period, in that order.

    A run is a stretch of at least min_length words and min_periods periods that no neighbouring word extends.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    none = (np.zeros(0, np.int64),) * 4
    if not len(sizes) or sizes.max() < max(min_length, min_periods):
        return none
    top = max((int(w.max()) for w in words if len(w)), default=0) + 1
    base = np.cumsum(sizes + 1) - sizes  # before each text stands its separator
    text = np.concatenate([np.concatenate(([top + k], w)) for k, w in enumerate(words)] + [[top + len(words)]]).astype(np.int64)
    n = len(text)
    forward, backward = Extensions(text), Extensions(text[::-1])
    # every text with every period up to its share, and how many pairs of the grid that makes
    half = sizes // min_periods
    owner = np.repeat(np.arange(len(words)), half)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(half) - half, half) + 1
    pairs = (sizes[owner] - 1) // period
    edges = np.concatenate([[0], np.cumsum(pairs)])
    found: list[np.ndarray] = []
    at = 0
    while at < len(owner):
        upto = max(at + 1, int(np.searchsorted(edges, edges[at] + GRID_STEP, side="right")) - 1)
        own, p = np.repeat(owner[at:upto], pairs[at:upto]), np.repeat(period[at:upto], pairs[at:upto])
        j = np.arange(len(own)) - np.repeat(edges[at:upto] - edges[at], pairs[at:upto])
        a = base[own] + j * p
        same = np.flatnonzero(text[a] == text[a + p])  # a run holds such a pair with its words, so both extensions are asked there only
        a, p, own = a[same], p[same], own[same]
        ahead = forward.common(a, a + p)
        back = backward.common(n - a, n - a - p)
        start, end = a - back, a + p + ahead
        enough = (end - start >= min_periods * p) & (end - start >= min_length)
        found.append(np.unique(np.stack([own[enough], (start - base[own])[enough], (end - start)[enough], p[enough]]), axis=1))
        at = upto
    if not found:
        return none
    # a stretch found under multiples of its period has its smallest one first
    own, start, length, p = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(own) else np.zeros(0, bool)
    own, start, length, p = own[first], start[first], length[first], p[first]
    turn = np.lexsort((p, start, own))
    return own[turn], start[turn], length[turn], p[turn]


def find(docs: DataFrame, text: str = "text", min_length: int = 12, min_periods: int = 2) -> DataFrame:
    """docs with runs (array of start, length, period, in words from 0) and collapsed (string); columns of these names are replaced.

    A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least min_length
    words and min_periods * q words that no neighbouring word extends keeping q; runs come by start, then period.
    collapsed has the words that lie in no run after its first q words, joined by single spaces. Words are maximal
    stretches without ASCII white space. Null, empty and blank texts have no runs and an empty collapsed. Rows are
    worked on each by itself: repeated rows and rows without an id give what their text gives.
    """
    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    kept = docs.select(*(F.col(f"`{c}`") for c in others))
    rows = docs.select(body, *(F.col(f"`{c}`") for c in others))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *_found(batch.column(0), min_length, min_periods).flatten()], names=[*others, "runs", "collapsed"])

    out = rows.mapInArrow(found, T.StructType([*kept.schema.fields, *FOUND.fields]))
    return out.select(*(F.col(f"`{c}`") for c in others), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def _found(column: pa.Array, min_length: int, min_periods: int) -> pa.Array:
    counts, starts, lengths, periods, bodies = [], [], [], [], []
    lot: list[list[bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal lot, held
        codes = pa.array([w for ws in lot for w in ws], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        edges = np.cumsum([len(ws) for ws in lot])[:-1]
        own, start, length, period = find_runs(np.split(codes, edges), min_length, min_periods)
        counts.append(np.bincount(own, minlength=len(lot)))
        for out, x in ((starts, start), (lengths, length), (periods, period)):
            out.append(x)
        bounds = np.searchsorted(own, np.arange(len(lot) + 1))
        for k, ws in enumerate(lot):
            mine = slice(bounds[k], bounds[k + 1])
            if mine.start < mine.stop:
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, start[mine] + period[mine], 1)
                np.add.at(edge, start[mine] + length[mine], -1)
                ws = [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            bodies.append(b" ".join(ws))
        lot, held = [], 0

    for value in column:
        ws = value.as_py().split()
        if lot and held + len(ws) > LOT_WORDS:
            flush()
        lot.append(ws)
        held += len(ws)
    if lot:
        flush()
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, starts, lengths, periods)]
    offsets = np.concatenate([[0], np.cumsum(joined[0])]).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in joined[1:]], names=["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(bodies, pa.binary())], names=["runs", "collapsed"])
