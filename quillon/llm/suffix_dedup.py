"""Removal of byte strings that occur more than once in a corpus, by suffix arrays over blocks of it.

Where two strings of `length` bytes are equal, so is the smallest hash of their inner 32-byte strings, and where it
lies. Every start in a text is routed by that hash, its anchor, so equal strings meet in one block; starts whose anchor
occurs once in the corpus cannot repeat and go nowhere. Consecutive starts with one anchor travel as a run with the
bytes they cover.

In a block, the runs' texts are one string whose suffixes are sorted in two stages: only the suffixes smaller than
their successors are sorted directly, by eight bytes at a time within the groups still tied; scanning the buckets of
first bytes in order then induces the place of every other suffix from its successor's. Neighbours with a common
prefix of `length` bytes are repeats.

Texts that are equal as a whole are one text in all of this, and equal runs of one anchor one run. Anchors and runs
are counted by aggregates that tasks begin before anything is shuffled, and joined back to their places, so an anchor
that a third of all texts share is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import carries_columns, discard, materialise, release, trim_worker

ANCHOR = 32
#: Texts are hashed in segments of so many bytes, which overlap by length - 1.
SEGMENT = 1 << 19
#: Bytes of distinct runs that a block holds before it is sorted, anchors being whole; sorting takes some 50 times as much.
BLOCK_BYTES = 1_000_000
#: Bytes of runs, copies included, for which there is a partition of anchors; it is sorted block by block.
PARTITION_BYTES = 8_000_000
#: Tables of at most so many rows are broadcast, larger ones shuffled.
MAX_BROADCAST_ROWS = 250_000

_ODD = 0x2545F4914F6CDD1D
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each position."""
    with np.errstate(over="ignore"):
        if not _powers or len(_powers[0]) < len(raw) + 1:
            n = max(len(raw) + 1, SEGMENT + 4096)
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_ODD, _INVERSE)]
        ahead, back = _powers
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * ahead[: len(raw)])])
        h = (total[ANCHOR:] - total[:-ANCHOR]) * back[: len(raw) - ANCHOR + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchor_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: for each run of starts with one anchor the text's number, the anchor, the first and the last start."""
    out: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        raw = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        sizes = np.array([len(g[2]) for g in group])
        first = np.cumsum(sizes) - sizes
        h = _hashes(raw)
        width = length - ANCHOR + 1
        low = np.uint64((1 << 24) - 1)
        best = _window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width)
        anchor = (best & low).astype(np.int64)
        where = np.repeat(np.arange(len(group)), sizes)[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= (first + sizes)[where]
        turn = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (where[1:] != where[:-1]) | (valid[1:] != valid[:-1])])
        starts = np.nonzero(turn)[0]
        stops = np.concatenate([starts[1:], [len(anchor)]]) - 1
        ok = valid[starts]
        starts, stops = starts[ok], stops[ok]
        own = where[starts]
        text = np.array([g[0] for g in group])[own]
        shift = np.array([g[1] for g in group])[own] - first[own]
        out.append((text, h[anchor[starts]], starts + shift, stops + shift))
        group, held = [], 0

    for k, t in enumerate(texts):
        for base in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t[base : base + SEGMENT + length - 1]
            if len(part) < length:
                continue
            group.append((k, base, part))
            held += len(part)
            if held >= SEGMENT:
                flush()
    flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _words(raw: np.ndarray) -> np.ndarray:
    """raw as a view of eight bytes from each position, most significant first; raw must be padded by eight."""
    return np.ndarray(len(raw) - 7, ">u8", buffer=raw, strides=(1,))


def sort_two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions (a mask over text) in the order of their suffixes' first `depth` bytes.

    text must end in a byte 0 followed by a byte 255 (not wanted) and depth + 8 bytes of padding beyond the mask.
    Suffixes that agree to `depth` bytes are next to each other in any order.
    """
    n = len(wanted)
    change = np.nonzero(text[: n - 1] != text[1:n])[0]
    at = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
    rising = text[at] < text[at + 1]  # the suffix is smaller than its successor
    rising[n - 1] = True
    inside = wanted.copy()
    # an induced suffix needs its successor, and so on up to one that is sorted directly
    rises = np.nonzero(rising)[0]
    need = np.nonzero(wanted & ~rising & ~np.append(wanted[1:], False))[0]
    upto = rises[np.searchsorted(rises, need)]
    extra = np.repeat(need, upto - need) + 1
    extra += np.arange(len(extra)) - np.repeat(np.cumsum(upto - need) - (upto - need), upto - need)
    inside[extra] = True
    direct = _sort_direct(text, np.nonzero(inside & rising)[0], depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    falling = inside & ~rising
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts = buckets[c]
        current = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        chain = [current]
        while len(current):  # equal bytes before a smaller one: suffixes of the same bucket, in turn
            current = current[current > 0] - 1
            current = current[falling[current] & (text[current] == c)]
            chain.append(current)
        order = np.concatenate([*chain, direct[bounds[c] : bounds[c + 1]]])
        if not len(order):
            continue
        out.append(order)
        before = order[order > 0] - 1
        before = before[falling[before] & (text[before] > c)]
        if len(before):
            by_byte = text[before]
            turn = np.argsort(by_byte, kind="stable")
            before, by_byte = before[turn], by_byte[turn]
            edges = np.nonzero(np.diff(by_byte))[0] + 1
            for part in np.split(before, edges):
                buckets[text[part[0]]].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def _sort_direct(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places by the `depth` bytes from each: eight at a time, within the groups that are still tied and not all equal."""
    view = _words(text)
    key = view[places].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    group = np.cumsum(~same)
    for at in range(8, depth, 8):
        tied = same | np.append(same[1:], False)
        slots = np.nonzero(tied)[0]
        if not len(slots):
            break
        p, g = places[slots], group[slots]
        key = view[p + at].astype(np.uint64)
        inner = np.concatenate([[False], g[1:] == g[:-1]])
        odd = inner & np.concatenate([[False], key[1:] != key[:-1]])
        mixed = np.isin(g, np.unique(g[odd])) if odd.any() else np.zeros(len(g), bool)
        if mixed.any():
            s, k = slots[mixed], key[mixed]
            turn = np.lexsort((k, g[mixed]))
            places[s] = places[s][turn]
            k, gg = k[turn], g[mixed][turn]
            same[s] = np.concatenate([[False], (k[1:] == k[:-1]) & (gg[1:] == gg[:-1])])
            group = np.cumsum(~same)
    return places


def repeated_starts(runs: list[bytes], length: int) -> list[np.ndarray]:
    """For each run the mask of its starts whose `length` bytes also start elsewhere among all runs."""
    joined = b"\x00".join(runs) + b"\x00\xff"
    sizes = np.array([len(r) for r in runs], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(joined + bytes(length + 16), np.uint8)
    starts_of = sizes - length + 1
    wanted = np.zeros(len(joined), bool)
    edge = np.zeros(len(joined) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + starts_of, -1)
    wanted = np.cumsum(edge[:-1]) > 0
    order = sort_two_stage(text, wanted, length)
    equal = np.ones(max(0, len(order) - 1), bool)
    view, live = _words(text), np.arange(len(equal))
    for at in [*range(0, length - 7, 8), length - 8]:
        hit = view[order[live] + at] == view[order[live + 1] + at]
        equal[live[~hit]] = False
        live = live[hit]
        if not len(live):
            break
    mask = np.zeros(len(joined), bool)
    mask[order[:-1][equal]] = True
    mask[order[1:][equal]] = True
    return [mask[f : f + n] for f, n in zip(first.tolist(), starts_of.tolist(), strict=True)]


def _intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _find_runs(texts: DataFrame, length: int) -> DataFrame:
    """anchor, th, first, last of every run of every text; a text once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        for ths, anchor, first, last in _runs_of(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ths), pa.array(first), pa.array(last)], names=["anchor", "th", "first", "last"])

    return texts.mapInArrow(run, "anchor long, th long, first long, last long")


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """anchor, th, many per task and batch of texts: each anchor once, with one of its texts, and whether it has several runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        for ths, anchor, _, _ in _runs_of(batches, length):
            values, at, n = np.unique(anchor, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ths[at]), pa.array(n > 1)], names=["anchor", "th", "many"])

    return texts.mapInArrow(run, "anchor long, th long, many boolean")


def _runs_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """th, anchor, first, last of the runs, by batch; texts seen before in the task are left out."""
    seen: set[int] = set()
    for batch in batches:
        ids, bodies = [], []
        for th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if th not in seen:
                seen.add(th)
                ids.append(th)
                bodies.append(t)
        text, anchor, first, last = anchor_runs(bodies, length)
        if len(text):
            yield np.array(ids, np.int64)[text], anchor, first, last


def _with_bytes(runs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The runs with a hash of the bytes they cover, their number of starts, and once per task and hash the bytes."""
    lists = runs.groupBy("th").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))  # within one text
    ids = runs.select("th").distinct()
    few = ids.count() <= MAX_BROADCAST_ROWS
    chosen = texts.join(F.broadcast(ids) if few else ids, "th", "left_semi").dropDuplicates(["th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for th, body, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                flat = found.values
                anchor, first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for at in range(0, len(first), 20_000):
                    part = slice(at, at + 20_000)
                    cut = [body[f : t + length] for f, t in zip(first[part].tolist(), last[part].tolist(), strict=True)]
                    digest = [int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little", signed=True) for c in cut]
                    once: list[bytes | None] = []
                    for key, c in zip(zip(anchor[part].tolist(), digest, strict=True), cut, strict=True):
                        once.append(None if key in sent else c)
                        sent.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(digest, pa.int64()), pa.array([th] * len(cut), pa.int64()), pa.array(first[part]), pa.array(last[part] - first[part] + 1), pa.array(once, pa.binary())], names=["anchor", "digest", "th", "first", "starts", "bytes"])

    return chosen.join(lists, "th").select("th", "body", "runs").mapInArrow(run, "anchor long, digest long, th long, first long, starts long, bytes binary")


def _repeats(rows: DataFrame, length: int) -> DataFrame:
    """anchor, digest, f, t: the ranges of starts, within a run, of strings that repeat among the distinct runs.

    rows (anchor, digest, bytes) must be sorted by anchor, each anchor in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        keys: list[tuple[int, int]] = []
        runs: list[bytes] = []
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held
            found = [(*k, a, b) for k, mask in zip(keys, repeated_starts(runs, length), strict=True) for a, b in _intervals(mask)]
            keys.clear()
            runs.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["anchor", "digest", "f", "t"])

        for batch in batches:
            for anchor, digest, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if anchor != last and held >= BLOCK_BYTES:
                    yield flush()
                last = anchor
                keys.append((anchor, digest))
                runs.append(body)
                held += len(body)
        if runs:
            yield flush()

    return rows.mapInArrow(run, "anchor long, digest long, f long, t long")


def find_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """th, spans for every text (th: xxhash64 of it) with bytes to remove: maximal ranges [from, to), in order.

    A byte goes if a string of `length` bytes over it also starts anywhere else in the corpus, the same text included.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    texts = docs.select(body.alias("body")).where(F.octet_length("body") >= length).select(F.xxhash64("body").alias("th"), "body")
    whole = texts.groupBy("th").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("body")).cast("long").alias("size")).where("n > 1")
    whole = materialise(whole.select("th", "size"), "suffix-copies")
    seen = _anchors(texts, length).groupBy("anchor").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("many").alias("many"))
    repeated = seen.where("many OR lo <> hi").select("anchor")
    met = materialise(_find_runs(texts, length).join(repeated, "anchor").distinct(), "suffix-runs")
    total = met.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + length), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // PARTITION_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = materialise(_with_bytes(met, texts, length), "suffix-bytes")
    discard(met)
    release(docs.sparkSession)
    # equal runs are one run here; where there are several, all their starts repeat
    distinct = routed.groupBy("anchor", "digest").agg(F.max("bytes").alias("bytes"))
    found = _repeats(distinct.select("anchor", "digest", "bytes").repartition(blocks, "anchor").sortWithinPartitions("anchor"), length)
    members = routed.select("anchor", "digest", "th", "first", "starts")
    several = members.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("starts").alias("starts")).where("n > 1")
    parts = materialise(found.join(several, ["anchor", "digest"], "left_anti").unionByName(several.select("anchor", "digest", F.lit(0).cast("long").alias("f"), F.col("starts").alias("t"))), "suffix-parts")
    met_parts = members.join(parts, ["anchor", "digest"])
    ranges = materialise(met_parts.select("th", (F.col("first") + F.col("f")).alias("f"), (F.col("first") + F.col("t") - 1 + length).alias("e")), "suffix-ranges")
    discard(routed)
    discard(parts)
    release(docs.sparkSession)
    by_text = W.partitionBy("th").orderBy("f", "e")
    upto = F.max("e").over(by_text.rowsBetween(W.unboundedPreceding, -1))
    islands = ranges.withColumn("new", F.when(F.col("f") > F.coalesce(upto, F.lit(-1)), 1).otherwise(0)).withColumn("island", F.sum("new").over(by_text.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("th", "island").agg(F.min("f").alias("f"), F.max("e").alias("e"))
    spans = spans.join(whole, "th", "left_anti").select("th", "f", "e").unionByName(whole.select("th", F.lit(0).cast("long").alias("f"), F.col("size").alias("e")))
    out = materialise(spans.groupBy("th").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("spans")), "suffix-spans")
    discard(ranges)
    return out


@carries_columns
def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """docs with n_bytes, spans (array of f, e: the maximal removed ranges of bytes) and kept (the remaining bytes).

    Columns of these names are replaced. Texts are judged as UTF-8, nulls as empty; a text shorter than `length`, and
    one that shares nothing, keeps all its bytes. Rows with equal texts are copies of each other, whatever their ids.
    """
    found = find_repeats(docs, text, length)
    n, spans = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    few = n <= MAX_BROADCAST_ROWS and spans <= 4 * MAX_BROADCAST_ROWS
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    names = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), body.alias("__body")).withColumn("__th", F.xxhash64("__body"))
    found = found.select(F.col("th").alias("__th"), "spans")
    joined = keyed.join(F.broadcast(found) if few else found, "__th", "left")
    joined = joined.withColumn("spans", F.when(F.octet_length("__body") >= length, F.col("spans")))
    size = F.octet_length("__body").cast("long")
    # the bytes between one span's end and the next one's start
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.e"))
    stops = F.concat(F.col("spans.f"), F.array(size))
    gaps = F.zip_with(starts, stops, lambda a, b: F.substring(F.col("__body"), (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.when(F.col("spans").isNull(), F.col("__body")).otherwise(F.aggregate(gaps, F.lit(b""), lambda a, x: F.concat(a, x)))
    return joined.select(*(F.col(f"`{c}`") for c in names), size.alias("n_bytes"), F.coalesce("spans", F.expr("array()").cast("array<struct<f:bigint,e:bigint>>")).alias("spans"), kept.alias("kept"))


def as_text(kept: Column, original: Column) -> Column:
    """The kept bytes as a string; characters of which a cut left only some bytes go, as nothing else does."""
    valid = F.make_valid_utf8(kept.cast("string"))
    return F.when(F.contains(original, F.lit("\ufffd")), valid).otherwise(F.replace(valid, F.lit("\ufffd"), F.lit("")))
