"""Token ids by a public tokenizer, and a binary table of ids in Simple-8b words.

Encoding: a tokenizer whose normaliser and splitter are the known ones (SPLITTING) never joins anything across a space
or a line feed, so texts are cut at those, the distinct pieces of a slice are found by Arrow, and each is encoded once;
a bounded cache keeps the ids of pieces seen before. Texts for any other tokenizer are encoded whole.

File format: a folder of Parquet files whose rows are chunks of whole documents in ascending order. A chunk holds the
documents' ids and lengths, the ids as 64-bit words, and the word offset of each block of BLOCK ids. A word's top four
bits select how many values share the other 60 bits (SELECTORS); selector 1 is an escape: the next word is one raw
64-bit value. Blocks start on a word, so they decode independently and a chunk decodes by whole arrays.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import materialise, trim_worker

#: Fixed values of the format: selector -> (values in a word, bits of each); None marks the escape.
SELECTORS = [(240, 0), None, (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 1
BLOCK = 512
CHUNK_IDS = 1 << 17
#: Texts are encoded in slices of about so many bytes; the cache is emptied beyond so many pieces or characters of them.
SLICE_BYTES, CACHE_PIECES, CACHE_CHARS = 4_000_000, 600_000, 12_000_000
#: Letters that lower-casing and composing leave single letters, whatever stands beside them.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Tables of at most so many parts have their parts' bases broadcast.
MAX_BROADCAST_PARTS = 1_000_000
#: The normaliser and splitter for which pieces between spaces and line feeds are encoded one by one.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Places(dict):
    """string -> its place in a table; unknown strings get the next place and are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


class _Ragged:
    """A growing list of id runs."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used += len(ids)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at these places, one after another, and their lengths."""
        lengths = self.length[places]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.start[places] - (ends - lengths), lengths)
        shift += np.arange(len(shift))
        return self.flat[shift], lengths


class PieceEncoder:
    """encode(texts) gives all ids (uint32) and each text's number of ids, as the tokenizer's encode() would.

    A piece of LATIN letters is one word to the tokenizer's model, and so is one before a closing full stop or comma;
    the model is asked for its lower-case form directly. Other letters may become a letter and a mark, which the
    tokenizer joins to what follows, so every other piece goes through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        self.cuts = all(described[k] == v for k, v in SPLITTING.items())
        self.model, self.plain = self.tokenizer.model, re.compile(f"([{LATIN}]+)([.,]?)").fullmatch
        spelt = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelt(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self._clear()

    def _clear(self) -> None:
        self.pieces, self.chars, self.piece_ids = _Places(), 0, _Ragged()

    def _word(self, word: str) -> list[int]:
        word = word.lower()
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelling))]

    def _learn(self) -> None:
        """Take the ids of the pieces that are new."""
        new, self.pieces.new = self.pieces.new, []
        tails = {"": [], ".": self._word("."), ",": self._word(",")}
        ids = [self._word(m[1]) + tails[m[2]] if (m := self.plain(piece)) else None for piece in new]
        others = [k for k, found in enumerate(ids) if found is None]
        for k, e in zip(others, self.tokenizer.encode_batch_fast([new[k] for k in others], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.piece_ids.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)
        self.chars += sum(map(len, new))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at, end in slices(column):
            ids, n = self._slice(column.slice(at, end - at))
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)

    def _slice(self, texts: pa.Array, cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n
        if cut and len(texts) == 1 and len(texts[0].as_buffer()) > 2 * SLICE_BYTES:  # a long text, part by part
            parts = [self._slice(pa.array([part], pa.string()), False) for part in _at_spaces(texts[0].as_py())]
            return np.concatenate([ids for ids, _ in parts]), np.array([sum(int(n[0]) for _, n in parts)], np.int64)
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        sizes = pc.list_value_length(pieces).to_numpy().astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        if len(self.pieces) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self._clear()
        places = np.fromiter(map(self.pieces.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if self.pieces.new:
            self._learn()
        ids, lengths = self.piece_ids.take(places[coded.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        return ids, np.diff(upto, prepend=0)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts (without nulls) of about SLICE_BYTES; a longer text is one by itself."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + SLICE_BYTES, side="right")))
        yield at, end
        at = end


def _at_spaces(text: str) -> Iterator[str]:
    """text in parts of about SLICE_BYTES characters, cut before a space; a part without one is longer."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; its cache lasts as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each document's."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def pack_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (unsigned, below 2^64) as Simple-8b words, and the word offset of each block of BLOCK values.

    All blocks are packed in step: the k-th round places the k-th word of every block that has values left, taking the
    selector that covers the most of them. Places after a block's end count as zeros.
    """
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    n_blocks = -(-n // BLOCK)
    ends = np.minimum(np.arange(1, n_blocks + 1) * BLOCK, n)
    bits = _needed(values)
    best = np.full(n, ESCAPE, np.uint8)
    places = np.arange(n, dtype=np.int32)
    end_of = np.repeat(ends, np.diff(ends, prepend=0)).astype(np.int32)
    for selector in range(len(SELECTORS) - 1, -1, -1):  # narrower selectors, which hold more, overwrite wider ones
        if selector == ESCAPE:
            continue
        count, width = SELECTORS[selector]
        fits = bits <= width
        if not fits.any():
            break
        next_wide = np.minimum.accumulate(np.where(fits, np.int32(n), places)[::-1])[::-1]
        best[next_wide >= np.minimum(places + np.int32(count), end_of)] = selector
    held = np.array([1 if s is None else s[0] for s in SELECTORS], np.int64)
    at, open_blocks = np.arange(n_blocks) * BLOCK, np.arange(n_blocks)
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    while len(open_blocks):
        rounds.append((at, open_blocks))
        at = at + held[best[at]]
        left = at < ends[open_blocks]
        at, open_blocks = at[left], open_blocks[left]
    at = np.sort(np.concatenate([a for a, _ in rounds]))
    selector = best[at]
    size = np.where(selector == ESCAPE, 2, 1)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[to] = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        own = np.nonzero(selector == s)[0]
        if s == ESCAPE:
            words[to[own] + 1] = values[at[own]]
            continue
        count, width = SELECTORS[s]
        last = end_of[at[own]]
        for k in range(count if width else 0):
            place = at[own] + k
            inside = place < last
            words[to[own[inside]]] |= values[place[inside]] << np.uint64(k * width)
    return words, to[np.searchsorted(at, np.arange(n_blocks) * BLOCK)].astype(np.uint32)


def _needed(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs."""
    bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    large = np.nonzero(bits > 52)[0]  # where the conversion may have rounded up
    bits[large] = [int(v).bit_length() for v in values[large].tolist()]
    return bits


def unpack_words(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values that pack_words() packed."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for p in np.nonzero(selector == ESCAPE)[0]:
        if not raw[p]:
            raw[p + 1] = True
    held = np.array([0 if s is None else s[0] for s in SELECTORS], np.int64)[selector]
    held[selector == ESCAPE] = 0
    held[raw] = 1
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    upto = np.cumsum(held) - held
    place = upto - upto[offsets.astype(np.int64)][block] + block * BLOCK
    ends = np.minimum((block + 1) * BLOCK, n)
    out[place[raw]] = words[raw]
    for s in np.unique(selector[~raw]):
        if s == ESCAPE or not SELECTORS[s][1]:
            continue
        count, width = SELECTORS[s]
        own = np.nonzero((selector == s) & ~raw)[0]
        values = (words[own][:, None] >> (np.arange(count) * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
        places = place[own][:, None] + np.arange(count)
        inside = places < ends[own][:, None]
        out[places[inside]] = values[inside]
    return out


def write_ids(docs: DataFrame, vocabulary: str, name: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write the ids to a table in the file format, in ascending order of id; gives that table.

    Null texts count as empty and hold the end id only; a null id comes first; rows with equal ids are ordered by a
    hash of their text. Rows: part and chunk give the order, before counts the ids of the part's earlier chunks.
    """
    ordered = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = ordered.withColumn("__tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trim_worker(keep=True)
        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        names, ids, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, sizes, held, chunk, before
            values = np.concatenate(ids)
            packed, offsets = pack_words(values)
            row = {"part": [part], "chunk": [chunk], "before": [before], "n_ids": [len(values)], "doc_ids": [names], "sizes": [sizes], "offsets": [offsets.tobytes()], "words": [packed.tobytes()]}
            chunk, before = chunk + 1, before + len(values)
            names, ids, sizes, held = [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=CHUNK_ARROW)

        for batch in batches:
            for first, last in slices(batch.column(1)):
                values, counts = with_end(*encoder(vocabulary).encode(batch.column(1).slice(first, last - first)), end_id)
                upto, at = np.cumsum(counts), 0
                keys = batch.column(0).slice(first, last - first).to_pylist()
                while at < len(counts):  # as many documents as fill the chunk
                    base = int(upto[at - 1]) if at else 0
                    end = min(len(counts), int(np.searchsorted(upto, base + CHUNK_IDS - held)) + 1)
                    names += keys[at:end]
                    sizes += counts[at:end].tolist()
                    ids.append(values[base : upto[end - 1]])
                    held += int(upto[end - 1]) - base
                    at = end
                    if held >= CHUNK_IDS:
                        yield flush()
        if names:
            yield flush()

    return materialise(ordered.mapInArrow(encode, CHUNK_SCHEMA), name)


CHUNK_SCHEMA = "part int, chunk int, before long, n_ids long, doc_ids array<long>, sizes array<long>, offsets binary, words binary"
CHUNK_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("offsets", pa.binary()), ("words", pa.binary())])


def read_ids(table: DataFrame) -> DataFrame:
    """The documents of a table in the file format: doc_id, start (ids of all documents before it), n_tokens, ids.

    ids is binary: little-endian unsigned 32-bit integers.
    """
    by_part = table.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))  # one row per task that wrote
    base = by_part.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    few = by_part.count() <= MAX_BROADCAST_PARTS

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker(keep=True)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                start, n_ids, names, held, offsets, words = (row.column(i) for i in range(6))
                sizes = held.flatten().to_numpy()
                values = unpack_words(np.frombuffer(words[0].as_buffer(), np.uint64), np.frombuffer(offsets[0].as_buffer(), np.uint32), n_ids[0].as_py())
                ends = np.cumsum(sizes)
                bounds = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(values.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([names.flatten(), pa.array(start[0].as_py() + ends - sizes), pa.array(sizes), ids], names=["doc_id", "start", "n_tokens", "ids"])

    chunks = table.join(F.broadcast(base) if few else base, "part")
    return chunks.select(F.col("base") + F.col("before"), "n_ids", "doc_ids", "sizes", "offsets", "words").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
