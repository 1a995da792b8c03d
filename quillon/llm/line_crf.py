"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is a place in the chain and is good or bad. A place's evidence is its own line's features and
those of the line before and after; neighbouring labels are tied by transition weights. Forward-backward gives every
line's probability of being good, and a document's score is their mean, weighted by the lines' lengths.

Learning is by the likelihood of the chain in which every line has its document's label, on a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import release, trim_worker

SLICE_CHARS = 500_000
#: The base features of a line, in order; the values are shares from 0 to 1 or are scaled to about that.
FEATURES = ("symbols", "capitals", "digits", "marks", "shouts", "bars", "same_word", "long_words", "closed", "length", "repeated_line", "marked_words")

_LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _MARK = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isalpha():
            table[b] |= _LETTER
        if b < 0x80 and c.isupper():
            table[b] |= _UPPER
        if b < 0x80 and c.isdigit():
            table[b] |= _DIGIT
        if b == 0x20 or 9 <= b <= 13:
            table[b] |= _SPACE
        if c in "#*$%&|<>=~^@\\_{}[]":
            table[b] |= _SYMBOL
        if c in ".,;:!?'\"()-/":
            table[b] |= _MARK
    return table


_CLASS = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines of all texts: features (with the neighbours'), the text each belongs to, its length in bytes."""
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
    kind = _CLASS[raw]
    newline = raw == 10
    line = np.cumsum(newline) - newline
    n_lines = int(newline.sum())
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), per_text)

    def total(hit: np.ndarray) -> np.ndarray:
        return np.bincount(line[hit], minlength=n_lines).astype(np.float64)

    solid = kind & _SPACE == 0
    size = total(solid)
    full = size > 0
    before_space = np.concatenate([[True], ~solid[:-1]])
    starts = np.nonzero(solid & before_space)[0]
    upper = kind & _UPPER > 0
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    letters, uppers = total((kind & _LETTER > 0) & (raw & 0xC0 != 0x80)), total(upper)
    symbols, digits, marks = total(kind & _SYMBOL > 0), total(kind & _DIGIT > 0), total(kind & _MARK > 0)
    doubled = np.concatenate([[False], (raw[1:] == raw[:-1]) & (kind[1:] & (_SYMBOL | _MARK) > 0)])
    shouts, bars = total(doubled & (raw == 0x21)), total(raw == 0x7C)
    words = np.bincount(line[starts], minlength=n_lines).astype(np.float64) if len(starts) else np.zeros(n_lines)
    same, long_words, marked = np.zeros(n_lines), np.zeros(n_lines), np.zeros(n_lines)
    closed, repeated = np.zeros(n_lines), np.zeros(n_lines)
    if len(starts):
        ends = np.nonzero(solid & np.concatenate([~solid[1:], [True]]))[0] + 1
        length = ends - starts
        place = np.zeros(len(raw), np.int64)
        place[starts] = starts
        place = np.arange(len(raw)) - np.maximum.accumulate(place)
        with np.errstate(over="ignore"):
            mixed = (raw.astype(np.uint64) + np.uint64(1)) * _powers(int(place[solid].max()) + 1)[np.where(solid, place, 0)]
            mixed[~solid] = 0
            word = np.add.reduceat(mixed, starts)
            word = (word ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            own = line[starts]
            twin = np.concatenate([[False], (word[1:] == word[:-1]) & (own[1:] == own[:-1])])
            same = np.bincount(own[twin], minlength=n_lines)
            long_words = np.bincount(own[length > 20], minlength=n_lines)
            marked = np.bincount(own[doubled[ends - 1]], minlength=n_lines)
            last = np.concatenate([own[1:] != own[:-1], [True]])
            closed[own[last]] = np.isin(raw[ends[last] - 1], np.frombuffer(b".!?:;\"')", np.uint8))
            turn = word * (np.arange(len(word)) - np.searchsorted(own, own) + 1).astype(np.uint64)
            whole = np.zeros(n_lines, np.uint64)
            np.add.at(whole, own, turn)
        key = np.stack([owner.astype(np.uint64), whole], 1)[full]
        _, first, back = np.unique(key, axis=0, return_index=True, return_inverse=True)
        repeated[full] = first[back.ravel()] != np.arange(len(key))
    safe = np.maximum(size, 1)
    per_word = np.maximum(words, 1)
    base = np.stack([symbols / safe, uppers / np.maximum(letters, 1), digits / safe, marks / safe, shouts / per_word, bars / per_word, same / per_word, long_words / per_word, closed, np.log1p(size) / 8, repeated, marked / per_word], 1)
    x, who = base[full], owner[full]
    start = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
    end = np.concatenate([start[1:], [True]]) if len(who) else start
    prior = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]) * ~start[:, None] if len(who) else x
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]))]) * ~end[:, None] if len(who) else x
    joined = np.hstack([x, prior, after, start[:, None], end[:, None], np.ones((len(x), 1))]).astype(np.float64)
    return joined, who, size[full]


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


@dataclass
class LineCRF:
    """emission: one weight per feature for label good against bad; transition[a, b]: from label a to label b (1 is good)."""

    emission: np.ndarray
    transition: np.ndarray
    prior: float

    def marginals(self, x: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        return _forward_backward(x @ self.emission, self.transition, _Chains(who))[0]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's score, and each non-blank line's probability and text; a text without such lines scores 0."""
        x, who, size = line_features(texts)
        if not len(x):
            return np.zeros(len(texts)), np.zeros(0), who
        good = self.marginals(x, who)
        weight = np.bincount(who, size, minlength=len(texts))
        summed = np.bincount(who, size * good, minlength=len(texts))
        return np.clip(np.where(weight > 0, summed / np.maximum(weight, 1), 0.0), 0, 1), good, who


class _Chains:
    """Lines of several documents, worked on in step: the k-th lines of all documents that have one, longest first."""

    def __init__(self, who: np.ndarray) -> None:
        first = np.nonzero(np.concatenate([[True], who[1:] != who[:-1]]))[0]
        n = np.diff(np.append(first, len(who)))
        order = np.argsort(-n, kind="stable")
        self.first, self.n = first[order], n[order]
        longest = int(self.n[0])
        self.active = np.searchsorted(-self.n, -np.arange(longest), side="left")  # documents with more than k lines


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _forward_backward(good: np.ndarray, t: np.ndarray, chains: _Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) per line, the expected transitions (2 x 2), and the log partition summed over documents.

    good: the evidence for label 1 of each line; label 0 has 0.
    """
    n = len(good)
    f0, f1, b0, b1 = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    first = chains.first
    f1[first] = good[first]
    for k in range(1, len(chains.active)):
        at = first[: chains.active[k]] + k
        p0, p1 = f0[at - 1], f1[at - 1]
        f0[at] = _lse(p0 + t[0, 0], p1 + t[1, 0])
        f1[at] = _lse(p0 + t[0, 1], p1 + t[1, 1]) + good[at]
    for k in range(len(chains.active) - 1, 0, -1):
        at = first[: chains.active[k]] + k
        n0, n1 = b0[at], b1[at] + good[at]
        b0[at - 1] = _lse(n0 + t[0, 0], n1 + t[0, 1])
        b1[at - 1] = _lse(n0 + t[1, 0], n1 + t[1, 1])
    z = _lse(f0 + b0, f1 + b1)
    p = np.exp(f1 + b1 - z)
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.nonzero(inner)[0]
    expected = np.zeros((2, 2))
    for a, f in ((0, f0), (1, f1)):
        for b, (back, e) in ((0, (b0, 0.0)), (1, (b1, good))):
            here = back[at] + (e[at] if b else 0.0)
            expected[a, b] = np.exp(f[at - 1] + t[a, b] + here - z[at]).sum()
    return p, expected, float(z[first].sum())


def fit(x: np.ndarray, who: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> LineCRF:
    """Maximise the mean log likelihood of the chains (label: 0 or 1 per line, the same within a document)."""
    chains = _Chains(who)
    docs = len(chains.first)
    prior = float(label[chains.first].mean())
    own = np.zeros((2, 2))
    pairs = np.nonzero(who[1:] == who[:-1])[0] + 1
    np.add.at(own, (label[pairs - 1], label[pairs]), 1)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    observed = x.T @ label
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        p, expected, _ = _forward_backward(x @ w, t, chains)
        slope = np.concatenate([observed - x.T @ p, (own - expected).ravel()]) / docs - ridge * np.concatenate([w, t.ravel()])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, t = w + step[:-4], t + step[-4:].reshape(2, 2)
    return LineCRF(w, t, prior)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = 4000, max_lines: int = 1000) -> LineCRF:
    """Learn from the documents that `labels` marks 0 or 1 by their id; nulls in id, label or text take no part.

    max_docs bounds the labels used: of more, about those with the smallest hashes of their id. They are broadcast to
    the documents, so no text moves. Of a document of more than max_lines non-blank lines, that many consecutive ones
    are learnt from, from a place that its text's checksum picks; neighbours' features are of the whole text. Without lines
    of both labels, every line is as good as the labels' mean (1/2 without labels).
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("label")).where("__id IS NOT NULL AND label IN (0, 1)").distinct()
    cells = 1 << 20
    share = min(cells, -(-max_docs * cells // max(1, known.count())))
    known = known.where(F.pmod(F.xxhash64("__id"), F.lit(cells)) < share)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "__id")
    chosen = rows.where(F.col("text").isNotNull()).select("text", "label")
    width = 3 * len(FEATURES) + 3

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                x, who, _ = line_features(texts[a:b])
                for d in np.unique(who):
                    own = x[who == d]
                    at = zlib.crc32(texts[a + d].encode("utf-8", "surrogatepass")) % max(1, len(own) - max_lines + 1)
                    own = np.ascontiguousarray(own[at : at + max_lines], np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([labels[a + d]], pa.int32()), pa.array([own.tobytes()])], names=["label", "x"])

    found = chosen.mapInArrow(features, "label int, x binary").collect()  # at most about max_docs rows of max_lines lines
    found.sort(key=lambda r: (r["label"], bytes(r["x"])))
    labels = np.array([r["label"] for r in found], np.int64)
    if not len(labels) or labels.min() == labels.max():
        mean = float(labels.mean()) if len(labels) else 0.5
        odds = np.log((mean + 1e-6) / (1 - mean + 1e-6))
        return LineCRF(np.concatenate([np.zeros(width - 1), [odds]]), np.zeros((2, 2)), mean)
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, width).astype(np.float64) for r in found]
    who = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    model = fit(np.vstack(parts), who, labels[who])
    del found, parts
    release(docs.sparkSession)
    return model


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def score(text: Column, model: LineCRF) -> Column:
    """The quality of every whole text, from 0 to 1; null texts and those without a non-blank line score 0."""

    @F.pandas_udf(T.DoubleType())
    def scored(column):
        import pandas as pd

        trim_worker()
        texts = [t or "" for t in column]
        return pd.Series(np.concatenate([model.scores(texts[a:b])[0] for a, b in _slices(texts)]) if texts else np.zeros(0))

    return scored(text)


def line_scores(text: Column, model: LineCRF) -> Column:
    """The probabilities of being good of every text's non-blank lines, in order; none for null texts."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(column):
        import pandas as pd

        out = []
        texts = [t or "" for t in column]
        for a, b in _slices(texts):
            _, good, who = model.scores(texts[a:b])
            out += [good[who == k].tolist() for k in range(b - a)]
        return pd.Series(out)

    return scored(text)
