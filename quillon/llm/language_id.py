"""Language identification by n-gram filters whose entries are masks of languages.

Learning: character n-grams of the labelled texts are counted per language; a language's set holds the grams whose
share of its text is at least `min_share` and at least `dominance` of the largest share that any language has. All
sets go into one bit-sliced Bloom filter: row h of the filter is a mask with one bit per language, so the AND of the
rows that a gram hashes to names at once all languages whose set holds it.

Predicting: for each text, the grams found per language are counted (the popcount of each language's slice), and the
expected number of false positives, from the fill of that slice, is taken off. The language with the largest corrected
share wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Grams of these many characters, over lower-case letters with one space around each word.
SIZES = (3, 4)
#: Texts are worked on in slices of about so many characters.
SLICE_CHARS = 1_000_000


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form, if that is one code point, and whether it is a letter."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return lower, letter


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' grams, the text that each belongs to, and whether each text has a letter.

    Letters are kept in lower case, and of the other characters one space after each word; no gram has a space inside.
    """
    if not _tables:
        _tables.append(_letters())
    lower, letter = _tables[0]
    raw = np.frombuffer(("\x00" + "".join(t + "\x00" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.concatenate([np.zeros(1, np.int32), doc])
    is_letter = letter[raw]
    has = np.bincount(doc[is_letter], minlength=len(texts)) > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    word = is_letter[keep]
    code = np.where(word, lower[raw[keep]], 0).astype(np.uint64)
    doc = doc[keep]
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(code) - n + 1
            if m <= 0:
                continue
            inside = word[1 : m + 1].copy()
            for k in range(2, n - 1):
                inside &= word[k : k + m]
            at = np.nonzero(inside)[0]
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ code[at + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= h >> np.uint64(29)
            hashes.append(h)
            owners.append(doc[at + 1])
    return np.concatenate(hashes), np.concatenate(owners), has


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


@dataclass
class LanguageFilter:
    """languages in order of their bits; rows: one mask of ceil(languages / 64) words for each hash value."""

    languages: list[str]
    rows: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilter:
        """From each language's set of gram hashes."""
        languages = sorted(grams)
        largest = max([1, *(len(g) for g in grams.values())])
        size = 1 << max(10, int(8 * largest - 1).bit_length())
        rows = np.zeros((size, -(-max(1, len(languages)) // 64)), np.uint64)
        for bit, name in enumerate(languages):
            for at in cls._places(grams[name], size):
                rows[at, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        return cls(languages, rows)

    @staticmethod
    def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(size - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each gram hash the mask of all languages that (seem to) hold it."""
        one, two = self._places(hashes, len(self.rows))
        return self.rows[one] & self.rows[two]

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected share of the text's grams, and whether each text has a letter."""
        hashes, doc, has = gram_hashes(texts)
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        masks, out = self.masks(hashes), np.zeros((len(texts), len(self.languages)))
        for bit in range(len(self.languages)):
            column = self.rows[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
            false = float(column.mean()) ** 2
            hit = (masks[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)
            found = np.bincount(doc[hit], minlength=len(texts))
            out[:, bit] = np.clip((found - n * false) / (1 - false) / n, 0, 1) if false < 1 else 0
        return out, has


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 3000, min_share: float = 1e-5, dominance: float = 0.2, max_languages: int = 512) -> LanguageFilter:
    """Learn the filter from the rows whose text and lang are not null.

    docs_per_language bounds the rows used: of a language with more, those with the smallest hashes of their text, up
    to about that many. A set holds at most 1 / min_share grams, so the filter's size is bounded too. No usable row
    gives a filter without languages. More than max_languages languages are an error.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return LanguageFilter([], np.zeros((1024, 1), np.uint64))
    cells = 1 << 20
    keep = labelled.sparkSession.createDataFrame([(r["lang"], min(cells, -(-docs_per_language * cells // r["count"]))) for r in counts], "lang string, __cells long")
    chosen = rows.join(F.broadcast(keep), "lang").where(F.pmod(F.xxhash64("text"), F.lit(cells)) < F.col("__cells")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for at, end in _slices(texts):
                hashes, doc, _ = gram_hashes(texts[at:end])
                own = names[at:end][doc]
                for name in set(names[at:end]):
                    values, n = np.unique(hashes[own == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = grams.join(F.broadcast(total), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= min_share)
    by_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("in"))  # one entry per language
    kept = by_gram.select("gram", F.explode("in").alias("x"), "top").where(F.col("x.share") >= dominance * F.col("top")).select("x.lang", "gram").toPandas()
    sets = {r["lang"]: np.zeros(0, np.uint64) for r in counts}
    for name, part in kept.groupby("lang"):
        sets[name] = part["gram"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilter.build(sets)


def predict(text: Column, model: LanguageFilter) -> Column:
    """A struct of lang_pred and score for every whole text.

    score is the winner's corrected share of the text's grams, from 0 to 1; ties go to the first language by code
    point. Null texts, texts without a letter, and all texts under a model without languages give UNKNOWN and 0.
    """
    names = np.array([*model.languages, UNKNOWN], object)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def scored(column):
        import pandas as pd

        texts = [t or "" for t in column]
        won, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        for at, end in _slices(texts) if model.languages else ():
            shares, has = model.shares(texts[at:end])
            best = shares.argmax(axis=1)
            won[at:end] = np.where(has, best, len(names) - 1)
            score[at:end] = np.where(has, shares[np.arange(end - at), best], 0)
        return pd.DataFrame({"lang_pred": names[won], "score": score})

    return scored(text)
