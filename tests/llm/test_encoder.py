"""The piece-wise encoder against the tokenizers library on texts made to hit its shortcuts' edges."""

import random

import numpy as np
import pyarrow as pa

from quillon.llm import queries, tokens

#: ASCII, Latin letters, letters that fold to a letter and a mark, combining marks, ligatures, Hangul, signs, blanks.
PARTS = [*"aZqe.,'!-09", "é", "ÿ", "ß", "À", "Þ", "×", "ª", "İ", "ŉ", "ſ", "Σ", "ﬁ", "K", "é", "́", "̧", "각", "ᄀ", "ᅡ", "क़", "ढ़", "יִ", "½", "²", "‍", " ", "\x85", "\x1c", "\t", "'s", "'LL", "<|endoftext|>", "日本", "🙂", "﻿", "ﷺ"]


def want(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(queries.vocabulary()).encode_batch(texts, add_special_tokens=False)]


def same(texts):
    ids, counts = tokens.PieceEncoder(queries.vocabulary()).encode(texts)
    found = np.split(ids, np.cumsum(counts)[:-1])
    for text, x, y in zip(texts, found, want(texts), strict=True):
        assert x.tolist() == y, repr(text)


def test_random_strings():
    rnd = random.Random(5)
    same([rnd.choice(["", " ", "\n"]).join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 6))) + rnd.choice(["", ".", ",", ".\n", "\r\n", " "]) for _ in range(100_000)])


def test_every_pair_of_latin_letters():
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    rnd = random.Random(6)
    same([rnd.choice(letters) + c + t for c in letters for t in ("", ".", ",", "..", "́", "́.")])


def test_slices_cuts_and_cache(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 64)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    rnd = random.Random(7)
    words = ["The", "cat,", "É.", "İ.", "x" * 200, "áb"]
    same(["".join(rnd.choice(words) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.randint(0, 300))) for _ in range(40)])


def test_another_tokenizer_encodes_whole_texts(monkeypatch):
    monkeypatch.setitem(tokens.SPLITTING, "normalizer", None)
    encoder = tokens.PieceEncoder(queries.vocabulary())
    assert not encoder.cuts
    texts = ["The cat, the CAT.\nIt's", "", "İ."]
    ids, counts = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want(texts)
