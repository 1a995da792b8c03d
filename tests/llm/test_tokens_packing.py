"""Token ids, the Simple-8b format and packing: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pytest

from quillon.llm import packing, queries, tokens
from quillon.llm.tokens import pack_words, unpack_words

DOCS = [(5, "The cat, the CAT.\nIt's a <|endoftext|> test"), (2, None), (3, ""), (1, "word " * 9000), (5, "ΣΑΣ é ́x 12½ don't\x1cy"), (None, "no id"), (2, "dup"), (2, "dup")]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, ids int, start int, length int")


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_words_round_trip(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 3000))
    values = (r.integers(0, 1 << 63, n).astype(np.uint64) * 2 + 1) >> r.integers(0, 64, n).astype(np.uint64)
    values[r.random(n) < 0.2] = 0
    words, offsets = pack_words(values)
    assert (unpack_words(words, offsets, n) == values).all()
    assert len(offsets) == -(-n // tokens.BLOCK)


def test_runs_of_zeros_and_escapes():
    for values in (np.zeros(1000, np.uint64), np.array([2**64 - 1, 1, 2**60], np.uint64), np.zeros(0, np.uint64)):
        words, offsets = pack_words(values)
        assert (unpack_words(words, offsets, len(values)) == values).all()
    assert len(pack_words(np.zeros(512, np.uint64))[0]) == 3


def test_table_round_trip(spark):
    found = tokens.read_ids(tokens.write_ids(frame(spark), queries.vocabulary(), "t", 2)).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((d[0] for d in DOCS), key=lambda x: (x is not None, x or 0))
    want = sorted((d[0] is not None, d[0] or 0, zlib.crc32(np.array([*ids_of(d[1]), 2], "<u4").tobytes())) for d in DOCS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(bytes(r.ids))) for r in found) == want
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_empty_tables(spark):
    empty = frame(spark).limit(0)
    assert tokens.read_ids(tokens.write_ids(empty, queries.vocabulary(), "t", 2)).count() == 0
    assert packing.pack(packing.token_pieces(empty, queries.vocabulary(), 16), 16, ["doc_id"]).count() == 0


def test_pieces_and_packing(spark):
    rows = packing.pack(packing.token_pieces(frame(spark), queries.vocabulary(), 64), 64, ["doc_id", "piece"]).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(d[1])) + 1 for d in DOCS)
    bins = {}
    for r in rows:
        assert r.start == 64 * r.piece and 1 <= r.length <= 64
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_odd_lengths_get_no_sequence(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, None), (4, 11), (5, 10)], "doc_id long, length int")
    found = {r.doc_id: r.sequence_id for r in packing.pack(df, 10, ["doc_id"]).collect()}
    assert found[2] is None and found[3] is None and found[4] is None and found[1] is not None and found[5] is not None


@pytest.mark.parametrize("seed", range(8))
def test_schedule_is_near_the_bound(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 100): rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))}
    runs = packing.schedule(dict(counts), 100)
    fill, placed = {}, {}
    for length, first, n, sequence, offset in runs:
        for i in range(n):
            placed.setdefault(length, set()).add(first + i)
            fill.setdefault(sequence + i, []).append((offset, length))
    assert {k: len(v) for k, v in placed.items()} == counts and all(v == set(range(counts[k])) for k, v in placed.items())
    for parts in fill.values():
        assert sum(x for _, x in parts) <= 100
        assert all(a + x == b for (a, x), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False))
    bound = max(-(-sum(k * v for k, v in counts.items()) // 100), sum(v for k, v in counts.items() if k > 50))
    assert len(fill) <= 1.25 * bound + 2
