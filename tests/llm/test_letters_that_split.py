"""Words whose letters become a letter and a mark, before a full stop or comma: ids as the tokenizer's encode() gives them."""

import numpy as np
import pytest

from quillon.llm import queries, tokens

from .test_tokens_packing import frame, ids_of

WORDS = ["TÜRKİ", "İ", "ড়", "ঢ়", "কয়", "क़", "ड़", "य़", "יִ", "ײַ", "פֿ", "The", "é", "ΣΑΣ", "straße", "é"]


@pytest.mark.parametrize("tail", [".", ",", "", "..", ".\n"])
def test_pieces_as_the_tokenizer(tail):
    texts = [w + tail for w in WORDS] + [" ".join(w + tail for w in WORDS)]
    ids, counts = tokens.PieceEncoder(queries.vocabulary()).encode(texts)
    for text, found in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert found.tolist() == ids_of(text), text


def test_every_letter_before_a_full_stop():
    texts = [chr(c) + "." for c in range(128, 0x30000) if chr(c).isalpha()]
    ids, counts = tokens.PieceEncoder(queries.vocabulary()).encode(texts)
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(queries.vocabulary()).encode_batch(texts, add_special_tokens=False)
    assert counts.tolist() == [len(w.ids) for w in want]
    assert ids.tolist() == [i for w in want for i in w.ids]


def test_table_round_trip(spark):
    rows = [(i, w + ". " + w + ", x") for i, w in enumerate(WORDS)]
    found = tokens.read_ids(tokens.write_ids(frame(spark, rows), queries.vocabulary(), "t", 2)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found} == {i: [*ids_of(t), 2] for i, t in rows}
