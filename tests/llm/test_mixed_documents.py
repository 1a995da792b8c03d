"""The mix's output rows: source totals against targets, texts against the drawn spans."""

import random
from collections import Counter

import pytest

from quillon.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, tag int")


@pytest.fixture(scope="module")
def hot():
    """A third of all documents in one source, whose share is far below a half, and documents of up to 1500 words."""
    rnd = random.Random(8)
    out = []
    for i in range(360):
        text = rnd.choice(["", " \n"]) + "".join(f"w{i}_{k}" + rnd.choice([" ", "\n", " \t "]) for k in range(rnd.choice([3, 40, 300, 1500])))
        out.append((i, text, "a" if i % 3 == 0 else f"s{i % 19:02d}", len(text), i))
    return out


def test_sources_meet_their_targets(spark, hot):
    docs = frame(spark, hot)
    found = mixing.mixed_documents(docs, n_chars="n_chars").collect()
    got = Counter()
    for r in found:
        got[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.tag == r.doc_id and r.text.strip() in hot[r.doc_id][1]
    sources = mixing.mix(docs).sources.collect()
    assert min(s.target / s.source_size for s in sources) < 0.3
    for s in sources:
        assert abs(got[s.source] - s.target) <= 2 * 128, (s.source, got[s.source], s.target)


def test_words_are_those_taken(spark, hot):
    docs = frame(spark, hot)
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got.update(r.text.split())
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(docs).documents.collect()}
    by_doc = Counter()
    for w, n in got.items():
        by_doc[int(w[1:].split("_")[0])] += n
        assert n <= mixing.MOST_REPEATS
    assert by_doc == Counter({d: t for d, (t, _) in taken.items() if t})


def test_equal_rows_and_nulls(spark):
    text = " ".join(f"w{k}" for k in range(700))
    rows = [(1, text, "a", 0, 1), (1, text, "a", 0, 2), (1, text, "b", 0, 3), (None, text, None, 0, 4), (None, text, "c", 0, 5), (2, "", "a", 0, 6), (3, None, None, 0, 7)]
    docs = frame(spark, rows)
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id, r.source] += len(r.text.split())
    want = Counter()
    for r in mixing.mix(docs).documents.collect():
        want[r.doc_id, r.source] += r.taken
    assert got == +want
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
