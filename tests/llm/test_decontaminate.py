"""Benchmark passages against a plain search of windows: overlaps, short items, case, odd rows."""

import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from quillon.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("items", T.LongType())])
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=10):
    ws, hit, met = words(text), set(), set()
    for i, body in items:
        v = words(body)
        size = min(window, len(v))
        for a in range(len(v) - size + 1) if v else ():
            for b in range(len(ws) - size + 1):
                if ws[b : b + size] == v[a : a + size]:
                    hit.update(range(b, b + size))
                    met.add("" if i is None else str(i))
    return len(ws), len(hit), sorted(met), bool(hit)


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_plain_search(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_PRINTS", 0)
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WORDS", 0)
    random.seed(11)
    few = [f"w{i}" for i in range(4)]
    many = [f"é{i}" for i in range(300)]
    items = [(i, " ".join(random.choices(few if i % 3 else many, k=random.choice([1, 2, 5, 9, 10, 11, 25, 60]) if i < 24 else 30))) for i in range(30)]
    items += [(100, None), (101, ""), (102, " ... "), (None, items[20][1] + " end"), (7, items[7][1]), (7, "one more text of seven"), (103, "İ ß ǅ É")]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(random.randint(1, 4)):
            v = words(random.choice(items)[1])
            a = random.randrange(len(v) + 1)
            parts += random.choices(many, k=random.randint(0, 20)) + [w.upper() if random.random() < 0.3 and w.isascii() else w for w in v[a : a + random.randint(5, 40)]]
        docs.append((d, random.choice([" ", "-", "\n"]).join(parts)))
    docs += [(200, None), (201, ""), (202, "!!"), (None, items[5][1]), (3, docs[3][1]), (204, "i̇ ss ǆ é"), (205, "x " * 40_000 + items[25][1]), (206, "İ ß ǅ É")]
    frame = spark.createDataFrame([Row(doc_id=a, text=b, row="r", items=1) for a, b in docs], DOC)
    out = decontaminate.find_passages(frame, spark.createDataFrame([Row(item_id=a, text=b) for a, b in items], ITEM))
    assert out.columns == ["doc_id", "text", "row", "n_words", "n_hit", "spans", "items", "contaminated"]
    got = sorted((str(r.doc_id), r.text or "", r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out.collect())
    assert got == sorted((str(a), b or "", *plain(b, items)) for a, b in docs)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "r", 1)], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert decontaminate.find_passages(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in decontaminate.find_passages(docs, items.limit(0)).collect()] == [False]
    assert [r.contaminated for r in decontaminate.find_passages(docs, items).collect()] == [True]
