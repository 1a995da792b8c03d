"""Periodic runs against a plain search over all periods, and odd rows."""

import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import types as T

from quillon.llm import periodic_runs


def plain(words, least):
    """Every maximal stretch of each period by comparing words p apart, the smallest period of equal stretches."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, 2 * p):
                found.setdefault((start, i - start + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_against_all_periods():
    random.seed(5)
    for _ in range(250):
        docs = []
        for _ in range(random.randint(1, 6)):
            n, k = random.randint(0, 60), random.choice([1, 2, 3, 5, 20])
            words = [random.randrange(k) for _ in range(n)]
            if n > 10 and random.random() < 0.5:
                p, a = random.randint(1, 8), random.randrange(n - 8)
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            docs.append(np.array(words, np.int64))
        for least in (2, 12):
            got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(docs, least)), strict=True))
            assert got == [(k, *r) for k, w in enumerate(docs) for r in plain(w.tolist(), least)]


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(90_000)) + " a b c d e f" * 5000
    rows = [Row(doc_id=None, text="x y " * 8, runs=7, kept="p"), Row(doc_id=1, text=None, runs=7, kept="q"), Row(doc_id=1, text="", runs=7, kept=None), Row(doc_id=2, text=" \n\t", runs=7, kept="r"), Row(doc_id=3, text="a b " * 12, runs=7, kept="s"), Row(doc_id=4, text=long, runs=7, kept="t"), Row(doc_id=4, text=long, runs=7, kept="t")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.IntegerType()), T.StructField("kept", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    out = periodic_runs.find(df)
    assert out.columns == ["doc_id", "text", "kept", "runs", "collapsed"]
    got = sorted(((r.kept or "", [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=lambda x: x[0])
    assert got[0] == ("", [], "") and got[1] == ("p", [(0, 16, 2)], "x y") and got[2][1:] == ([], "") and got[3][1:] == ([], "")
    assert got[4] == ("s", [(0, 12, 1)], "a b")  # a no-break space is part of a word
    assert got[5] == got[6] and got[5][1] == [(90_000, 30_000, 6)] and len(got[5][2].split()) == 90_006
    assert periodic_runs.find(df.limit(0)).count() == 0
