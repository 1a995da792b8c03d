"""Language, quality, search, sharding, rules and mixing on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import cover_tree, language_id, line_crf, mixing, quality_rules, queries, sharding

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op1_language_id(spark, SF).join(docs, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found if r.held_out]) >= 0.95


def test_language_edges(spark):
    rows = [("the quick brown fox and the dog", "en"), ("der schnelle braune fuchs und der hund", "de"), (None, "en"), ("x", None)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([("the dog and the fox",), ("und der hund",), (None,), ("",), ("123 !!",), ("A",)], "text string")
    got = [r.p.lang_pred for r in df.select(language_id.predict(F.col("text"), model).alias("p")).collect()]
    assert got[:2] == ["en", "de"] and got[2:5] == ["und"] * 3 and got[5] in ("en", "de")
    none = language_id.learn(spark.createDataFrame(rows, "text string, lang string").limit(0))
    assert df.select(language_id.predict(F.col("text"), none)["lang_pred"]).first()[0] == "und"


def test_filter_finds_every_language_of_a_gram():
    grams = {f"l{i:03d}": np.array([7, 1000 + i], np.uint64) for i in range(70)}
    model = language_id.LanguageFilter.build(grams)
    mask = model.masks(np.array([7], np.uint64))[0]
    assert sum(int(m).bit_count() for m in mask) == 70


def test_quality_classifier(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op10_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert np.mean([r.quality == r.predicted for r in found]) >= 0.93


def test_crf_gradient_and_edges():
    rnd = np.random.default_rng(0)
    x, who = rnd.normal(size=(12, 3)), np.array([0] * 5 + [1] * 1 + [2] * 6)
    chains, t, w = line_crf._Chains(who), rnd.normal(size=(2, 2)), rnd.normal(size=3)
    p, expected, z = line_crf._forward_backward(x @ w, t, chains)
    step = 1e-6
    for i in range(3):
        v = w.copy()
        v[i] += step
        assert abs((line_crf._forward_backward(x @ v, t, chains)[2] - z) / step - x[:, i] @ p) < 1e-4
    u = t.copy()
    u[0, 1] += step
    assert abs((line_crf._forward_backward(x @ w, u, chains)[2] - z) / step - expected[0, 1]) < 1e-4
    model = line_crf.LineCRF(np.zeros(3 * len(line_crf.FEATURES) + 3), np.zeros((2, 2)), 0.5)
    assert model.scores(["", "\n \n", "a"])[0].tolist() == [0.0, 0.0, 0.5]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a line.\nanother"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = line_crf.learn(docs, labels)
    assert [round(r[0], 3) for r in docs.select(line_crf.score(F.col("text"), model)).collect()] == [0.5, 0.0]


@pytest.mark.parametrize("kind", ["random", "copies", "clusters"])
def test_top_k_against_brute_force(spark, kind):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(600, 8))
    if kind == "copies":
        x[100:400] = x[100]
    if kind == "clusters":
        x = x[rnd.integers(0, 9, 600)] * 5 + rnd.normal(size=(600, 8)) * 0.05
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 8), (700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, []), (704, [2.0] * 3)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score long, rank int")
    found = cover_tree.top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=150).collect()
    ints = {i: np.pad(np.floor(256 * np.array(v)), (0, 8 - len(v))).astype(np.int64) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(want)


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in cover_tree.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 256 * 512)]
    assert cover_tree.top_k(df.limit(0), F.lit(True)).count() == 0


def test_shard_table_against_brute_force():
    names, size = [f"s{i}" for i in range(5)], 101
    table = sharding.shard_table(names, size)
    prefs = []
    for n in names:
        skip, off = sharding._number("skip", n) % (size - 1) + 1, sharding._number("offset", n) % size
        prefs.append([(off + k * skip) % size for k in range(size)])
    want, turn = {}, 0
    while len(want) < size:
        slot = next(s for s in prefs[turn % 5] if s not in want)
        want[slot] = turn % 5
        turn += 1
    assert table == [want[s] for s in range(size)]
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.shard_table(names[:-1], size)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 4) < size * 0.25
    for bad in ((names, 100), ([], 101), (["a", "a"], 101)):
        with pytest.raises(ValueError):
            sharding.shard_table(*bad)


def test_placement_edges(spark):
    df = spark.createDataFrame([(None, 9), (None, 8), (1, 7)], "doc_id long, shard int")
    rows = sharding.place(df, ["doc_id"], ["a", "b", "c"], 11).collect()
    assert len(rows) == 3 and len({r.slot for r in rows if r.doc_id is None}) == 1
    assert sharding.place(df.limit(0), ["doc_id"], ["a"], 11).count() == 0


def test_quality_rules_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten."), (4, "a b c d e " * 10), (5, "Home | News | About | Contact\n" + "A good line of plain words that ends well. " * 1 + "\nAnother good line with plain words that ends well too."), (6, "x\n" * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality_rules.clean(df).collect()}
    assert not got[1].kept and got[1].n_words == 0 and got[2].base_failed
    assert got[3].kept and got[3].n_repeat_words == 0
    assert got[4].base_failed and got[4].n_repeat_words == 50
    assert got[5].n_failed_lines == 1 and "Home" not in got[5].clean_text
    assert got[6].n_dup_lines == 2


def test_repeated_words_against_brute_force(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.clean(df).collect():
        w = texts[r.doc_id].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert r.n_repeat_words == len(hit)


def _fill(sizes, weights):
    total, cap = sum(sizes), [3.0 * s for s in sizes]
    fixed = [False] * len(sizes)
    while True:
        left = total - sum(c for c, f in zip(cap, fixed, strict=True) if f)
        w = sum(x for x, f in zip(weights, fixed, strict=True) if not f)
        out = [c if f else left * x / w for c, x, f in zip(cap, weights, fixed, strict=True)]
        over = [not f and o > c for o, c, f in zip(out, cap, fixed, strict=True)]
        if not any(over):
            return out
        fixed = [f or o for f, o in zip(fixed, over, strict=True)]


def test_mix_targets_and_takes(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(0, 400), rnd.choice(["a", "b", "c", "d"] if i % 3 else ["hot"])) for i in range(300)]
    rows += [(1000, "tiny words", None), (1001, None, "none"), (1002, "", None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, size int, block int")
    one, two = mixing.mix(df, block_words=16, shard_slots=64), mixing.mix(df, block_words=16, shard_slots=64)
    got, again = one.documents.collect(), two.documents.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, _fill(sizes, [i % 3 + 1 for i in range(len(names))]), strict=True))
    for n in names:
        own = [r for r in got if r.source == n]
        assert all(abs(r.target - want[n]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[n]) <= 32
    assert all(r.taken <= 3 * r.size for r in got)
    filled = one.slots.groupBy("source_rank").count().collect()
    quota = {r.source_rank: r.n_slots for r in one.sources.collect()}
    assert all(r["count"] == quota[r.source_rank] for r in filled)


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).documents.count() == 0
    words = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(words).documents.collect()] == [(0, 0.0), (0, 0.0)]
