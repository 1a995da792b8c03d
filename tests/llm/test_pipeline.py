"""The corpus pipeline's stages against plain versions of them, each on its predecessor's rows."""

from collections import Counter

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from quillon.llm import line_crf, mixing
from quillon.llm._shared import learnable, materialise

from .test_duplicates import covered, sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "stage"))
    return [x.toPandas() for x in out], out


def test_columns_stay(stages):
    frames, tables = stages
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_classifier_rejects(spark, stages):
    (before, after, *_), tables = stages
    model = line_crf.learn(tables[0], spark.read.parquet(f"{SF}/labels.parquet").where(learnable(F.col("doc_id"))))
    scores, _, _ = model.scores(list(before.text))
    assert sorted(after.doc_id) == sorted(before.doc_id[scores >= C.GOOD])
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    kept = set(after.doc_id)
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.95 * sum(q == 1 for q in labels.values())


def test_one_of_each_group_stays(stages):
    (_, before, after, *_), _ = stages
    rows = sorted(zip(before.doc_id, before.text, strict=True))
    s = [sets(t) for _, t in rows]
    least = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if s[i] and least[i] != least[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    assert sorted(after.doc_id) == [d for k, (d, _) in enumerate(rows) if least[k] == k]


def test_repeats_are_cut(stages):
    (_, _, before, after, *_), _ = stages
    data, masks = covered(list(before.text), 200)
    want = {}
    for d, b, m in zip(before.doc_id, data, masks, strict=True):
        left = bytes(x for x, c in zip(b, m, strict=True) if not c).decode("utf-8", "ignore")
        if not m.any() or left.strip(" \t\n\x0b\x0c\r"):
            want[d] = left
    assert dict(zip(after.doc_id, after.text, strict=True)) == want


def test_mix_meets_targets(stages):
    """Each source's words are within two blocks of its target, and no document's are more than three times its size."""
    frames, tables = stages
    mixed = mixing.mix(tables[3])
    words = frames[4].text.str.split(r"[\x20\x09-\x0D]+", regex=True).map(lambda ws: sum(w != "" for w in ws))
    got = words.groupby(frames[4].source).sum().to_dict()
    for s in mixed.sources.collect():
        assert abs(got.get(s.source, 0) - s.target) <= 2 * 128, (s.source, got.get(s.source, 0), s.target)
    by_doc = words.groupby(frames[4].doc_id).sum().to_dict()
    taken = mixed.documents.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    assert by_doc == {r.doc_id: r.taken for r in taken if r.taken} and all(r.taken <= 3 * r["size"] for r in taken)


def test_packing_is_exact(stages):
    frames, _ = stages
    packed = frames[5]
    assert packed.groupby(["doc_id", "piece"]).size().groupby("doc_id").max().to_dict() == Counter(frames[4].doc_id)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= C.CAPACITY
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // C.CAPACITY) + 1 + int((packed.length > C.CAPACITY // 2).sum())


def test_odd_rows_go_through_every_stage(spark):
    """Null texts, ids and sources, an empty text, repeated rows, a long text and columns with clashing names."""
    long = " ".join(f"Word{k} is followed by another one." for k in range(40_000))
    rows = [(1, None, "a"), (None, "A text without an id, which is fine. It has two sentences.", "a"), (2, "", None), (3, long, "b"), (4, "Twice the same row, every word of it. " * 3, "a"), (4, "Twice the same row, every word of it. " * 3, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 8, 9, 10) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int, kept int, n int, slot int")
    for given in (docs, docs.limit(0)):
        out = given
        for _, stage in C.STAGES:
            out = materialise(stage(spark, out, SF), "stage")
            if out.columns[-1] != "offset":
                assert out.columns == docs.columns
        assert out.count() == 0 or {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_stages_after_the_classifier_keep_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(5, text, "a"), (None, " ".join(f"v{k}" for k in range(300)), None), (6, text, "a"), (7, None, "a"), (8, "one", "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, start int")
    kept = C.near_duplicate_stage(spark, docs, SF)
    assert sorted(((r.doc_id is None, r.doc_id) for r in kept.collect()), key=str) == sorted([(False, 5), (True, None), (False, 7), (False, 8)], key=str)
    cut = C.suffix_stage(spark, materialise(kept, "stage"), SF)
    assert cut.count() == 4
    mixed = materialise(C.mixing_stage(spark, materialise(cut, "stage"), SF), "stage")
    assert mixed.columns == docs.columns and mixed.where("text IS NULL OR text = ''").count() == 0
    assert C.packing_stage(spark, mixed, SF).where("sequence_id IS NULL").count() == 0
