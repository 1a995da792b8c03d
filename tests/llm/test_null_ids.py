"""A near copy without an id that bridges two documents."""

from quillon.llm import jaccard_join


def test_near_copy_without_id_bridges(spark):
    w = [f"w{k}" for k in range(100)]
    one, two = [*w[:-10], *(f"p{k}" for k in range(10))], [*(f"q{k}" for k in range(10)), *w[10:]]
    mid = w
    sets = [{tuple(t[i : i + 5]) for i in range(96)} for t in (one, mid, two)]
    like = lambda a, b: len(a & b) / len(a | b)
    assert like(sets[0], sets[1]) >= 0.75 <= like(sets[1], sets[2]) and like(sets[0], sets[2]) < 0.75
    rows = [(7, " ".join(one)), (None, " ".join(mid)), (5, " ".join(two)), (None, "quite another text here without an id"), (9, None)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted([(7, 5), (None, 5), (5, 5), (None, None), (9, 9)], key=str)
