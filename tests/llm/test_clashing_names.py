"""A caller's columns that have the names of an operator's own come back as they went in."""

from quillon.llm import mixing, packing, suffix_dedup


def _docs(spark):
    passage = "".join(f"passage {i} " for i in range(40))
    texts = [f"first {passage}", f"second one {passage}", "quite short", None]
    rows = [(i, t, "ab"[i % 2], i + 70, i + 80, f"r{i}", i + 90, f"c{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, __key long, __row int, __runs string, __TH long, carried_0 string")


def test_mixed_documents(spark):
    docs = _docs(spark)
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all((r["__key"], r["__row"], r["__runs"], r["__TH"], r["carried_0"]) == (r.doc_id + 70, r.doc_id + 80, f"r{r.doc_id}", r.doc_id + 90, f"c{r.doc_id}") for r in rows)


def test_remove_repeats(spark):
    docs = _docs(spark).withColumnRenamed("text", "__body")
    plain = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in suffix_dedup.remove_repeats(_docs(spark).select("doc_id", "text")).collect()}
    rows = suffix_dedup.remove_repeats(docs, "__body").collect()
    assert {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in rows} == plain
    assert all((r["__key"], r["__TH"], r["__runs"]) == (r.doc_id + 70, r.doc_id + 90, f"r{r.doc_id}") for r in rows)


def test_pack(spark):
    rows = [(i, 1 + i % 9, i + 70, i + 80, i + 90, i + 100, f"p{i}") for i in range(50)]
    pieces = spark.createDataFrame(rows, "doc_id long, __len long, __from long, __local long, __rank long, __sequence long, __part string")
    found = packing.pack(pieces, 16, ["doc_id", "__rank"], length="__len")
    assert found.columns == [*pieces.columns, "sequence_id", "offset"]
    got = found.collect()
    assert sorted(tuple(r)[:7] for r in got) == rows
    held = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert held.get(r.sequence_id, 0) == r.offset
        held[r.sequence_id] = r.offset + r["__len"]
    assert max(held.values()) <= 16 and len(held) == -(-sum(r[1] for r in rows) // 16)
