"""What the near-duplicate join holds on the driver is bounded, whatever the number of tasks; a block's sort is small."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from quillon.llm import _shared, jaccard_join, suffix_dedup


@pytest.mark.parametrize("at_once", [16, 3])
def test_sketches_stay_off_the_driver(spark, monkeypatch, at_once):
    monkeypatch.setattr(jaccard_join, "SKETCHES_AT_ONCE", at_once)
    texts = [f"common words of every text here {i} and {i % 7} more" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    got, real = [], DataFrame.collect

    def collect(self):
        rows = real(self)
        got.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(DataFrame, "collect", collect)
    found = jaccard_join.near_duplicates(docs)
    assert 0 < sum(got) <= jaccard_join.SKETCH
    plain = np.zeros(jaccard_join.SKETCH, np.int64)
    for members in jaccard_join.shingle_sets(texts):
        np.add.at(plain, (members & np.uint64(jaccard_join.SKETCH - 1)).astype(np.int64), 1)
    heavy = jaccard_join._heavy(_shared.materialise(jaccard_join._describe(docs, 5), "test-sets"))
    assert heavy.tolist() == jaccard_join._classes(plain).tolist()
    assert found.count() == 60


def test_empty_sketch(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert not jaccard_join._heavy(_shared.materialise(jaccard_join._describe(docs, 5), "test-sets")).any()


def test_a_block_is_sorted_in_little_memory():
    rnd = np.random.default_rng(1)
    runs = [rnd.integers(97, 123, 320).astype(np.uint8).tobytes() for _ in range(suffix_dedup.BLOCK_BYTES // 320)]
    runs[7] = runs[0][:-1] + b"#"
    tracemalloc.start()
    masks = suffix_dedup.repeated_starts(runs, 200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000  # two workers of an executor sort at once
    assert [m.sum() for m in masks] == [120 if k in (0, 7) else 0 for k in range(len(runs))]
