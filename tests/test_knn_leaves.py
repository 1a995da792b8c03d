"""Neighbours of few dimensions by leaves, and blocks with many equal rows, against all pairs in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import knn


def _plain(q_ids, q, ids, x, k, skip_self):
    out = set()
    for i, v in zip(q_ids, q, strict=True):
        d2 = ((v - x) ** 2).sum(1)
        order = [j for j in np.lexsort((ids, d2)) if not (skip_self and ids[j] == i)][:k]
        out |= {(int(i), int(ids[j]), float(d2[j]), r) for r, j in enumerate(order, 1)}
    return out


def _points(kind, rng):
    if kind == "copies":
        return np.repeat(rng.normal(size=(20, 2)), 30, axis=0)
    if kind == "one value":
        return np.full((400, 1), 3.0)
    if kind == "grid":
        return np.stack([rng.integers(0, 9, 500), rng.integers(0, 40, 500)], axis=1).astype(float)
    return np.concatenate([rng.normal(size=(400, 3)) * [1, 50, 0.01], rng.normal(size=(8, 3)) * 1e6])


def _tables(spark, kind):
    rng = np.random.default_rng(11)
    x = _points(kind, rng)
    ids = rng.permutation(len(x)) * 3
    odd = [(9000, None), (9001, [None] * x.shape[1]), (9002, [float("nan")] * x.shape[1])]
    return ids, x, spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + odd, "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("skip_self", [True, False])
@pytest.mark.parametrize("kind", ["copies", "one value", "grid", "clusters"])
def test_leaves(spark, monkeypatch, kind, skip_self):
    for name, value in (("FEW_PAIRS", 0), ("LEAF", 12), ("QUERIES", 40)):
        monkeypatch.setattr(knn, name, value)
    ids, x, df = _tables(spark, kind)
    pick = ids % 2 == 0
    got = {tuple(r) for r in knn.knn(df.where("id % 2 = 0"), df, 4, "id", "v", skip_self).select("query_id", "id", "d2", "rk").collect()}
    assert got == _plain(ids[pick], x[pick], ids, x, 4, skip_self)


@pytest.mark.parametrize("kind", ["copies", "one value"])
def test_blocks_with_copies(spark, kind):
    """More equal rows than a task takes up at first: the smallest ids are the neighbours."""
    ids, x, df = _tables(spark, kind)
    df = df.where("id < 9000")
    got = {tuple(r) for r in knn.knn(df, df, 4, "id", "v").select("query_id", "id", "d2", "rk").collect()}
    assert got == _plain(ids, x, ids, x, 4, True)


def test_leaves_of_few_rows(spark, monkeypatch):
    """Fewer rows than neighbours asked for; queries far from all rows."""
    monkeypatch.setattr(knn, "FEW_PAIRS", 0)
    data = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id long, v array<double>")
    far = spark.createDataFrame([(100, [1e9]), (1, [1.0])], "id long, v array<double>")
    got = sorted(tuple(r) for r in knn.knn(far, data, 5, "id", "v").select("query_id", "id", "rk").collect())
    assert got == [(1, 0, 1), (1, 2, 2), (100, 0, 3), (100, 1, 2), (100, 2, 1)]
    assert knn.knn(far, data.where(F.lit(False)), 5, "id", "v").count() == 0
