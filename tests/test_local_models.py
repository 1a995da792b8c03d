"""Local models against NumPy row by row, medians, farthest-first samples against the greedy choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import coresets, knn, local_models, ordered


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 2))
    x[:6] = x[0]  # repeated rows
    y = np.where(x[:, 0] > 0.5, np.sin(6 * x[:, 0]), x[:, 1]) + 3
    y[100:112] = 7.0
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))] + [(500, None, 1.0, 1.0), (501, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    near = knn.knn(*[df.where("id < 500").select("id", F.array("a", "b").alias("v"))] * 2, 6, "id", "v")
    return df, near, x, y


def test_weights(table):
    df, near, x, y = table
    by = {}
    for r in near.collect():
        by.setdefault(r.query_id, []).append(r.id)
    miss, overall = [], np.median(np.abs(y - y.mean()))
    for i in range(len(x)):
        t = np.column_stack([np.ones(6), x[by[i]] - x[i]])
        g = t.T @ t
        beta = np.linalg.solve(g + 1e-10 * np.trace(g) / 3 * np.eye(3), t.T @ (y[by[i]] - y[i]))
        spread = np.median(np.abs(y[by[i]] - np.median(y[by[i]])))
        miss.append(abs(beta[0]) / ((spread if spread > 1e-10 else overall) + 1e-10))
    miss = np.array(miss)
    middle = np.median(miss)
    deviation = np.median(np.abs(miss - middle))
    want = np.maximum(np.clip(miss - middle, -2.5 * deviation, 2.5 * deviation) + 1.5 * deviation, 1e-10) ** 0.75
    got = {r.query_id: r.weight for r in local_models.nonlinearity_weights(df, near, "id", ["a", "b"], "y").collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx((want / want.sum()).tolist(), rel=1e-6)
    assert len(got) == len(x)


def test_equal_weights_and_no_rows(spark, table):
    df, near, *_ = table
    assert {round(r.weight, 9) for r in local_models.nonlinearity_weights(df.where("id < 500").withColumn("y", F.lit(1.0)), near, "id", ["a", "b"], "y").collect()} == {round(1 / 160, 9)}
    assert local_models.nonlinearity_weights(df.where("id < 0"), near, "id", ["a", "b"], "y").count() == 0


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0, 5.0, 1.0, None], [float(i % 7) for i in range(100)]])
def test_median(spark, values):
    known = [v for v in values if v is not None]
    got = ordered.median(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    assert got == (pytest.approx(float(np.median(known))) if known else None)


def _radius(points, chosen):
    return np.sqrt(((points[:, None] - points[chosen][None]) ** 2).sum(2)).min(1).max()


def test_farthest_first(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.3, size=(200, 3)) for c in (0, 6, 12)] + [np.full((60, 3), 30.0)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [None, 1.0, 1.0]), (902, [float("nan")] * 3)], "vec_id long, embedding array<double>")
    whole = coresets.farthest_first(df, 12).orderBy("rk").collect()
    left, at, want = np.full(len(points), np.inf), 0, []
    for _ in range(12):
        want.append((at, None if np.isinf(left[at]) else left[at]))
        left = np.minimum(left, np.sqrt(((points - points[at]) ** 2).sum(1)))
        at = int(np.argmax(left))
    assert [(r.id, r.distance) for r in whole] == [(i, pytest.approx(d) if d is not None else None) for i, d in want]
    dealt = coresets.farthest_first(df, 12, task_rows=60).collect()
    assert len({r.id for r in dealt}) == 12
    assert _radius(points, [r.id for r in dealt]) <= 2 * _radius(points, [r.id for r in whole])
    assert coresets.farthest_first(df.where("vec_id < 5"), 12).count() == 5
    assert coresets.farthest_first(df.where("vec_id < 0"), 12).count() == 0


@pytest.mark.parametrize(("ahead", "kept"), [(512, 256), (3, 4), (1, 1)])
def test_farthest_first_by_passes(spark, monkeypatch, ahead, kept):
    """Beyond one task's rows the choice is the greedy one still, ties to the smaller id."""
    monkeypatch.setattr(coresets, "AHEAD", ahead)
    monkeypatch.setattr(coresets, "KEPT", kept)
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.integers(0, 4, size=(150, 2)).astype(float), rng.normal(9, 1, size=(50, 2)), [[2.0, 2.0]] * 5])
    df = spark.createDataFrame([(1000 - i, p.tolist()) for i, p in enumerate(points)] + [(5, None)], "vec_id long, embedding array<double>").repartition(5)
    whole = [tuple(r) for r in coresets.farthest_first(df, 20).orderBy("rk").collect()]
    assert [tuple(r) for r in coresets.farthest_first(df, 20, task_rows=40).orderBy("rk").collect()] == whole
