"""Layers and survivors against plain versions, with ties, nulls and sectors smaller than the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from quillon.operators import ordered, pareto


def plain_layers(values):
    layer, left, out = 0, list(range(len(values))), {}
    while left:
        front = [i for i in left if not any(all(x <= y for x, y in zip(values[j], values[i], strict=True)) and values[j] != values[i] for j in left)]
        out |= dict.fromkeys(front, layer)
        left, layer = [i for i in left if i not in out], layer + 1
    return [out[i] for i in range(len(values))]


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_layers_of_an_array(m):
    random.seed(m)
    for n in (0, 1, 40, 90):
        values = [tuple(float(random.randint(0, 9)) for _ in range(m)) for _ in range(n)]
        assert pareto.layer_array(np.array(values).reshape(n, m)).tolist() == plain_layers(values)


GOALS = T.StructType([T.StructField("ind_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "abc"), T.StructField("layers", T.StringType())])


def frame(spark, values, extra=()):
    return spark.createDataFrame([Row(ind_id=i, a=v[0], b=v[1], c=v[2], layers="x") for i, v in enumerate(values)] + [Row(*r) for r in extra], GOALS)


@pytest.mark.parametrize(("sector", "merged"), [(10_000, 60_000), (40, 120), (30, 8)])
def test_layers(spark, monkeypatch, sector, merged):
    monkeypatch.setattr(pareto, "SECTOR_ROWS", sector)
    monkeypatch.setattr(pareto, "MERGED", merged)
    random.seed(7)
    values = [tuple(round(random.gauss(0, 1), 1) for _ in range(3)) for _ in range(120 if merged < 10 else 300)]
    values += [values[0]] * 60  # a hot point
    want = plain_layers(values)
    df = frame(spark, values, [(1000, None, 1.0, 1.0, "x"), (1001, float("nan"), -9.0, -9.0, "x")])
    if merged > 10:
        got = dict(pareto.layers(df, ["a", "b", "c"], "ind_id").collect())
        assert got == dict(enumerate(want)) | {1000: None, 1001: None}
    first = dict(pareto.layers(df, ["a", "b", "c"], "ind_id", upto=2).where("layer IS NOT NULL").collect())
    assert first == {i: k for i, k in enumerate(want) if k < 2}
    assert pareto.layers(df.limit(0), ["a", "b", "c"], "ind_id").count() == 0


def test_survivors(spark):
    random.seed(9)
    values = [tuple(round(random.random(), 2) for _ in range(3)) for _ in range(200)]
    layer = plain_layers(values)
    df = frame(spark, values)
    for n in (1, 50, 200):
        got = {r.ind_id: r.layer for r in pareto.nsga2(df, ["a", "b", "c"], "ind_id", n).collect()}
        assert len(got) == n and all(layer[i] == k for i, k in got.items())
        worst = max(got.values())
        assert all(i in got for i in range(200) if layer[i] < worst)
        # the last layer's ends stay where there is room
        edge = [i for i in range(200) if layer[i] == worst]
        ends = {f(edge, key=lambda i: (values[i][o], i)) for o in range(3) for f in (min, max)}
        taken = [i for i in got if layer[i] == worst]
        assert set(taken) <= ends or ends <= set(taken)


def test_niches(spark):
    random.seed(10)
    values = [tuple(round(random.random(), 3) for _ in range(3)) for _ in range(150)]
    layer, n = plain_layers(values), 60
    got = {r.ind_id: r for r in pareto.nsga3(frame(spark, values), ["a", "b", "c"], "ind_id", n).collect()}
    assert len(got) == n
    total, worst = 0, 0
    while total + layer.count(worst) < n:
        total, worst = total + layer.count(worst), worst + 1
    pool = [i for i in range(150) if layer[i] <= worst]
    v = np.array([values[i] for i in pool])
    unit = (v - v.min(0)) / (v.max(0) - v.min(0))
    points = np.array(pareto.reference_points(3))
    along = unit @ points.T / np.linalg.norm(points, axis=1)
    away = np.round(np.sqrt(np.maximum((unit**2).sum(1)[:, None] - along**2, 0)), 12)
    niche, near = dict(zip(pool, away.argmin(1).tolist(), strict=True)), dict(zip(pool, away.min(1).tolist(), strict=True))
    chosen = [i for i in pool if layer[i] < worst]
    rest = sorted((i for i in pool if layer[i] == worst), key=lambda i: (near[i], i))
    while len(chosen) < n:
        held = {k: sum(niche[i] == k for i in chosen) for k in {niche[i] for i in rest}}
        k = min(held, key=lambda k: (held[k], k))
        i = next(i for i in rest if niche[i] == k)
        chosen.append(i)
        rest.remove(i)
    assert sorted(got) == sorted(chosen) and all(got[i].niche == niche[i] for i in got)


def test_neighbours_across_ranges(spark):
    random.seed(2)
    rows = [(random.choice([1.0, 1.0, 1.0, 2.0, 5.5, None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, tie long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {order[k][1]: tuple(order[k + d][1] if 0 <= k + d < 300 else None for d in (-2, -1, 1)) for k in range(300)}
    got = {r["tie"]: (r["tie_-2"], r["tie_-1"], r["tie_1"]) for r in ordered.with_neighbours(df, "x", "tie", ["tie"], 2, 1).collect()}
    assert got == want
