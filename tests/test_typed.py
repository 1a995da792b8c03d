"""Typed genes: nested fits against step-by-step ones in pandas, on rows not learnt from; types; stored plans."""

import json
import math
from statistics import NormalDist

import numpy as np
import pytest

from quillon.plans import typed

COLUMNS = "id long, c string, d string, x double, y double"


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(6)
    rows = [(i, str(rng.choice(list("abcde"), p=[0.6, 0.1, 0.1, 0.1, 0.1])), f"k{i % 3}", float(np.round(rng.normal(2, 3), 2)), float(i % 17)) for i in range(400)]
    train = spark.createDataFrame([*rows, (400, None, "k1", 1.0, 2.0), (401, "a", "k0", None, float("nan"))], COLUMNS)
    test = spark.createDataFrame([*rows[:40], (900, "new", None, 1e9, -5.0), (901, None, "k1", None, float("inf")), (902, "b", "k2", -1e9, 3.0)], COLUMNS)
    clean = lambda d: d.toPandas().assign(x=lambda f: f.x.fillna(0.0), y=lambda f: f.y.replace([np.inf, -np.inf], np.nan).fillna(0.0))
    return train, test, clean(train), clean(test)


def test_nested_fits(spark, frames):
    train, test, a, b = frames
    genes = ["standardize(groupby_mean(c, standardize(x)))", "min_max_scaler(Mul(x, y))", "robust_scaler(y)", "groupby_count(binary_feature_cross(c, d), y)", "groupby_max(binning(y), x)", "clip(standardize(y), -1, 1)", "gaussian_quantile_transformer(y)", "normal_quantile_transformer(x)", "Smooth-Add(x, y)", "Smooth-Neg(standardize(y))", "groupby_median(c, y)"]
    plan = typed.fit(train, genes, ["c", "d"])
    plan = typed.TypedPlan.from_dict(json.loads(json.dumps(plan.to_dict())))
    got = plan.transform(test, ["id"]).toPandas()

    z = lambda v, of: (v - of.mean()) / of.std(ddof=0)
    sa, sb = z(a.x, a.x), z(b.x, a.x)
    means = sa.groupby(a.c).mean()
    ga, gb = a.c.map(means).fillna(sa.mean()), b.c.map(means).fillna(sa.mean())
    assert np.allclose(got.g0, z(gb, ga))
    p = a.x * a.y
    assert np.allclose(got.g1, (b.x * b.y - p.min()) / (p.max() - p.min()))
    q = lambda v, s: np.sort(v)[max(0, math.ceil(s * len(v)) - 1)]
    assert np.allclose(got.g2, (b.y - q(a.y, 0.5)) / (q(a.y, 0.75) - q(a.y, 0.25)))
    cross = lambda f: (f.c + "_" + f.d).where(f.c.notna() & f.d.notna())
    assert np.allclose(got.g3, cross(b).map(cross(a).value_counts()).fillna(0.0))
    marks = sorted({q(a.y, round(k * 1000 / 21) / 1000) for k in range(1, 21)})
    cut = lambda f: np.searchsorted(marks, f.y, side="right")
    top = a.x.groupby(cut(a)).max()
    assert np.allclose(got.g4, [top.get(k, a.x.mean()) for k in cut(b)])
    assert np.allclose(got.g5, z(b.y, a.y).clip(-1, 1))
    landmarks = np.array([q(a.y, k / 1000) for k in range(1001)])
    share = lambda v, m: 0.5 * (np.interp(v, m, np.arange(1001) / 1000) - np.interp(-v, -m[::-1], -np.arange(1001)[::-1] / 1000))
    known = b.y.between(a.y.min(), a.y.max())
    assert np.allclose(got.g6[known], share(b.y[known].to_numpy(), landmarks), atol=2e-3) and got.g6[40] == 0.0
    assert got.g7[40] == pytest.approx(NormalDist().inv_cdf(1 - 1e-7), abs=1e-6) and got.g7[42] == pytest.approx(NormalDist().inv_cdf(1e-7), abs=1e-6)
    order = np.argsort(b.x.to_numpy()[:40], kind="stable")
    assert (np.diff(got.g7.to_numpy()[:40][order]) >= 0).all()
    seen = np.unique(a.x + a.y)
    near = lambda v: seen[np.abs(seen - v).argmin()]
    assert np.allclose(got.g8, [near(v) for v in b.x + b.y])
    assert np.allclose(got.g9[known], -z(b.y, a.y)[known])
    medians = a.y.groupby(a.c).apply(lambda v: q(v, 0.5))
    assert np.allclose(got.g10, b.c.map(medians).fillna(a.y.mean()))


def test_normal_quantiles(spark):
    shares = [1e-7, 1e-4, 0.01, 0.02, 0.2, 0.499, 0.5, 0.6, 0.97, 0.999, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in shares], "p double").select(typed._normal_quantile(typed.F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in shares], abs=1e-8)


def test_layers_and_types(spark, frames):
    train, test, a, b = frames
    plan = typed.fit(train, ["onehot_encoding(c)", "binary_encoding(c)", "ordinal_encoding(c)", "triple_feature_cross(c, d, d)", "identity(Add(x, 1))"], ["c", "d"])
    got = plan.transform(test, ["id"]).toPandas()
    place = b.c.map({c: i for i, c in enumerate("abcde")}).fillna(-1).astype(int)
    assert np.allclose(got[[f"g0_{k}" for k in range(5)]], np.equal.outer(place.to_numpy(), np.arange(5)))
    assert np.allclose(got[[f"g1_{k}" for k in range(3)]], np.stack([(place.to_numpy() // 2**k) % 2 for k in (2, 1, 0)], axis=1))
    assert np.allclose(got.g2_0, place) and np.allclose(got.g4_0, b.x.where(test.toPandas().x.notna(), -1) + 1)
    assert sum(c.startswith("g3_") for c in got.columns) == 4
    for bad in ("Add(c, x)", "onehot_encoding(x)", "Add(identity(x), 1)", "groupby_mean(x, y)"):
        with pytest.raises(ValueError, match="takes a|gives a layer"):
            typed.read(bad, ["c", "d"])
    empty = typed.fit(train.limit(0), ["standardize(x)", "groupby_mean(c, x)", "normal_quantile_transformer(x)", "binning(x)"], ["c"])
    assert [tuple(r) for r in empty.transform(spark.createDataFrame([(1, "a", "b", 2.0, 3.0)], COLUMNS)).collect()] == [(2.0, 0.0, 0.0, "0")]


def test_one_aggregate_a_depth(spark, frames):
    calls = []
    train = frames[0]
    kept = type(train).agg
    type(train).agg = lambda self, *a: calls.append(len(a)) or kept(self, *a)
    try:
        typed.fit(train, ["standardize(x)", "min_max_scaler(standardize(x))", "robust_scaler(standardize(y))", "standardize(y)"])
    finally:
        type(train).agg = kept
    assert len(calls) == 2
