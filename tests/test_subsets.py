"""Shapley values against all orders, determinantal choice against determinants of all subsets."""

from itertools import permutations

import numpy as np
import pytest

from quillon.operators import subsets


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(3, 2, 200)
    p = np.stack([y + rng.normal(0, s, 200) for s in (0.5, 1.0, 1.0, 2.0, 4.0)] + [np.full(200, 9.0)], axis=1)
    p = np.column_stack([p, p[:, 0]])  # a copy
    names = [f"p{i}" for i in range(7)]
    return spark.createDataFrame([tuple(map(float, (*row, t))) for row, t in zip(p, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "y"])), names, p, y


def test_shapley(table, monkeypatch):
    df, names, p, y = table
    gain = lambda s: y.var() - ((p[:, list(s)].mean(1) - y) ** 2).mean() if s else 0.0
    six, want = names[:6], np.zeros(6)
    orders = list(permutations(range(6)))
    for o in orders:
        for k in range(6):
            want[o[k]] += (gain(o[: k + 1]) - gain(o[:k])) / len(orders)
    got = subsets.shapley_values(df, six, "y")
    assert [got[n][0] for n in six] == pytest.approx(want.tolist())
    assert set(subsets.shapley_pruned(df, six, "y")) == {n for n, v in zip(six, want, strict=True) if v > 0}
    monkeypatch.setattr(subsets, "EXACT_MEMBERS", 2)
    sampled = subsets.shapley_values(df, six, "y", orders=3000)
    assert all(abs(sampled[n][0] - v) <= 5 * sampled[n][1] + 1e-9 for n, v in zip(six, want, strict=True))


def test_determinantal_choice(table):
    df, names, p, y = table
    kernel = subsets.determinantal_kernel(subsets.gram(df, names, "y"))
    e = p - y[:, None]
    cosine = (e.T @ e) / np.outer(np.linalg.norm(e, axis=0), np.linalg.norm(e, axis=0))
    quality = np.maximum(1 - (e**2).mean(0) / y.var(), 1e-3)
    assert np.allclose(kernel, cosine * np.outer(quality, quality))
    chosen = []
    for _ in range(5):
        chosen.append(max((i for i in range(7) if i not in chosen), key=lambda i: (round(np.linalg.det(kernel[np.ix_([*chosen, i], [*chosen, i])]), 12), -i)))
    assert subsets.determinantal_choice(kernel, 5) == chosen
    assert not {0, 6} <= set(subsets.determinantal_choice(kernel, 7))  # a copy is never chosen beside its original
    assert subsets.determinantal_members(df, names, "y", 2) == [names[i] for i in chosen[:2]]
