"""Dominated novelty of a whole table against brute force."""

import numpy as np
import pytest

from quillon.operators import ensemble
from quillon.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    """ind_id -> novelty of rows (ind_id, vector, fitness)."""
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for i, (a, _, f) in enumerate(rows):
        d = sorted(1.0 - x[j] @ x[i] for j, (b, _, g) in enumerate(rows) if g < f or (g == f and b < a))
        out[a] = float(np.mean(d[:k])) if d else float("inf")
    return out


def test_query_covers_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([(r.vec_id, r.embedding, r.label * 100 + r.vec_id % 7) for r in table], 3)
    found = {r.ind_id: r.novelty for r in QUERIES["dominated_novelty"](spark, SF).collect()}
    assert len(found) == len(table) == len(want)
    for i, n in want.items():
        assert found[i] == pytest.approx(-1.0 if n == float("inf") else n, abs=2e-4)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ensemble, "BLOCK", 37)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).tolist(), float(r.integers(0, 9))) for i in range(150)]
    df = spark.createDataFrame([*rows, (900, None, -1.0), (901, [0.0] * 4, -1.0), (902, [1.0] * 4, None)], "ind_id long, e array<double>, fitness double")
    found = {x.ind_id: x.novelty for x in ensemble.dominated_novelty(df, "e", 3).collect()}
    want = brute(rows, 3) | {i: float("inf") for i in (900, 901, 902)}
    assert found.keys() == want.keys()
    assert all(found[i] == pytest.approx(n, abs=1e-9) for i, n in want.items())


def test_copies_travel_to_few_tasks(spark, monkeypatch):
    """As many groups whatever the blocks; of neighbours as near, those of smaller ids; NaN fitness takes no part."""
    monkeypatch.setattr(ensemble, "BLOCK", 7)
    monkeypatch.setattr(ensemble, "NOVELTY_GROUPS", 3)
    monkeypatch.setattr(ensemble, "NOVELTY_SLICE", 11)
    r = np.random.default_rng(6)
    rows = [(int(i), v.tolist(), float(f)) for i, v, f in zip(r.permutation(120), np.repeat(r.normal(size=(30, 4)), 4, axis=0), r.integers(0, 5, 120), strict=True)]
    df = spark.createDataFrame([*rows, (900, [1.0] * 4, float("nan"))], "ind_id long, e array<double>, fitness double")
    found = {x.ind_id: x.novelty for x in ensemble.dominated_novelty(df, "e", 3).collect()}
    want = brute(rows, 3) | {900: float("inf")}
    assert found.keys() == want.keys()
    assert all(found[i] == pytest.approx(n, abs=1e-9) for i, n in want.items())


@pytest.mark.parametrize(("n", "groups"), [(10, 1), (5000, 3), (100_000, 16), (600_000, 16)])
def test_groups_do_not_grow_with_rows(n, groups):
    assert ensemble.novelty_groups(n, 64) == groups
