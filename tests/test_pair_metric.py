"""Pair moments against all pairs, projections against plain solvers, predictions on rotated data."""

import numpy as np
import pytest

from quillon.operators import knn, pair_metric


def frame(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    rows += [(900_001, *[None] * len(names), 1.0), (900_002, *[float("nan")] * len(names), 1.0), (900_003, *[1.0] * len(names), None)]
    return spark.createDataFrame(rows, ", ".join(["id long", *(f"{n} double" for n in names), "y double"])), names


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 50.0
    y = np.where(np.arange(300) % 3 == 0, 2.0, np.round(x[:, 0] * 2 + rng.normal(size=300)))
    return x, y


def test_moments(spark, data):
    x, y = data
    m = pair_metric.pair_moments(*_args(spark, x, y))
    z = (x - x.mean(0)) / x.std(0)
    d = z[:, None] - z[None]
    off = ~np.eye(len(x), dtype=bool)
    products = (d[..., m.pairs[0]] * d[..., m.pairs[1]])[off]
    assert np.allclose(m.fourth, products.T @ products / len(products))
    assert np.allclose(m.target, (products * np.abs(y[:, None] - y[None])[off][:, None]).mean(0))


def _args(spark, x, y):
    df, names = frame(spark, x, y)
    return df, names, "y"


def test_metric_is_the_least_squares_one(spark, data):
    x, y = data
    got = np.array(pair_metric.learnt_metric(*_args(spark, x, y)).matrix)
    z = (x - x.mean(0)) / x.std(0)
    i, j = np.nonzero(~np.eye(len(x), dtype=bool))
    d = z[i] - z[j]
    b = np.einsum("na,nb->nab", d, d).reshape(len(d), -1)
    full = np.linalg.lstsq(b.T @ b / len(d) + 1e-5 * np.eye(9), b.T @ np.abs(y[i] - y[j]) / len(d), rcond=None)[0].reshape(3, 3)
    values, vectors = np.linalg.eigh(full)
    assert np.allclose(got @ got.T, (vectors * np.maximum(values, 0)) @ vectors.T, atol=1e-8)


def test_similarity_moments(spark, data):
    x, y = data
    near, whole, *_ = pair_metric.similarity_moments(*_args(spark, x, y))
    z = (x - x.mean(0)) / x.std(0)
    s = np.exp(-((y[:, None] - y[None]) ** 2) / y.var())
    assert np.allclose(near, z.T @ s @ z, atol=1e-6) and np.allclose(whole, z.T @ np.diag(s.sum(1)) @ z, atol=1e-6)


def test_partial_least_squares(spark, data):
    x, y = data
    got = np.array(pair_metric.partial_least_squares(*_args(spark, x, y), dimensions=2).matrix)
    z, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    e, scores = z.copy(), []
    for _ in range(2):
        w = e.T @ t
        w /= np.linalg.norm(w)
        s = e @ w
        scores.append(s)
        e = e - np.outer(s, e.T @ s / (s @ s))
    assert np.allclose(z @ got, np.stack(scores, axis=1), atol=1e-8)


def test_rotated_data(spark):
    """Of eight mixed directions the target follows one: learnt projections see it, plain distances do not."""
    rng = np.random.default_rng(9)
    hidden = rng.normal(size=(600, 8))
    x = hidden @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    y = 3.0 * hidden[:, 0]
    df, names = frame(spark, x, y)
    plain = pair_metric.Projection(tuple(names), (0.0,) * 8, (1.0,) * 8, tuple(map(tuple, np.eye(8).tolist())))

    def error(projection):
        rows = pair_metric.projected_predict(df, df, projection, "y", "id").collect()
        assert len(rows) == 601  # a row without a target still has neighbours
        return np.mean([(r.prediction - y[r.query_id]) ** 2 for r in rows if r.query_id < 600])

    base = error(plain)
    for kind in pair_metric.PROJECTIONS:
        assert error(pair_metric.PROJECTIONS[kind](df, names, "y", dimensions=2)) < 0.4 * base, kind


def test_ridge_boosted(spark, data):
    x, _ = data
    y = x[:, 0] * 3 + np.sin(x[:, 1])
    df, names = frame(spark, x, y)
    rows = pair_metric.ridge_boosted_predict(df, df, names, "y", "id").collect()
    assert len(rows) == 301
    assert np.mean([(r.prediction - y[r.query_id]) ** 2 for r in rows if r.query_id < 300]) < 0.05 * y.var()


def test_no_relation_and_too_few(spark):
    df, names = frame(spark, np.ones((5, 2)), np.arange(5))
    assert pair_metric.learnt_metric(df, names, "y").matrix == ((1.0, 0.0), (0.0, 1.0))
    with pytest.raises(ValueError, match="two rows"):
        pair_metric.learnt_metric(df.where("id < 1"), names, "y")


def test_neighbours_of_null_vectors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None), (4, [None])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.id) for r in knn.knn(df, df, 2).collect()) == [(1, 2), (2, 1)]
