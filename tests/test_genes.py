"""Genes, primitives and the compiler against plain arithmetic."""

import math
import random

import numpy as np
import pytest

from quillon.functions.primitives import REGISTRY, preset, register_primitive, sanitise
from quillon.operators.genetic import crossover, distinct, half_and_half, hoist, insert, mutate, prune
from quillon.plans import gene as G
from quillon.plans.compiler import features


def test_parse_round_trip_and_errors():
    text = "Add(Mul(a, b), AQ(`odd name`, 0.5))"
    node = G.parse(text)
    assert G.key(node) == text and G.size(node) == 7 and G.height(node) == 2
    assert G.columns(node) == ["a", "b", "odd name"]
    assert G.formula(G.parse("Sub(a, Neg(b))")) == "(a - (-b))"
    for bad in ("Add(a)", "Nope(a)", "Add(a, b", "Add(a, b) c", "", "Add(, a)"):
        with pytest.raises(ValueError):
            G.parse(bad)


def test_simplify():
    for text, want in (("Sub(a, a)", "0.0"), ("Mul(a, 1.0)", "a"), ("Add(0.0, b)", "b"), ("Neg(Neg(a))", "a"), ("Max(a, a)", "a"), ("Add(Sub(a, a), b)", "b")):
        assert G.key(G.simplify(G.parse(text))) == want


def test_registry_covers_the_language():
    assert len(REGISTRY) >= 107
    assert preset("anything") == ("Add", "Sub", "Mul", "AQ") and preset("Add,Sin") == ("Add", "Sin")


EDGE = [0.0, 1.0, -1.0, 1e-12, -1e-7, 2.5, -3.5, 800.0, -800.0, float("nan"), float("inf"), None]


def _sane(v):
    return 0.0 if v is None or math.isnan(v) or math.isinf(v) else v


NUMPY = {
    "Div": lambda a, b: a / (np.where(b >= 0, 1.0, -1.0) * np.sqrt(b * b + 1e-10)),
    "Div-O": lambda a, b: a / b,
    "AQ": lambda a, b: a / np.sqrt(1 + b * b),
    "Min": np.minimum,
    "Max": np.maximum,
    "GE": lambda a, b: (a >= b).astype(float),
    "Equal": lambda a, b: (a == b).astype(float),
    "Log": lambda a: np.log(np.abs(a)),
    "Log-O": np.log,
    "Sqrt-O": np.sqrt,
    "Exp": lambda a: np.where(np.exp(a) < 1e6, np.exp(a), 1.0),
    "Round": np.round,
    "Inv": lambda a: np.where(np.abs(a) > 1e-6, 1 / a, 0.0),
}


@pytest.mark.parametrize("name", sorted(NUMPY))
def test_edge_values_match_numpy(spark, name):
    arity = REGISTRY[name].arity
    values = [v for v in EDGE if v is not None]
    rows = [(x, y) for x in values for y in values] if arity == 2 else [(x, 0.0) for x in values]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in features(df, [f"{name}({'a, b' if arity == 2 else 'a'})"]).collect()]
    with np.errstate(all="ignore"):
        want = NUMPY[name](*(np.array([r[i] for r in rows]) for i in range(arity)))
    assert np.allclose(got, [_sane(float(w)) for w in want], rtol=1e-9)


def test_random_trees_match_an_interpreter(spark):
    rnd = random.Random(5)
    plain = {"Add": np.add, "Sub": np.subtract, "Mul": np.multiply, "Neg": np.negative, "Sin": np.sin, "Cos": np.cos}
    data = np.random.default_rng(0).normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")

    def run(n):
        if isinstance(n, G.Call):
            return plain[n.name](*(run(x) for x in n.args))
        return np.full(50, n.value) if isinstance(n, G.Const) else data[:, "abc".index(n.name)]

    trees = [half_and_half(rnd, ["a", "b", "c"], list(plain), 1, 4) for _ in range(40)]
    got = np.array([list(r) for r in features(df, trees).collect()])
    assert np.allclose(got, np.array([run(t) for t in trees]).T, rtol=1e-9)


def test_group_primitives_are_ratios(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 30.0), (3.0, 40.0), (3.0, 50.0), (3.0, 60.0)] * 4, "k double, v double").selectExpr("*", "monotonically_increasing_id() AS i")
    rows = features(df, ["GroupByMean(k, v)", "GroupByMax(k, v)", "GroupByVar(k, v)", "GroupByCount(k)"], keep=["k", "v"]).distinct().orderBy("v").collect()
    assert [round(r.g0, 3) for r in rows] == [1, 0.8, 1.2, 0.8, 1, 1.2]
    assert [round(r.g1, 3) for r in rows] == [1, 0.667, 1, 0.667, 0.833, 1]
    assert [round(r.g2, 2) for r in rows] == [0, 25, 25, 66.67, 66.67, 66.67]
    assert [r.g3 for r in rows] == [4, 8, 8, 12, 12, 12]


def test_sanitise_and_custom_primitive(spark):
    df = spark.createDataFrame([(v,) for v in EDGE], "a double")
    assert all(math.isfinite(r[0]) for r in df.select(sanitise(df["a"])).collect())
    register_primitive("Twice", 1, lambda a: a * 2)
    assert features(spark.createDataFrame([(3.0,)], "a double"), ["Twice(a)"]).first()[0] == 6.0


def test_genetic_operators_keep_limits():
    rnd = random.Random(1)
    names = ("Add", "Mul", "Sin")
    a, b = half_and_half(rnd, ["a", "b"], names, 2, 4), half_and_half(rnd, ["a", "b"], names, 2, 4)
    for _ in range(200):
        a, b = crossover(rnd, a, b, 6)
        a = mutate(rnd, a, ["a", "b"], names, 6)
        b = insert(rnd, b, ["a", "b"], names, 6)
        assert G.height(a) <= 6 and G.height(b) <= 6
        assert G.key(G.parse(G.key(a))) == G.key(a)
    assert G.height(prune(a, 1)) <= 1 and G.size(hoist(rnd, a)) <= G.size(a)
    assert len(distinct([a, a, b])) <= 2
