"""Components against a plain union-find, as one task's graph and as one that is shuffled."""

import random

import pytest

from quillon.llm import components as module


def plain(edges):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("one_task", [200_000, 0])
@pytest.mark.parametrize("size", [0, 40])
def test_components(spark, monkeypatch, one_task, size):
    monkeypatch.setattr(module, "ONE_TASK_EDGES", one_task)
    rnd = random.Random(size)
    edges = [(rnd.randrange(-size, size), rnd.randrange(-size, size)) for _ in range(size)]
    edges += [(1000 + i, 1001 + i) for i in range(size)] + edges[:5]
    got = module.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == plain(edges) and len(got) == len(plain(edges))
