"""The dual-tree search returns what all products give, and prunes pairs of nodes where vectors form clusters."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm import cover_tree as C


def vectors(name):
    if name == "embeddings":
        v = np.array(pq.read_table("/root/testdata/sf0.01/embeddings.parquet")["embedding"].to_pylist(), np.float64)
        return np.floor(256 * v).astype(np.int64)
    r = np.random.default_rng(4)
    if name == "clusters":
        return (r.normal(size=(20, 16)) * 100)[r.integers(0, 20, 1500)].astype(np.int64) + r.integers(-4, 5, (1500, 16))
    return r.integers(-100, 100, (900, 24)) if name == "random" else np.repeat(r.integers(-9, 9, (3, 8)), 300, axis=0)


@pytest.mark.parametrize("name", ["embeddings", "clusters", "random", "copies"])
def test_pruned_and_exact(name):
    v = vectors(name)
    ids = np.arange(len(v))
    ask = ids[::20]
    data = C.CoverTree(v, ids, ids, 32)
    queries = C.CoverTree(v[ask], ask, ask, 32)
    assert name == "copies" or len(data.kids) > 8
    for node, kids in enumerate(data.kids):  # nested, covered, within the parent
        below = data.points[data.leaves[node]]
        assert np.sqrt(((below - data.centre[node]) ** 2).sum(1)).max() <= data.radius[node] + 1e-6
        assert all(data.radius[k] <= data.radius[node] + 1e-6 for k in kids) or kids == []
    found = C.dual_search(queries, data, 5, np.full(len(ask), -np.inf))
    if name == "clusters":
        assert found.pruned > 0, (found.pruned, found.scored)
    for k, q in enumerate(queries.ids):
        score = v @ v[q]
        want = sorted(((-int(s), int(i)) for i, s in enumerate(score) if i != q))[:5]
        assert [(-int(s), int(i)) for s, i in zip(found.scores[k], found.ids[k], strict=True)] == want
    print(name, len(data.kids), found.pruned, found.scored)
