"""Near-duplicate groups and repeated byte strings against brute force, on small and awkward tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import jaccard_join, suffix_dedup
from quillon.llm.components import components


def words(rnd, n, size=400):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out, base = [], [words(rnd, rnd.choice([3, 5, 8, 40, 120, 300])) for _ in range(25)]
    for b in base:
        for _ in range(rnd.randint(1, 4)):
            c = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                c[rnd.randrange(len(c))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(c) + rnd.choice(["", "\n", "\t "]))
    passage = " ".join(words(rnd, 60, 10**6))
    out += [" ".join(words(rnd, 50)) + " " + passage + " " + " ".join(words(rnd, 50)) for _ in range(8)]
    out += ["SAME text Here", "same TEXT here", None, "", "   \n", None, "é" * 300, "é" * 300, "a" * 1000, "ab" * 700]
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    return [*zip(ids, out, strict=True), (ids[0], out[0]), (ids[1], "another text with the same id as one before")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, n long, fp long, th string")


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_components_against_brute_force(spark, rows):
    found = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    s = [sets(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    want = sorted((d, len(s[i]), least[root(i)] if s[i] else d) for i, (d, _) in enumerate(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == want


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard_join.near_duplicates(frame(spark, []).limit(0)).count() == 0
    found = jaccard_join.near_duplicates(frame(spark, [(None, "a b c"), (4, "a b c"), (None, "alone here")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted([(None, 4), (4, 4), (None, None)], key=str)


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(n + 1)) and found[101] == 100
    assert components(edges.limit(0)).count() == 0


def covered(texts, length):
    data = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                mask[i] += 1
                mask[i + length] -= 1
        out.append(np.cumsum(mask)[: len(b)] > 0)
    return data, out


def test_repeats_against_brute_force(spark, rows):
    found = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    data, masks = covered([t for _, t in rows], 200)
    want = sorted((d, len(b), np.frombuffer(b, np.uint8)[~m].tobytes(), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())) for (d, _), b, m in zip(rows, data, masks, strict=True))
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in found) == want
    assert {"n", "fp", "th"} <= set(found[0].asDict())


@pytest.mark.parametrize("seed", range(20))
def test_two_stage_sort(seed):
    rnd = random.Random(seed)
    length = rnd.choice([34, 45, 60])
    letters = rnd.choice([b"ab", b"abc", b"a", b"\x00a\xff"])
    runs = [bytes(rnd.choice(letters) for _ in range(rnd.randint(length, length + 80))) for _ in range(rnd.randint(1, 15))]
    runs += [rnd.choice(runs)[: length + 3] for _ in range(2)]
    c = Counter(r[i : i + length] for r in runs for i in range(len(r) - length + 1))
    for r, mask in zip(runs, suffix_dedup.repeated_starts(runs, length), strict=True):
        assert [c[r[i : i + length]] > 1 for i in range(len(r) - length + 1)] == mask.tolist()


def test_no_repeats_and_empty(spark):
    one = suffix_dedup.remove_repeats(frame(spark, [(1, "short"), (2, None)])).collect()
    assert all(not r.spans for r in one)
    assert suffix_dedup.remove_repeats(frame(spark, [(1, "x")]).limit(0)).count() == 0
