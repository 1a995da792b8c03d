"""Voronoi archives against plain ones: centres, cells, merges in any grouping, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import voronoi
from quillon.sources.scratch import scratch_path

SCHEMA = "ind_id long, fitness double, vector array<double>, cell string, in_cell int"
ODD = [(900, 0.0, None), (901, 0.0, [0.0, 0.0, 0.0]), (902, 0.0, [float("nan"), 1.0, 1.0]), (903, 0.0, [None, 1.0, 1.0]), (904, None, [1.0, 1.0, 1.0]), (905, float("nan"), [1.0, 1.0, 1.0]), (906, 0.0, [float("inf"), 1.0, 1.0])]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    return [(i, float(r.integers(0, 40)), r.normal(size=3).tolist()) for i in range(300)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA)


def plain_centres(rows, k, rounds):
    x = np.array([v for _, _, v in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    chosen = [0]
    while len(chosen) < k:
        far = np.min([np.sqrt(((x - x[c]) ** 2).sum(1)) for c in chosen], axis=0)
        far[chosen] = -1
        chosen.append(int(np.argmax(far)))
    centres = x[chosen]
    for _ in range(rounds):
        cell = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[cell == c].sum(0) / np.linalg.norm(x[cell == c].sum(0)) for c in range(k)])
    return centres, np.argmax(x @ centres.T, axis=1)


def plain_elites(rows, cell):
    best = {}
    for (i, f, _), c in sorted(zip(rows, cell, strict=True), key=lambda t: (t[0][1], t[0][0])):
        best.setdefault(int(c), i)
    return best


def test_centres_and_cells(spark, rows):
    df = table(spark, rows + ODD)
    want, cell = plain_centres(rows, 5, 4)
    got = voronoi.voronoi_centres(df.where("ind_id < 900 OR ind_id IN (900, 901, 902, 903, 906)"), 5, rounds=4)
    assert np.allclose(got, want)
    found = {r.ind_id: r.cell for r in voronoi.voronoi_cells(df.drop("cell"), want).collect()}
    assert {i: found[i] for i, _, _ in rows} == {i: int(c) for (i, _, _), c in zip(rows, cell, strict=True)}
    assert set(found) - {i for i, _, _ in rows} == {904, 905}  # a direction, but no fitness: cells yes, elites no


def test_weights_decide_the_means(spark):
    rows = [(0, 0.0, [1.0, 0.0]), (1, 1.0, [0.8, 0.6]), (2, 0.0, [-1.0, 0.0]), (3, -5.0, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, w) for r, w in zip(rows, (1.0, 3.0, 2.0, None), strict=True)], "ind_id long, fitness double, vector array<double>, w double")
    got = voronoi.voronoi_centres(df, 2, weight="w")
    mean = np.array([3.4, 1.8])
    assert np.allclose(got, [mean / np.linalg.norm(mean), [-1.0, 0.0]])


def test_merges_equal_all_at_once(spark, rows):
    centres, cell = plain_centres(rows, 5, 2)
    df, want = table(spark, rows + ODD), plain_elites(rows, cell)
    for cut in ("ind_id % 4", "CAST(nanvl(fitness, 33) / 11 AS INT)"):
        archive = voronoi.VoronoiArchive(spark, scratch_path(spark, "archive")).create(centres)
        assert archive.generations() == []
        for g in range(4):
            archive.merge(df.where(F.coalesce(F.expr(cut), F.lit(3)) == g), g)
        again = archive.merge(df.where(F.coalesce(F.expr(cut), F.lit(3)) == 3), 3)
        assert {r.cell: r.ind_id for r in again.collect()} == want
        assert {r.in_cell for r in again.collect()} == {7} and archive.generations() == [0, 1, 2, 3]
        assert sorted(again.columns) == sorted(df.columns)
        with pytest.raises(ValueError):
            archive.merge(df, 2)
        assert {r.cell: r.ind_id for r in archive.merge(df.limit(0), 4).collect()} == want


def test_an_empty_first_generation(spark, rows):
    centres, cell = plain_centres(rows, 3, 1)
    archive = voronoi.VoronoiArchive(spark, scratch_path(spark, "archive")).create(centres)
    assert archive.merge(table(spark, rows).limit(0), 0).count() == 0
    assert {r.cell: r.ind_id for r in archive.merge(table(spark, rows), 1).collect()} == plain_elites(rows, cell)


def test_candidates(spark, rows):
    df = table(spark, [*rows, (500, 1e6, [1.0, 2.0, 3.0])])
    old = table(spark, [(600, 5.0, [1.0, 0.0, 0.0]), (601, -1.0, [0.0, 1.0, 0.0])])
    ids = lambda t: {r.ind_id for r in t.collect()}
    best = [i for i, _, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert ids(voronoi.candidates(df, old, 10, "independent")) == {*best[:10], 600, 601}
    assert ids(voronoi.candidates(df, old, 10, "free")) == {*best, 500, 600, 601}
    assert ids(voronoi.candidates(df, old, 10_000, "combined")) == {*best, 600, 601}  # not the far worse one
    assert ids(voronoi.candidates(df, None, 3, "combined")) == set(best[:3])
    with pytest.raises(ValueError):
        voronoi.candidates(df, old, 10, "other")


def test_reclustered(spark, rows):
    first = voronoi.reclustered_archive(table(spark, rows + ODD), None, 6, 120)
    got = first.collect()
    assert 1 < len(got) <= 6 and sorted(first.columns) == sorted("ind_id fitness vector cell in_cell".split())
    best = min(rows, key=lambda r: (r[1], r[0]))[0]
    assert best in {r.ind_id for r in got}  # the best of all is the best of its cell
    second = voronoi.reclustered_archive(table(spark, [(700, -3.0, [1.0, 1.0, 0.0])]), first, 6, 120)
    assert 700 in {r.ind_id for r in second.collect()}
    assert voronoi.reclustered_archive(table(spark, rows).limit(0), None, 6, 120).count() == 0
    assert voronoi.reclustered_archive(table(spark, [(1, 2.0, [1.0, 1.0, 0.0])] * 3), None, 6, 120).count() == 1
    assert voronoi.reclustered_archive(table(spark, ODD[:2]), None, 6, 120).count() == 0


def test_members(spark):
    r = np.random.default_rng(4)
    y, base = r.normal(size=200), r.normal(size=(2, 200))
    p = np.stack([y + base[0], y + 2 * base[0] + 0.01 * base[1], y + 3 * base[1], y + base[1], y - base[0], y], axis=1)
    df = spark.createDataFrame([tuple(map(float, (*row, t))) for row, t in zip(p, y, strict=True)], "a double, b double, c double, d double, e double, f double, y double")
    got = voronoi.voronoi_members(df, list("abcd"), "y", 2)
    assert got == sorted("ad", key=lambda m: ((p[:, "abcd".index(m)] - y) ** 2).mean())
    assert len(voronoi.voronoi_members(df, list("abcde"), "y", 3)) == 3 and "e" in voronoi.voronoi_members(df, list("abcde"), "y", 3)
    assert voronoi.voronoi_members(df, list("f"), "y", 3) == ["f"]
    assert set(voronoi.voronoi_members(df, list("abcdef"), "y", 6)) <= set("abcdef")
    assert len(voronoi.voronoi_members(df, list("abcd"), "y", 2, symmetric=True)) == 2
