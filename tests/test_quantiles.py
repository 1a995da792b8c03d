"""Exact quantiles by ranges and bins by many edges, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import ordered


def test_quantiles(spark):
    x = [3.0, 1.0, 1.0, 1.0, 9.0, 4.5, -2.0] * 5 + [1e9]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "`a b` double")
    wanted = (0.0, 0.2, 0.25, 0.5, 0.9, 0.99, 1.0)
    found = ordered.quantiles(df, "a b", wanted)
    assert [found[q] for q in wanted] == pytest.approx([float(np.quantile(x, q)) for q in wanted])
    assert ordered.quantiles(df.limit(0), "a b", (0.5,)) == {0.5: None}


def test_many_quantiles_and_bins(spark):
    x = np.round(np.random.default_rng(6).normal(size=700), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    wanted = [i / 150 for i in range(151)]
    found = ordered.quantiles(df, "x", wanted)
    assert [found[q] for q in wanted] == pytest.approx(np.quantile(x, wanted).tolist())
    edges = sorted(set(found.values()))
    for cut in (edges, edges[::9], []):
        got = {(r.x, r.b) for r in df.withColumn("b", ordered.bin_of(F.col("x"), cut)).collect()}
        assert got == {(float(v), int(np.searchsorted(cut, v, side="right"))) for v in x} | {(None, 0)}
