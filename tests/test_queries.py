"""Every query of the package's own operators against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quillon.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _near(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4) or (math.isnan(a) and math.isnan(b)))
    return str(a) == str(b)


def _key(row):
    return tuple("" if v is None else f"{v:.3g}" if isinstance(v, float) else str(v) for v in sorted(row, key=lambda v: isinstance(v, float)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wants = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert len(rows) == len(wants)
    keys = [c for c in columns if c.endswith(("key", "_id", "id")) or c in ("s", "t", "step", "rk", "model", "batch", "fold")]
    order = lambda r: tuple(str(r[columns.index(c)]) for c in keys) if keys else _key(r)
    for a, b in zip(sorted(rows, key=order), sorted(wants, key=order), strict=True):
        assert all(_near(x, y) for x, y in zip(a, b, strict=True)), (a, b)
