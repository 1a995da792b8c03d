"""Decayed moments of a table and of a stream, restarted between files, against the recurrence value by value."""

import random

import pytest

from quillon.streaming import decayed

SCHEMA = "k long, t long, i long, v double"
DECAY = 0.9


def recurrence(rows):
    """n = decay n + 1; the mean moves by its share of the gap; squared deviations fade and grow by both gaps."""
    out = {}
    for k, v in rows:
        n, mean, m2, count = out.get(k, (0.0, 0.0, 0.0, 0))
        n = DECAY * n + 1
        gap = v - mean
        mean += gap / n
        out[k] = (n, mean, DECAY * m2 + gap * (v - mean), count + 1)
    return {k: (n, mean, m2 / n, count) for k, (n, mean, m2, count) in out.items()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    out = [(7 if rnd.random() < 0.5 else rnd.randrange(5), rnd.randrange(300), i, 1e6 + rnd.gauss(0, 3)) for i in range(900)]
    return out + [(3, 5, 901, None), (3, 6, 902, float("nan")), (3, 7, 903, float("inf"))]


def same(found, want):
    assert {r.k: r.rows for r in found} == {k: w[3] for k, w in want.items()}
    for r in found:
        assert (r.n, r.mean, r["var"]) == pytest.approx(want[r.k][:3], rel=1e-6)


def test_table(spark, rows):
    found = decayed.decayed_moments(spark.createDataFrame(rows, SCHEMA), "k", "t", "i", "v", DECAY).collect()
    same(found, recurrence([(k, v) for k, t, i, v in sorted(rows[:900], key=lambda r: (r[1], r[2]))]))


def test_null_key_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, 1, 2.0), (None, None, 2, 4.0)], SCHEMA)
    r = decayed.decayed_moments(df, "k", "t", "i", "v", DECAY).first()
    assert r.k is None and r.rows == 2 and r.mean == pytest.approx((0.9 * 4 + 2) / 1.9)
    assert decayed.decayed_moments(df.where("i > 5"), "k", "t", "i", "v", DECAY).count() == 0
    with pytest.raises(ValueError, match="decay"):
        decayed.decayed_moments(df, "k", "t", "i", "v", 0.0)


def test_stream_restarted(spark, rows, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    want, last = [], {}
    for turn in range(2):
        part = [r for r in rows if r[2] % 2 == turn]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/turn={turn}")
        want += [(k, v) for k, t, i, v in sorted((r for r in part if r[2] < 900), key=lambda r: (r[1], r[2]))]
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")

        def keep(df, _):
            last.update({r.k: r for r in df.collect()})

        out = decayed.decayed_stream(stream, "k", "t", "i", "v", DECAY)
        out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        same(last.values(), recurrence(want))
