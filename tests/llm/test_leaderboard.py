"""The change feed against a plain replay: hot and tied items, negative and null amounts, late lines, odd rows."""

import random

from pyspark.sql import Row
from pyspark.sql import types as T

from quillon.llm import leaderboard

LINES = T.StructType([T.StructField("board", T.IntegerType()), T.StructField("item", T.LongType()), T.StructField("day", T.LongType()), T.StructField("arrival", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("batch", T.IntegerType()), T.StructField("shard", T.StringType())])


def replay(lines, top, lateness):
    """Every line in order of batches and arrival days, boards compared after each day."""
    revenue, boards, high, out = {}, {}, None, []
    for batch in sorted({r["batch"] for r in lines}):
        own = [r for r in lines if r["batch"] == batch]
        used = [r for r in own if r["board"] is not None and r["item"] is not None and (high is None or r["day"] + lateness >= high)]
        for arrival in sorted({r["arrival"] for r in used}):
            for r in used:
                if r["arrival"] == arrival:
                    revenue[r["board"], r["item"]] = revenue.get((r["board"], r["item"]), 0.0) + (r["amount"] or 0.0)
            for board in {b for b, _ in revenue}:
                order = sorted((-v, i) for (b, i), v in revenue.items() if b == board and v > 0)[:top]
                now, old = {i: k for k, (_, i) in enumerate(order, 1)}, boards.get(board, {})
                for i in old.keys() | now.keys():
                    if old.get(i) != now.get(i):
                        kind = "enter" if i not in old else "exit" if i not in now else "move"
                        out.append((board, arrival, i, batch, kind, old.get(i), now.get(i), revenue[board, i]))
                boards[board] = now
        high = max([r["day"] for r in own] + ([high] if high is not None else []))
    return sorted(out)


def test_against_replay(spark):
    random.seed(3)
    lines = []
    for _ in range(1500):
        batch, hot = random.randint(1, 3), random.random() < 0.33
        lines.append({"board": 0 if hot else random.choice([0, 1, 2, None]), "item": 5 if hot and random.random() < 0.5 else random.choice([*range(40), None]), "day": batch * 6 + random.randint(-8, 2), "arrival": batch * 6 + random.randint(0, 5), "amount": random.choice([None, 100.0, 100.0, 250.0, -300.0, float(random.randint(1, 999))]), "batch": batch, "shard": "x"})
    lines += lines[:50]
    df = spark.createDataFrame([Row(**r) for r in lines], LINES)
    for shards in (1, 7):
        out = leaderboard.change_feed(df, top=4, lateness=3, shards=shards)
        assert out.columns == [c.split()[0] for c in leaderboard.CHANGES.split(", ")]
        assert sorted(tuple(r) for r in out.collect()) == replay(lines, 4, 3)


def test_no_lines(spark):
    assert leaderboard.change_feed(spark.createDataFrame([], LINES)).count() == 0
