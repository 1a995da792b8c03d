"""The estimator end to end, model files, sources and streams."""

import pytest
from pyspark.sql import functions as F

from quillon.estimator import FeatureForest, Individual
from quillon.operators import encoding, ensemble, linear, metrics, sampling, scaling, selection
from quillon.plans.compiler import features, fit_groups
from quillon.plans.gene import key, parse
from quillon.sources import tables
from quillon.streaming import scoring


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(300).selectExpr("id", "sin(id) * 3 AS a", "cos(id * 2) AS b", "sin(id) * 3 * cos(id * 2) + sin(id) AS y").cache()


def test_forest_learns_a_product(spark, data, tmp_path):
    forest = FeatureForest(population=10, generations=2, genes=3, depth=2, ensemble=3, seed=3).fit(data, ["a", "b"], "y", "id")
    scored = forest.predict(data)
    r2 = scored.agg(metrics.r2(F.col("y"), F.col("prediction"), scored)).first()[0]
    assert r2 > 0.9
    assert abs(sum(forest.importance().values()) - 1) < 1e-9
    assert "f0" in forest.transform(data).columns and "a" in forest.formula() + forest.formula()
    tables.save_model(spark, forest.describe(), str(tmp_path / "m"))
    again = FeatureForest.restore(tables.load_model(spark, str(tmp_path / "m"))).predict(data)
    gap = scored.join(again.select("id", F.col("prediction").alias("p2")), "id").agg(F.max(F.abs(F.col("prediction") - F.col("p2")))).first()[0]
    assert gap < 1e-9


def test_prediction_does_not_depend_on_the_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS k", "sin(id) + 2 AS v", "id * 0.37 AS w", "sin(id) + id % 7 AS y").cache()
    forest = FeatureForest(population=4, generations=0, genes=2, depth=1, ensemble=2).fit(rows, ["k", "v", "w"], "y", "id")
    genes = [parse(g) for g in ("GroupByMean(k, v)", "Add(GroupByCount(k), GroupByVar(w, v))", "GroupByMax(GroupByMedian(k, v), w)", "GroupByCount(w)")]
    forest.hall = [Individual(genes, 0.0, linear.LinearModel(tuple(key(g) for g in genes), 1.0, (1.0, 2.0, 3.0, 4.0)))]
    with pytest.raises(ValueError):
        forest.predict(rows)
    forest.groups = fit_groups(rows, genes)
    whole = {r["id"]: r["prediction"] for r in forest.predict(rows).collect()}
    plain = features(rows, genes, keep=["id"]).collect()
    assert len(whole) == 200 and all(abs(1 + r.g0 + 2 * r.g1 + 3 * r.g2 + 4 * r.g3 - whole[r.id]) < 1e-9 for r in plain)
    forest.save(spark, str(tmp_path / "forest"))
    again = FeatureForest.load(spark, str(tmp_path / "forest"))
    for i in (0, 123):
        assert abs(again.predict(rows.where(f"id = {i}")).first()["prediction"] - whole[i]) < 1e-9
    unseen = features(spark.createDataFrame([(99.0, 4.0), (None, 4.0)], "k double, v double"), genes[:1], groups=forest.groups).collect()
    mean = rows.agg(F.avg("v")).first()[0]
    assert all(abs(r[0] - 4 / mean) < 1e-9 for r in unseen)


def test_sources(spark, data, tmp_path):
    for kind in tables.FORMATS:
        tables.write(data, str(tmp_path / kind), kind)
        assert tables.read(spark, str(tmp_path / kind), kind).count() == 300
    with pytest.raises(ValueError):
        tables.check_features(data, ["nope"])
    with pytest.raises(ValueError):
        tables.read(spark, "x", "xml")


def test_streams(spark, data, tmp_path):
    tables.write(data.withColumn("ts", F.timestamp_seconds(F.col("id") * 60)), str(tmp_path / "in"))
    schema = tables.read(spark, str(tmp_path / "in")).schema
    stream = scoring.read_stream(spark, str(tmp_path / "in"), schema)
    scoring.write_stream(scoring.score(stream, ["Add(a, b)"], ["g"], ["id"]), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).join(data, "id")
    assert got.count() == 300 and got.where("abs(g - a - b) > 1e-9").count() == 0
    q = scoring.windowed_moments(stream.withColumn("k", F.lit(1)), "ts", "k", "a", "1 hour", "10 minutes").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM moments").first()[0] == 300


def test_linear_invariants(data):
    out, alpha = linear.loo_predictions(data, ["a", "b"], "y")
    assert alpha in (0.1, 1.0, 10.0) and out.where("loo IS NULL").count() == 0
    drop = linear.r2_drop(data, ["a", "b"], "y")
    assert drop["a"] > drop["b"] >= 0
    assert linear.forward_selection(data, ["b", "a"], "y", 1) == ["a"]


def test_selection_invariants(spark):
    pop = spark.createDataFrame([(i, float(i % 7), float((i * 5) % 11)) for i in range(40)], "ind_id long, f double, g double")
    front = {r.ind_id for r in selection.pareto_front(pop, ["f", "g"]).collect()}
    slow = {r.ind_id for r in pop.alias("a").join(pop.alias("b"), selection._dominates("b", "a", ["f", "g"]), "left_anti").collect()}
    assert front == slow
    layers = selection.pareto_layers(pop, ["f", "g"])
    assert layers.count() == 40 and {r.ind_id for r in layers.where("front = 0").collect()} == slow
    knee = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0), (2, 0.3, 0.3), (3, 0.2, 0.8), (4, 0.8, 0.2)], "ind_id long, f double, g double")
    assert selection.knee_point(knee, "f", "g").first().ind_id == 2


def test_drep_weights_sum_to_one(spark):
    rows = [(1.0, 0.8, 1.1, 1.3), (2.0, 2.2, 1.9, 2.0), (3.0, 2.7, 3.1, 3.0), (4.0, 3.9, 3.8, 4.2), (5.0, 5.1, 5.2, 4.8)]
    found = ensemble.drep_weights(spark.createDataFrame(rows, "y double, p double, q double, r double"), ["p", "q", "r"], "y")
    assert abs(sum(found.values()) - 1) < 1e-9 and all(0 <= w <= 1 for w in found.values())


def test_nearest_value_and_unseen(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (3.0, "b")], "x double, c string")
    df = spark.createDataFrame([(0.0, "a"), (2.0, "z"), (9.0, None)], "x double, c string")
    assert [r.n for r in encoding.nearest_value(train, df, "x", "n").orderBy("x").collect()] == [1.0, 1.0, 3.0]
    assert [r.k for r in encoding.ordinal(df, encoding.codes(train, "c"), "c", "k").orderBy("x").collect()] == [0, -1, -1]


def test_scalers_on_constants(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for fit in (scaling.standard, scaling.min_max, scaling.robust, scaling.safety, scaling.robust_clip):
        assert {r.x for r in fit(df, ["x"]).apply(df).collect()} == {0.0}
    assert scaling.drop_constant(df, ["x"]) == []


def test_split_covers_all(spark):
    parts = spark.range(1000).select(sampling.split("id", {"a": 70, "b": 30}).alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 1000 and {r.p for r in parts} == {"a", "b"}


def test_text_columns(spark, tmp_path):
    """A text input is learnt as its target mean; unseen and null texts get the mean of all rows."""
    df = spark.range(400).selectExpr("id", "CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS kind", "CAST(id % 7 AS DOUBLE) AS x").selectExpr("*", "CASE kind WHEN 'a' THEN 10.0D WHEN 'b' THEN -5.0D ELSE 0.0D END + x AS y")
    forest = FeatureForest(population=6, generations=1, genes=2, depth=2, ensemble=2).fit(df, ["kind", "x"], "y", "id")
    odd = df.limit(5).unionByName(spark.createDataFrame([(900, "new", 1.0, None), (901, None, 2.0, None)], df.schema))
    assert forest.predict(odd).columns == ["id", "kind", "x", "y", "prediction"]
    first = {r.id: r.prediction for r in forest.predict(odd).collect()}
    assert all(v is not None for v in first.values()) and first[0] > first[1]
    forest.save(spark, str(tmp_path / "m"))
    again = {r.id: r.prediction for r in FeatureForest.load(spark, str(tmp_path / "m")).predict(odd).collect()}
    assert again == first and any("kind__mean" in c for c in forest.columns_used())
