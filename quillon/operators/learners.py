"""Learners of pyspark.ml on feature columns, with cross-validated predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGRESSORS = {
    "tree": lambda seed: DecisionTreeRegressor(maxDepth=6, seed=seed),
    "forest": lambda seed: RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed),
    "boosted": lambda seed: GBTRegressor(maxIter=20, maxDepth=4, seed=seed),
    "lasso": lambda seed: LinearRegression(regParam=0.01, elasticNetParam=1.0),
    "elastic": lambda seed: LinearRegression(regParam=0.01, elasticNetParam=0.5),
    "huber": lambda seed: LinearRegression(loss="huber", regParam=0.01),
}
CLASSIFIERS = {
    "logistic": lambda seed: LogisticRegression(regParam=0.01),
    "tree": lambda seed: DecisionTreeClassifier(maxDepth=6, seed=seed),
    "forest": lambda seed: RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed),
}


def _vectors(df: DataFrame, features: Sequence[str], y: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return out.withColumn("label", F.col(y).cast("double")) if y else out


def regress(train: DataFrame, df: DataFrame, features: Sequence[str], y: str, kind: str = "forest", seed: int = 0) -> DataFrame:
    """df with prediction, by a regressor of REGRESSORS."""
    model = REGRESSORS[kind](seed).fit(_vectors(train, features, y))
    return model.transform(_vectors(df, features)).drop("features")


def classify(train: DataFrame, df: DataFrame, features: Sequence[str], y: str, kind: str = "logistic", balanced: bool = True, seed: int = 0) -> DataFrame:
    """df with prediction and probabilities (an array), by a classifier of CLASSIFIERS; balanced weighs classes equally."""
    rows = _vectors(train, features, y)
    estimator = CLASSIFIERS[kind](seed)
    if balanced:
        counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
        n, k = rows.count(), counts.count()
        rows = rows.join(counts, "label").withColumn("__w", F.lit(n / k) / F.col("__n"))
        estimator = estimator.setWeightCol("__w")
    out = estimator.fit(rows).transform(_vectors(df, features))
    return out.withColumn("probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability")


def cross_val(df: DataFrame, features: Sequence[str], y: str, fold: Column, folds: int, kind: str = "tree", seed: int = 0) -> DataFrame:
    """df with fold and prediction, each fold's by a model of the others."""
    rows = df.withColumn("fold", fold).persist()
    parts = [regress(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), features, y, kind, seed) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_features(df: DataFrame, features: Sequence[str], y: str, keep: int, seed: int = 0) -> list[str]:
    """The features of largest importance in a random forest."""
    model = REGRESSORS["forest"](seed).fit(_vectors(df, features, y))
    scores = model.featureImportances.toArray()
    return [features[i] for i in sorted(range(len(features)), key=lambda i: (-scores[i], i))[:keep]]


def pca(df: DataFrame, features: Sequence[str], k: int, prefix: str = "pc") -> DataFrame:
    """df with the first k principal components of the columns."""
    rows = _vectors(df, features)
    out = PCA(k=k, inputCol="features", outputCol="__pc").fit(rows).transform(rows).withColumn("__pc", vector_to_array("__pc"))
    return out.withColumns({f"{prefix}{i}": F.get("__pc", F.lit(i)) for i in range(k)}).drop("features", "__pc")


def kmeans_bins(df: DataFrame, column: str, k: int, output: str, seed: int = 0) -> DataFrame:
    """df with the cluster of a column, clusters numbered by their centres."""
    rows = _vectors(df, [column])
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="__c").fit(rows)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: float(model.clusterCenters()[i][0]))
    place = F.create_map(*(x for new, old in enumerate(order) for x in (F.lit(old), F.lit(new))))
    return model.transform(rows).withColumn(output, place[F.col("__c")]).drop("features", "__c")
