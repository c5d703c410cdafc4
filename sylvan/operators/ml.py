"""Classifiers on tree-year features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def random_forest(train: DataFrame, features: list[str], label: str, trees: int = 500, depth: int = 30, seed: int = 42, weight: str | None = None) -> PipelineModel:
    """Depth is at most 30 here, where the unbounded trees of other libraries
    grow on. Rows keep the node that they have come to in each tree, so a
    level doesn't descend from the roots again."""
    more = {"weightCol": weight} if weight else {}
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=1, seed=seed, cacheNodeIds=True, maxMemoryInMB=1024, **more)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), forest]).fit(train)


def importances(model: PipelineModel) -> DataFrame:
    """feature, importance: the largest first."""
    from pyspark.sql import SparkSession

    names, values = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(names, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def perceptron(train: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (64, 128), classes: int = 2, rounds: int = 80, seed: int = 42) -> PipelineModel:
    """The annual-metrics branch as a feed-forward network."""
    net = MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=[len(features), *hidden, classes], maxIter=rounds, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), net]).fit(train)


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with prob_conifer, prob_broadleaf and y_pred."""
    out = model.transform(df)
    p = vector_to_array("probability")
    return out.select(*df.columns, p[0].alias("prob_conifer"), p[1].alias("prob_broadleaf"), F.col("prediction").cast("int").alias("y_pred"))


def mean_loss(scored: DataFrame, label: str) -> DataFrame:
    """Mean cross entropy and accuracy over the rows."""
    p = F.when(F.col(label) == 0, F.col("prob_conifer")).otherwise(F.col("prob_broadleaf"))
    return scored.agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))).alias("loss"), F.avg((F.col(label) == F.col("y_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
