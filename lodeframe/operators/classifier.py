"""Supervised order classifiers: 28 features, standardised, then a linear model or a network of Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .events import order_features
from .sampling import split


def order_data(scored: DataFrame, e0: float, held_share: float = 0.25, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Features, label, columns to ``keep`` and ``held`` (whether the row's view is held out), and the features' names."""
    named = order_features(scored, e0)
    data = scored.select(*(keep or []), "view", F.col("front_first"), F.col("correct").cast("double").alias("by_score"), *[c.alias(n) for n, c in named])
    return split(data, "view", held_share).withColumn("label", F.col("front_first").cast("double")), [n for n, _ in named]


def _scaled(names: list[str]) -> list:
    return [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def order_accuracy(scored: DataFrame, e0: float, held_share: float = 0.25, rounds: int = 30) -> DataFrame:
    """Confusion and soft metrics on views that training hasn't seen, next to the hand-made scores' accuracy."""
    data, names = order_data(scored, e0, held_share)
    data = data.persist()
    model = Pipeline(stages=[*_scaled(names), LogisticRegression(maxIter=rounds, regParam=1e-4)]).fit(data.filter(~F.col("held")))
    out = model.transform(data.filter("held")).withColumn("p", vector_to_array("probability")[1])
    hard = metrics.confusion(out, F.col("front_first"), F.col("p") >= 0.5)
    soft = metrics.soft(out, F.col("front_first"), F.col("p")).drop("n")
    return hard.crossJoin(soft).crossJoin(out.agg(F.avg("by_score").alias("score_accuracy")))  # one row each


def train_network(data: DataFrame, names: list[str], hidden: tuple[int, ...] = (32, 16), rounds: tuple[int, ...] = (20, 40, 60), seed: int = 7) -> tuple[PipelineModel, list[tuple[int, float]]]:
    """A network of the standardised features, fitted for each number of rounds; the model that does best on the held-out rows (the first of equal ones), and (rounds, accuracy) of all."""
    layers, best, tried = [len(names), *hidden, 2], None, []
    train, held = data.filter(~F.col("held")).persist(), data.filter("held").persist()
    for n in rounds:
        model = Pipeline(stages=[*_scaled(names), MultilayerPerceptronClassifier(layers=layers, maxIter=n, seed=seed, blockSize=256)]).fit(train)
        right = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
        if best is None or right > max(a for _, a in tried):
            best = model
        tried.append((n, right))
    train.unpersist()
    held.unpersist()
    return best, tried


def save(model: PipelineModel, path: str) -> None:
    """The network's weights with the features' means and deviations."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
