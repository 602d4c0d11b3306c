"""Models of labels on stored vectors: one logistic model a column and fold, fitted by pyspark.ml with the cells' weights, and their predictions.

The networks that the vectors come from are the user's; this is the part from pooled vectors to out-of-fold scores."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit_column(rows: DataFrame, l2: float = 0.01, steps: int = 50) -> LogisticRegressionModel | None:
    """A model from x (array of doubles), label and weight; None unless both labels are there with weight."""
    known = rows.where("label IS NOT NULL AND weight > 0").select(array_to_vector(F.col("x")).alias("features"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    low, high = known.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return None
    return LogisticRegression(weightCol="weight", regParam=l2, maxIter=steps).fit(known)


def predict(rows: DataFrame, model: LogisticRegressionModel | None, key: str = "doc_id") -> DataFrame:
    """key, p; 0.5 without a model."""
    if model is None:
        return rows.select(key, F.lit(0.5).alias("p"))
    scored = model.transform(rows.select(key, array_to_vector(F.col("x")).alias("features")))
    return scored.select(key, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def out_of_fold(vectors: DataFrame, targets: DataFrame, folds: DataFrame, columns: list[str], k: int, key: str = "doc_id") -> DataFrame:
    """key, column, fold, p: every key's score by the model that was fitted without its fold. vectors: key, x. targets: key, column, label, weight. folds: key, fold."""
    rows = vectors.join(folds, key)
    parts = []
    for c in columns:
        cells = rows.join(targets.where(F.col("column") == c).select(key, "label", "weight"), key, "left")
        for fold in range(k):
            model = fit_column(cells.where(F.col("fold") != fold))
            parts.append(predict(rows.where(F.col("fold") == fold), model, key).select(key, F.lit(c).alias("column"), F.lit(fold).alias("fold"), "p"))
    return reduce(DataFrame.unionByName, parts)


def save_model(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def write_summary(spark: SparkSession, values: dict, path: str) -> None:
    """A configuration or summary as one line of JSON below a folder."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)
