"""Verification metrics as DataFrames.

Each starts with one hash aggregate that combines map-side, so what is shuffled
depends on the number of classes (or distinct scores), not on the number of rows.
"""

from __future__ import annotations

from pyspark.ml.clustering import LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``n, n_unscored, rmse, mae, r2``.

    Rows the model cannot score (a recommender answers NaN for an unseen user or
    item) are counted in ``n_unscored`` and left out of the error terms.
    """
    pred = F.col(prediction).cast("double")
    scored = pred.isNotNull() & ~F.isnan(pred)
    y = F.when(scored, F.col(label).cast("double"))
    err = y - pred
    return df.agg(
        F.count(y).alias("n"),
        F.count_if(~scored).alias("n_unscored"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.sum(err * err) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, n``, one row per pair that occurs."""
    return df.groupBy(
        F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_by_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``class, n_actual, n_predicted, n_correct, precision, recall, f1`` per class.

    Built from the confusion table, each of whose rows counts once for its actual
    and once for its predicted class. A ratio with nothing below it is 0.
    """
    return _by_class(confusion(df, label, prediction))


def _by_class(pairs: DataFrame) -> DataFrame:
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("a"), none.alias("p"), hit.alias("c")),
        F.struct(F.col("prediction").alias("class"), none.alias("a"), F.col("n").alias("p"), none.alias("c")),
    )
    per_class = (
        pairs.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("a").alias("n_actual"), F.sum("p").alias("n_predicted"), F.sum("c").alias("n_correct"))
    )
    precision = F.coalesce(F.try_divide("n_correct", "n_predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("n_correct", "n_actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("n_correct"), F.col("n_actual") + F.col("n_predicted")), F.lit(0.0))
    return per_class.withColumns({"precision": precision, "recall": recall, "f1": f1})


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``n, accuracy, precision, recall, f1``, the last three weighted by class size."""
    return _over_classes(classification_by_class(df, label, prediction))


def _over_classes(by_class: DataFrame) -> DataFrame:
    def weighted(name: str):
        return (F.sum(F.col(name) * F.col("n_actual")) / F.sum("n_actual")).alias(name)

    return by_class.agg(
        F.coalesce(F.sum("n_actual"), F.lit(0)).alias("n"),
        (F.sum("n_correct") / F.sum("n_actual")).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
    )


def positive_score(df: DataFrame, column: str) -> Column:
    """A classifier's score of the second of two classes, also from its vector of two."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return vector_to_array(column)[1]
    return F.col(column).cast("double")


def score_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "rawPrediction") -> DataFrame:
    """``label, prediction, score, n``: all that the metrics of a classifier with its ROC need, in one pass."""
    return df.groupBy(
        F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction"), positive_score(df, score).alias("score")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_with_roc(counts: DataFrame) -> DataFrame:
    """The metrics of ``classification_metrics`` and ``area_under_roc`` from ``score_counts``."""
    metrics = _over_classes(_by_class(counts.groupBy("label", "prediction").agg(F.sum("n").alias("n"))))
    return metrics.withColumn("area_under_roc", F.lit(_exact_roc(counts)).cast("double"))


def _exact_roc(counts: DataFrame) -> float | None:
    """The evaluator groups equal scores map-side and range-partitions the distinct ones; ``numBins=0`` keeps every one of them."""
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", weightCol="n", numBins=0)
    return None if counts.isEmpty() else float(evaluator.evaluate(counts.withColumn("n", F.col("n").cast("double"))))


def area_under_roc(df: DataFrame, label: str = "label", score: str = "rawPrediction") -> DataFrame:
    """One row ``area_under_roc``, exact also for tied scores; null without rows. What it sorts is a row per distinct score."""
    scored = df.select(positive_score(df, score).alias("score"), F.col(label).cast("double").alias("label"))
    auc = _exact_roc(scored.withColumn("n", F.lit(1)))
    return df.sparkSession.createDataFrame([(auc,)], "area_under_roc double")


def clustering_metrics(df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
    """One row ``n, n_clusters, silhouette`` (null with fewer than two clusters)."""
    sizes = df.groupBy(prediction).agg(F.count(F.lit(1)).alias("n"))
    n, clusters = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    silhouette = None
    if clusters > 1:
        silhouette = float(ClusteringEvaluator(featuresCol=features, predictionCol=prediction).evaluate(df))
    return df.sparkSession.createDataFrame(
        [(int(n), int(clusters), silhouette)], "n bigint, n_clusters bigint, silhouette double"
    )


def topic_metrics(df: DataFrame, model: LDAModel) -> DataFrame:
    """One row ``n, log_likelihood, log_perplexity`` of a topic model."""
    # The perplexity's logarithm is the bound per token, so one pass over the topics serves both.
    column = model.getFeaturesCol()
    tokens = F.aggregate(vector_to_array(column), F.lit(0.0), lambda s, x: s + x)
    n, total = df.agg(F.count(F.lit(1)), F.sum(tokens)).first()
    bound = float(model.logLikelihood(df)) if n else None
    row = (n, bound, -bound / total if total else None)
    return df.sparkSession.createDataFrame([row], "n bigint, log_likelihood double, log_perplexity double")
