"""Verification metrics of a fixed rule, so that SQL can say what they must be."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscore import run_train
from trainscore.functions import (
    area_under_roc,
    classification_by_class,
    classification_metrics,
    classification_with_roc,
    clustering_metrics,
    confusion,
    regression_metrics,
    score_counts,
)

from . import query
from .common import parquet_source, table

# The rule: events with large values are purchases or views, by their size.
RULE = "CASE WHEN value > 80 THEN 2 WHEN value > 30 THEN 1 ELSE 0 END"
ACTUAL = "CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"

RULE_CTE = f"""
  p AS (SELECT CAST({ACTUAL} AS DOUBLE) AS label, CAST({RULE} AS DOUBLE) AS prediction FROM events),
  classes AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
  counts AS (
    SELECT class, count(*) FILTER (label = class) AS n_actual, count(*) FILTER (prediction = class) AS n_predicted,
           count(*) FILTER (label = class AND prediction = class) AS n_correct
    FROM p, classes GROUP BY class),
  ratios AS (
    SELECT *, coalesce(n_correct / nullif(n_predicted, 0), 0) AS precision,
           coalesce(n_correct / nullif(n_actual, 0), 0) AS recall,
           coalesce(2 * n_correct / nullif(n_actual + n_predicted, 0), 0) AS f1
    FROM counts)
"""


def _rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr(ACTUAL).alias("label"), F.expr(RULE).alias("prediction"))


@query(f"WITH {RULE_CTE} SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL")
def metrics_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_rule(spark, sf_dir))


@query(
    f"""WITH {RULE_CTE} SELECT class, n_actual, n_predicted, n_correct, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ratios"""
)
def metrics_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = classification_by_class(_rule(spark, sf_dir))
    return metrics.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""WITH {RULE_CTE}
        SELECT CAST(sum(n_actual) AS BIGINT) AS n, round(sum(n_correct) / sum(n_actual), 6) AS accuracy,
               round(sum(precision * n_actual) / sum(n_actual), 6) AS precision,
               round(sum(recall * n_actual) / sum(n_actual), 6) AS recall,
               round(sum(f1 * n_actual) / sum(n_actual), 6) AS f1
        FROM ratios"""
)
def metrics_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = classification_metrics(_rule(spark, sf_dir))
    return metrics.select("n", *[F.round(c, 6).alias(c) for c in metrics.columns if c != "n"])


@query(
    """WITH e AS (SELECT value AS y, value - CAST(props->>'k' AS DOUBLE) AS e FROM events)
       SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_unscored, round(sqrt(avg(e * e)), 6) AS rmse,
              round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2
       FROM e"""
)
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k of an event taken as the prediction of its value."""
    k = F.get_json_object("props", "$.k").cast("double")
    metrics = regression_metrics(table(spark, sf_dir, "events").select(F.col("value").alias("label"), k.alias("prediction")))
    return metrics.select("n", "n_unscored", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


@query(
    """WITH ranked AS (
         SELECT l_returnflag = 'R' AS positive,
                rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS mid_rank
         FROM lineitem)
       SELECT round((sum(mid_rank) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0)
                    / (count(*) FILTER (positive) * CAST(count(*) FILTER (NOT positive) AS DOUBLE)), 8) AS area_under_roc
       FROM ranked"""
)
def metrics_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity of a line as the score for being returned; most scores are tied."""
    scored = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"), F.col("l_quantity").alias("score")
    )
    return area_under_roc(scored, score="score").select(F.round("area_under_roc", 8).alias("area_under_roc"))


@query("SELECT count(*) AS n, CAST(2 AS BIGINT) AS n_clusters, TRUE AS separated FROM lineitem")
def metrics_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of line quantities lie apart, as their silhouette says."""
    job = {
        "appName": "quantities",
        "algoClass": "KMeans",
        "sourceParameter": parquet_source(sf_dir, "lineitem"),
        "dataParameter": {"features": ["l_quantity"]},
        "algoParameter": {"k": 2, "seed": 3},
    }
    metrics = run_train(spark, job).metrics
    return metrics.select("n", "n_clusters", (F.col("silhouette") > 0.5).alias("separated"))


CLUSTER = "CASE WHEN l_quantity > 35 THEN 2 WHEN l_quantity > 15 THEN 1 ELSE 0 END"


@query(
    f"""WITH p AS (SELECT l_quantity AS x, 100 * l_discount AS y, {CLUSTER} AS c FROM lineitem),
       sums AS (SELECT c, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS sq FROM p GROUP BY c),
       away AS (SELECT p.c, s.c AS other, s.n,
                       s.n * (x * x + y * y) + s.sq - 2 * (x * s.sx + y * s.sy) AS total, row_id
                FROM (SELECT *, row_number() OVER () AS row_id FROM p) p, sums s),
       each AS (SELECT row_id, max(total / (n - 1)) FILTER (c = other) AS a, min(total / n) FILTER (c <> other) AS b FROM away GROUP BY row_id)
       SELECT count(*) AS n, CAST(3 AS BIGINT) AS n_clusters, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM each"""
)
def metrics_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by a rule, so that SQL can compute the silhouette of squared distances."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", (100 * F.col("l_discount")).alias("y"), F.expr(CLUSTER).alias("prediction"))
    points = VectorAssembler(inputCols=["l_quantity", "y"], outputCol="features").transform(lines)
    return clustering_metrics(points).withColumn("silhouette", F.round("silhouette", 6))


@query(
    """WITH
       two AS (SELECT CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 1 ELSE 0 END AS label, floor(value) AS score,
                      CASE WHEN value > 30 THEN 1 ELSE 0 END AS prediction FROM events),
       ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid_rank FROM two),
       auc AS (SELECT (sum(mid_rank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
                      / (count(*) FILTER (label = 1) * CAST(count(*) FILTER (label = 0) AS DOUBLE)) AS auc FROM ranked)
       SELECT count(*) AS n, round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy, round(any_value(auc), 6) AS area_under_roc
       FROM two, auc"""
)
def metrics_with_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and ROC of a two-class rule from one pass."""
    two = table(spark, sf_dir, "events").select(
        F.expr("CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END").alias("label"),
        F.expr("CASE WHEN value > 30 THEN 1 ELSE 0 END").alias("prediction"),
        F.floor("value").alias("score"),
    )
    metrics = classification_with_roc(score_counts(two, score="score"))
    return metrics.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "area_under_roc")])
