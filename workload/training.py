"""Splitting and training."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscore import load_source, run_train
from trainscore.functions import apply_data_spec
from trainscore.operators import Split, keyed_split, random_split, row_split, with_row_key
from trainscore.operators.estimators import MLAlgorithm, find_estimator
from trainscore.operators.scorers import load_ml_model
from trainscore.spec import DataSpec, SourceSpec
from trainscore.storage import fresh_path

from . import ORACLES, query
from .common import EVENT_BITS, LINEAR_FIT, ORDER_BITS, als_job, linear_job, parquet_source, table


def _sides(split, *aggregates) -> DataFrame:
    parts = [
        rows.agg(F.lit(side).alias("side"), *aggregates)
        for side, rows in (("train", split.train), ("verify", split.verify))
    ]
    return parts[0].unionByName(parts[1])


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def _key_sum() -> Column:
    return F.sum("o_orderkey").alias("key_sum")


@query(
    f"""SELECT CASE WHEN {ORDER_BITS} < 0.7 * 4294967296.0 THEN 'train' ELSE 'verify' END AS side,
               count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
        FROM orders GROUP BY 1"""
)
def split_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = keyed_split(table(spark, sf_dir, "orders"), ["o_orderkey"], (0.7, 0.3))
    return _sides(split, _count(), _key_sum())


@query("SELECT count(*) AS n, TRUE AS both_sides, count(*) FILTER (l_linenumber % 3 = 0) AS n_null FROM lineitem")
def split_keyed_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key are divided like others, each into one part."""
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.expr("if(l_linenumber % 3 = 0, null, l_orderkey)"))
    split = keyed_split(rows, ["key"], (0.7, 0.3))
    sides = split.train.withColumn("side", F.lit(1)).unionByName(split.verify.withColumn("side", F.lit(0)))
    empty = F.col("key").isNull()
    share = F.avg(F.when(empty, F.col("side")))
    return sides.agg(
        F.count(F.lit(1)).alias("n"), share.between(0.6, 0.8).alias("both_sides"), F.count_if(empty).alias("n_null")
    )


@query(
    f"""SELECT CASE WHEN {ORDER_BITS} < 0.625 * 4294967296.0 THEN 'train' ELSE 'verify' END AS side,
               count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
        FROM orders GROUP BY 1"""
)
def split_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that sum to less than 1 still use every row."""
    split = keyed_split(table(spark, sf_dir, "orders"), ["o_orderkey"], (0.5, 0.3))
    return _sides(split, _count(), _key_sum())


@query(
    """SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, CAST(0 AS BIGINT) AS n_twice,
              TRUE AS share_as_asked
       FROM orders"""
)
def split_random_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random split keeps every row once, in about the share asked for."""
    return _whole_and_disjoint(random_split(table(spark, sf_dir, "orders").select("o_orderkey"), (0.7, 0.3), seed=11))


@query(ORACLES["split_random_partition"])
def split_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, decided by the place of each row in its file."""
    return _whole_and_disjoint(row_split(with_row_key(table(spark, sf_dir, "orders")), (0.7, 0.3), seed=11))


def _whole_and_disjoint(split: Split) -> DataFrame:
    rows = split.train.select("o_orderkey", F.lit(1).alias("in_train")).unionByName(
        split.verify.select("o_orderkey", F.lit(0).alias("in_train"))
    )
    per_key = rows.groupBy("o_orderkey").agg(_count(), F.sum("in_train").alias("in_train"))
    # Five standard deviations of a binomial draw.
    n, drawn = F.sum("n"), F.sum("in_train")
    return per_key.agg(
        n.alias("n"),
        F.sum(F.col("o_orderkey") * F.col("n")).alias("key_sum"),
        F.count_if(F.col("n") > 1).alias("n_twice"),
        (F.abs(drawn - 0.7 * n) <= 5 * F.sqrt(0.21 * n)).alias("share_as_asked"),
    )


@query("SELECT unnest(['train', 'verify']) AS side, n FROM (SELECT count(*) AS n FROM orders)")
def split_no_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verify weight 0: both parts are all rows."""
    return _sides(random_split(table(spark, sf_dir, "orders"), (1.0, 0.0)), _count())


@query(
    f"""WITH {LINEAR_FIT}
        SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit"""
)
def train_linear_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = run_train(spark, linear_job(sf_dir)).model
    fitted = [(float(model.coefficients[0]), float(model.intercept))]
    params = spark.createDataFrame(fitted, "slope double, intercept double")
    return params.select(*[F.round(c, 6).alias(c) for c in params.columns])


LINEAR_VERIFY = f"""WITH {LINEAR_FIT},
  err AS (SELECT y, y - (intercept + slope * x) AS e FROM pts, fit WHERE NOT in_train)
  SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_unscored, round(sqrt(avg(e * e)), 6) AS rmse,
         round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2
  FROM err"""


def rounded_regression(metrics: DataFrame) -> DataFrame:
    return metrics.select("n", "n_unscored", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


@query(LINEAR_VERIFY)
def train_linear_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, parse, split, fit and verify."""
    return rounded_regression(run_train(spark, linear_job(sf_dir)).metrics)


@query(LINEAR_VERIFY)
def save_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicator as saved by the job and read back."""
    path = fresh_path(spark, "indicator")
    metrics = run_train(spark, linear_job(sf_dir, modelIndicatorSavePath=path)).metrics
    return rounded_regression(spark.read.schema(metrics.schema).json(path))


class MeanOfEvents(MLAlgorithm):
    """Verifies with a text of its own."""

    def verify(self, rows: DataFrame, model: object) -> str:
        return json.dumps({"rows": rows.count(), "note": 'a "quoted" text'})


@query(
    f"""SELECT '{{"rows": ' || count(*) || ', "note": "a \\"quoted\\" text"}}' AS value
        FROM events WHERE NOT ({EVENT_BITS} < 0.7 * 4294967296.0)"""
)
def save_indicator_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin's indicator text is saved as it is."""
    path = fresh_path(spark, "indicator")
    job = linear_job(sf_dir, modelIndicatorSavePath=path)
    run_train(spark, job, MeanOfEvents(find_estimator("LinearRegression")))
    return spark.read.text(path)


FLAG_CLASS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END"


@query(
    f"""WITH sums AS (
          SELECT CAST({FLAG_CLASS} AS INTEGER) AS class, count(*) AS n_class,
                 [sum(l_quantity), sum(l_linenumber), sum(l_discount)] AS x
          FROM lineitem GROUP BY 1),
        cells AS (
          SELECT class, n_class, list_sum(x) AS total, unnest([0, 1, 2]) AS feature, unnest(x) AS x FROM sums)
        SELECT class, CAST(feature AS INTEGER) AS feature,
               round(ln(x + 1) - ln(total + 3), 6) AS theta,
               round(ln(n_class + 1) - ln((SELECT sum(n_class) + count(*) FROM sums)), 6) AS pi
        FROM cells"""
)
def train_bayes_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes of the return flag: its fitted log probabilities."""
    job = {
        "appName": "flags",
        "algoClass": "NaiveBayes",
        "sourceParameter": parquet_source(sf_dir, "lineitem"),
        "dataParameter": {"label": FLAG_CLASS, "features": ["l_quantity", "l_linenumber", "l_discount"]},
        "algoParameter": {"modelType": "multinomial", "smoothing": 1.0},
    }
    model = run_train(spark, job).model
    rows = [
        (c, f, float(model.theta[c, f]), float(model.pi[c]))
        for c in range(model.numClasses)
        for f in range(model.numFeatures)
    ]
    fitted = spark.createDataFrame(rows, "class int, feature int, theta double, pi double")
    return fitted.withColumns({c: F.round(c, 6) for c in ("theta", "pi")})


class DocumentQuality(MLAlgorithm):
    """A classifier of documents whose loader joins their labels to them."""

    def load(self, spark: SparkSession, source: SourceSpec) -> DataFrame:
        documents = load_source(spark, parquet_source(source.source, "documents")).select("doc_id", "lang", "n_chars")
        labels = load_source(spark, parquet_source(source.source, "labels"))
        return documents.join(labels, "doc_id")


@query(
    """WITH rates AS (
         SELECT lang = 'en' AS is_en, avg(quality) AS p
         FROM documents JOIN labels USING (doc_id) GROUP BY 1),
       logits AS (SELECT is_en, ln(p / (1 - p)) AS logit FROM rates)
       SELECT round(max(logit) FILTER (NOT is_en), 4) AS intercept,
              round(max(logit) FILTER (is_en) - max(logit) FILTER (NOT is_en), 4) AS coefficient
       FROM logits"""
)
def train_logistic_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one 0/1 feature the fit is the log odds of either group."""
    job = {
        "appName": "quality",
        "algoClass": "LogisticRegression",
        "sourceParameter": {"source": sf_dir, "type": "parquet"},
        "dataParameter": {"label": "quality", "features": ["CASE WHEN lang = 'en' THEN 1 ELSE 0 END"]},
        "algoParameter": {"tol": 1e-12, "maxIter": 200},
    }
    model = run_train(spark, job, DocumentQuality(find_estimator("LogisticRegression"))).model
    fitted = [(float(model.intercept), float(model.coefficients[0]))]
    params = spark.createDataFrame(fitted, "intercept double, coefficient double")
    return params.select(*[F.round(c, 4).alias(c) for c in params.columns])


@query(
    """WITH rows AS (SELECT quality, n_chars FROM documents JOIN labels USING (doc_id)),
       ranked AS (
         SELECT quality = 1 AS positive,
                rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS mid_rank
         FROM rows),
       area AS (
         SELECT (sum(mid_rank) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0)
                / (count(*) FILTER (positive) * CAST(count(*) FILTER (NOT positive) AS DOUBLE)) AS a
         FROM ranked)
       SELECT (SELECT count(*) FROM rows) AS n,
              round(CASE WHEN (SELECT covar_pop(quality, n_chars) FROM rows) > 0 THEN a ELSE 1 - a END, 6)
                AS area_under_roc
       FROM area"""
)
def train_logistic_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one feature the scores rank documents as the feature does, or in reverse."""
    job = {
        "appName": "quality",
        "algoClass": "LogisticRegression",
        "sourceParameter": {"source": sf_dir, "type": "parquet"},
        "dataParameter": {"label": "quality", "features": ["n_chars"]},
        "algoParameter": {"areaUnderROC": True},
    }
    metrics = run_train(spark, job, DocumentQuality(find_estimator("LogisticRegression"))).metrics
    return metrics.select("n", F.round("area_under_roc", 6).alias("area_under_roc"))


@query(
    """WITH bins AS (SELECT l_quantity AS x, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
       cuts AS (
         SELECT a.x AS cut, sum(b.n) FILTER (b.x <= a.x) AS nl, sum(b.s) FILTER (b.x <= a.x) AS sl,
                sum(b.n) FILTER (b.x > a.x) AS nr, sum(b.s) FILTER (b.x > a.x) AS sr
         FROM bins a, bins b GROUP BY a.x),
       best AS (SELECT * FROM cuts WHERE nr IS NOT NULL ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)
       SELECT CAST(nl AS BIGINT) AS n, round(sl / nl, 4) AS prediction FROM best
       UNION ALL SELECT CAST(nr AS BIGINT), round(sr / nr, 4) FROM best"""
)
def train_tree_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression tree of one split: the best cut and the mean on either side."""
    data = {"label": "l_extendedprice", "features": ["l_quantity"]}
    job = {
        "appName": "prices",
        "algoClass": "DecisionTreeRegressor",
        "sourceParameter": parquet_source(sf_dir, "lineitem"),
        "dataParameter": data,
        "algoParameter": {"maxDepth": 1, "maxBins": 64, "seed": 1},
    }
    model = run_train(spark, job).model
    rows = apply_data_spec(table(spark, sf_dir, "lineitem"), DataSpec.parse(data), with_label=False)
    leaves = model.transform(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    return leaves.select("n", F.round("prediction", 4).alias("prediction"))


EMBEDDINGS = {"label": "label", "features": ["embedding"], "keep": ["vec_id"]}


@query("SELECT count(*) AS n, count(*) AS n_agree FROM embeddings")
def train_tree_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved and reloaded decision tree agrees with itself on every row."""
    path = fresh_path(spark, "tree")
    job = {
        "appName": "vectors",
        "algoClass": "DecisionTreeClassifier",
        "sourceParameter": parquet_source(sf_dir, "embeddings"),
        "dataParameter": EMBEDDINGS,
        "algoParameter": {"maxDepth": 5, "seed": 1},
        "dataWeight": [0.8, 0.2],
        "splitKey": "vec_id",
        "modelSavePath": path,
    }
    model = run_train(spark, job).model
    rows = apply_data_spec(table(spark, sf_dir, "embeddings"), DataSpec.parse(EMBEDDINGS))
    first = model.transform(rows).select("features", F.col("prediction").alias("first"))
    both = load_ml_model(spark, path).transform(first)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") == F.col("prediction")).alias("n_agree"))


@query(
    """SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_unscored, TRUE AS beats_mean FROM (
         SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""
)
def train_als_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recommender verified on what it was trained on explains part of it."""
    from .common import OrderRatings

    metrics = run_train(spark, als_job(sf_dir), OrderRatings(find_estimator("ALS"))).metrics
    return metrics.select("n", "n_unscored", (F.col("r2") > 0).alias("beats_mean"))
