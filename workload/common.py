"""Settings and SQL fragments shared by the queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscore.functions import apply_data_spec
from trainscore.operators.estimators import MLAlgorithm
from trainscore.spec import DataSpec, SourceSpec


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def parquet_source(sf_dir: str, name: str) -> dict[str, str]:
    return {"source": table_path(sf_dir, name), "type": "parquet"}


def linear_job(sf_dir: str, **more: Any) -> dict[str, Any]:
    """Regression of an event's value on the k of its properties."""
    return {
        "appName": "events",
        "algoClass": "pyspark.ml.regression.LinearRegression",
        "sourceParameter": parquet_source(sf_dir, "events"),
        "dataParameter": {
            "columns": {"k": "get_json_object(props, '$.k')"},
            "label": "value",
            "features": ["k"],
            "keep": ["event_id"],
        },
        "algoParameter": {"solver": "normal"},
        "dataWeight": [0.7, 0.3],
        "splitKey": "event_id",
        **more,
    }


SCORE_EVENTS = {
    "columns": {"k": "get_json_object(props, '$.k')"},
    "features": ["k"],
    "keep": ["event_id"],
}

# Position of an event in [0, 2^32), as the keyed split computes it.
EVENT_BITS = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT)"
ORDER_BITS = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)"

# The linear fit on the training part of the events.
LINEAR_FIT = f"""
  pts AS (SELECT event_id, event_type, value AS y, CAST(props->>'k' AS DOUBLE) AS x,
                 {EVENT_BITS} < 0.7 * 4294967296.0 AS in_train
          FROM events),
  fit AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pts WHERE in_train)
"""


class OrderRatings(MLAlgorithm):
    """A recommender whose loader joins the order of each line to it.

    One order or part may hold a large share of the lines: the join is left to
    adaptive execution, which splits such a partition, and parsing sums repeated
    (user, item) pairs before they are shuffled.
    """

    def load(self, spark: SparkSession, source: SourceSpec) -> DataFrame:
        return order_lines(spark, source.source)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


RATINGS = {"ratings": {"user": "o_custkey", "item": "l_partkey", "rating": "l_quantity", "aggregate": True}}


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_data_spec(order_lines(spark, sf_dir), DataSpec.parse(RATINGS))


def als_job(sf_dir: str, **more: Any) -> dict[str, Any]:
    return {
        "appName": "orders",
        "algoClass": "pyspark.ml.recommendation.ALS",
        "sourceParameter": {"source": sf_dir, "type": "parquet"},
        "dataParameter": RATINGS,
        "algoParameter": {"rank": 8, "maxIter": 5, "regParam": 0.1, "seed": 7},
        # Two shuffles stand behind the ratings: keep them between fit and verify.
        "persist": True,
        **more,
    }
