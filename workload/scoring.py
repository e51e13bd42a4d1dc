"""Scoring tables and request streams."""

from __future__ import annotations

from pathlib import Path

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscore import run_batch, run_stream, run_train
from trainscore.operators.estimators import find_estimator
from trainscore.operators.topn import top_items
from trainscore.plugins import RESPONSE_SCHEMA
from trainscore.storage import fresh_path

from . import query
from .common import LINEAR_FIT, SCORE_EVENTS, OrderRatings, als_job, linear_job, parquet_source, table

SEGMENTS = str(Path(__file__).resolve().parent.parent / "examples" / "segments_plugin.py")
PLUGIN = str(Path(__file__).resolve().parent.parent / "examples" / "deviation_plugin.py")

# Micro-batches follow from the number of request files, which is chosen by size.
FILES_PER_BATCH = 64

SCORES = f"WITH {LINEAR_FIT} SELECT event_id, round(intercept + slope * x, 4) AS prediction FROM pts, fit"


def _linear_model(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "linear")
    run_train(spark, linear_job(sf_dir, modelSavePath=path))
    return path


def _score_events(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    job = {
        "appName": "score-events",
        "modelClass": "ml",
        "modelPath": _linear_model(spark, sf_dir),
        "sourceParameter": parquet_source(sf_dir, "events"),
        "dataParameter": SCORE_EVENTS,
        "resultSavePath": fresh_path(spark, "scores"),
        "resultFormat": fmt,
    }
    return run_batch(spark, job).select("event_id", F.round("prediction", 4).alias("prediction"))


@query(SCORES)
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load the saved model, score every event, save, read the result."""
    return _score_events(spark, sf_dir, "parquet")


@query(SCORES)
def score_batch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_events(spark, sf_dir, "json")


@query(SCORES)
def score_batch_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_events(spark, sf_dir, "csv")


@query(
    f"""WITH {LINEAR_FIT}
        SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 <> 1 THEN ' ' || text || chr(13) || chr(10) END AS note,
               round(intercept + slope * n_chars, 4) AS prediction FROM documents, fit"""
)
def score_batch_text_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with line breaks, empty text and nulls come back from a CSV result as they were."""
    note = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 <> 1 THEN ' ' || text || char(13) || char(10) END"
    job = {
        "appName": "score-documents",
        "modelClass": "ml",
        "modelPath": _linear_model(spark, sf_dir),
        "sourceParameter": parquet_source(sf_dir, "documents"),
        "dataParameter": {"columns": {"note": note}, "features": ["n_chars"], "keep": ["doc_id", "text", "note"]},
        "resultSavePath": fresh_path(spark, "scores"),
        "resultFormat": "csv",
    }
    return run_batch(spark, job).select("doc_id", "text", "note", F.round("prediction", 4).alias("prediction"))


def _deviation_model(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "deviation")
    job = {
        "appName": "deviation",
        "algoPluginPath": PLUGIN,
        "algoClass": "deviation_plugin.DeviationAlgorithm",
        "algoParameterClass": "deviation_plugin.DeviationParameter",
        "sourceParameter": parquet_source(sf_dir, "events"),
        "dataParameter": {"keep": ["value"]},
        "algoParameter": {"population": True},
        "modelSavePath": path,
    }
    run_train(spark, job)
    return path


@query(
    f"""WITH {LINEAR_FIT}
        SELECT event_id AS request_id,
               CASE WHEN event_type IN ('error', 'signup', 'view')
                    THEN 'Exception:missing or non-numeric feature' ELSE 'answered' END AS status,
               CASE WHEN event_type IN ('click', 'purchase') THEN round(intercept + slope * x, 4) END AS prediction
        FROM pts, fit"""
)
def score_stream_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts that fail, NaN and numbers beyond all bounds are answered; the stream goes on."""
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_type") == "error", F.lit("abc"))
        .when(F.col("event_type") == "signup", F.lit("NaN"))
        .when(F.col("event_type") == "view", F.lit("1e400"))
        .otherwise(k)
    )
    requests = _write_requests(table(spark, sf_dir, "events"), "event_id", F.to_json(F.struct(text.alias("s"))))
    request = {"schema": "s string", "columns": {"k": "cast(s as double)"}, "features": ["k"]}
    responses = _stream(spark, requests, "ml", _linear_model(spark, sf_dir), modelParameter=request)
    failed = F.col("result").startswith("Exception:")
    prediction = F.get_json_object(F.when(~failed, F.col("result")), "$.prediction").cast("double")
    return responses.select(
        "request_id",
        F.when(failed, F.col("result")).otherwise("answered").alias("status"),
        F.round(prediction, 4).alias("prediction"),
    )


@query(
    """WITH pts AS (SELECT event_id, event_type, value AS y, CAST(props->>'k' AS DOUBLE) AS x FROM events),
       fit AS (SELECT event_type, avg(y) AS mean FROM pts GROUP BY event_type)
       SELECT event_id, round(mean, 4) AS prediction FROM pts JOIN fit USING (event_type)"""
)
def score_pipeline_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved pipeline of a label index, an encoding, an assembly and a regression scores raw columns."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("label"))
    stages = [
        StringIndexer(inputCol="event_type", outputCol="index"),
        OneHotEncoder(inputCol="index", outputCol="features", dropLast=False),
        LinearRegression(solver="normal", fitIntercept=False),
    ]
    path = fresh_path(spark, "pipeline")
    Pipeline(stages=stages).fit(events).save(path)
    job = {
        "appName": "score-stages",
        "modelClass": "ml",
        "modelPath": path,
        "sourceParameter": parquet_source(sf_dir, "events"),
        "dataParameter": {"keep": ["event_id", "event_type"]},
        "resultSavePath": fresh_path(spark, "scores"),
    }
    return run_batch(spark, job).select("event_id", F.round("prediction", 4).alias("prediction"))


@query(
    f"""WITH {LINEAR_FIT} SELECT event_id AS request_id, round(intercept + slope * x, 4) AS prediction FROM pts, fit"""
)
def score_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests from a data source of one's own, a model trained on rows of the same source."""
    events = table(spark, sf_dir, "events")
    model = fresh_path(spark, "linear")
    job = linear_job(sf_dir, modelSavePath=model, algoPluginPath=SEGMENTS)
    fields = F.to_json(F.struct("props", "value"))
    job["sourceParameter"] = {"source": write_segments(events, "event_id", fields), "type": "plugin", "inputFormat": "segments_plugin.Segments"}
    job["dataParameter"] = {
        "columns": {
            "event_id": "request_id",
            "value": "cast(get_json_object(data, '$.value') as double)",
            "k": "get_json_object(get_json_object(data, '$.props'), '$.k')",
        },
        "label": "value", "features": ["k"], "keep": ["event_id"],
    }
    run_train(spark, job)
    requests = write_segments(events, "event_id", F.col("props"))
    more = {"requestFormat": "segments_plugin.Segments", "algoPluginPath": SEGMENTS}
    responses = _stream(spark, requests, "ml", model, modelParameter=K_REQUEST, **more)
    prediction = F.get_json_object("result", "$.prediction").cast("double")
    return responses.select("request_id", F.round(prediction, 4).alias("prediction"))


@query(
    f"""WITH {LINEAR_FIT}
        SELECT event_id AS request_id,
               CASE event_type WHEN 'signup' THEN 'INVALID_INDEX_OF_ZERO' WHEN 'error' THEN 'ARITHMETIC_OVERFLOW'
                    WHEN 'purchase' THEN 'USER_RAISED_EXCEPTION' WHEN 'click' THEN 'PatternSyntaxException' ELSE 'answered' END AS status,
               CASE WHEN event_type = 'view' THEN round(intercept + slope * x, 4) END AS prediction
        FROM pts, fit"""
)
def score_stream_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that make the plan raise, in four ways, are answered with that; all others as usual."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    fields = [
        F.when(kind == "signup", 0).otherwise(1).alias("i"),
        F.when(kind == "error", F.lit(2**62)).when(kind == "view", k).otherwise(F.lit(0)).alias("k"),
        F.when(kind == "click", "a(").otherwise(".*").alias("p"),
        (kind == "purchase").alias("refuse"),
    ]
    requests = _write_requests(table(spark, sf_dir, "events"), "event_id", F.to_json(F.struct(*fields)))
    request = {
        "schema": "i int, k bigint, p string, refuse boolean",
        "columns": {
            "x": "element_at(array(k * 4), i) div 4",
            "y": "if(refuse, raise_error('refused'), if('text' rlike p, x, 0))",
        },
        "features": ["y"],
    }
    responses = _stream(spark, requests, "ml", _linear_model(spark, sf_dir), modelParameter=request)
    failed = F.col("result").startswith("Exception:")
    prediction = F.get_json_object(F.when(~failed, F.col("result")), "$.prediction").cast("double")
    reason = F.regexp_extract("result", r"^Exception:\[?([A-Za-z_]+)", 1)
    return responses.select(
        "request_id", F.when(failed, reason).otherwise("answered").alias("status"), F.round(prediction, 4).alias("prediction")
    )


@query(
    """WITH s AS (SELECT avg(value) AS mean, stddev_pop(value) AS deviation FROM events)
       SELECT event_id, round((value - mean) / deviation, 6) AS deviation FROM events, s"""
)
def score_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin file with its own model, trained and applied without MLlib."""
    job = {
        "appName": "score-deviation",
        "algoPluginPath": PLUGIN,
        "modelClass": "deviation_plugin.DeviationScorer",
        "modelPath": _deviation_model(spark, sf_dir),
        "sourceParameter": parquet_source(sf_dir, "events"),
        "dataParameter": {"keep": ["event_id", "value"]},
        "resultSavePath": fresh_path(spark, "scores"),
    }
    return run_batch(spark, job).select("event_id", F.round("deviation", 6).alias("deviation"))


def _write_requests(rows: DataFrame, request_id: str, data: Column) -> str:
    path = fresh_path(rows.sparkSession, "requests")
    rows.select(F.col(request_id).cast("bigint").alias("request_id"), data.alias("data")).write.json(path)
    return path


def write_segments(rows: DataFrame, request_id: str, data: Column) -> str:
    path = fresh_path(rows.sparkSession, "segments")
    rows.repartition(6, request_id).select(F.concat_ws("\t", F.col(request_id), data)).write.text(path)
    return path


def _stream(spark: SparkSession, requests: str, model_class: str, model_path: str, **more) -> DataFrame:
    """Answer all request files and return the responses."""
    responses = fresh_path(spark, "responses")
    job = {
        "appName": "score-requests",
        "modelClass": model_class,
        "modelPath": model_path,
        "requestPath": requests,
        "responsePath": responses,
        "checkpointPath": fresh_path(spark, "checkpoint"),
        "maxFilesPerTrigger": FILES_PER_BATCH,
        **more,
    }
    run_stream(spark, job)
    return spark.read.schema(RESPONSE_SCHEMA).parquet(responses)


K_REQUEST = {"schema": "k double", "features": ["k"]}


@query(
    f"""WITH {LINEAR_FIT} SELECT event_id AS request_id, round(intercept + slope * x, 4) AS prediction FROM pts, fit"""
)
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of every event as a request."""
    requests = _write_requests(table(spark, sf_dir, "events"), "event_id", F.col("props"))
    model = _linear_model(spark, sf_dir)
    responses = _stream(spark, requests, "ml", model, modelParameter=K_REQUEST)
    prediction = F.get_json_object("result", "$.prediction").cast("double")
    return responses.select("request_id", F.round(prediction, 4).alias("prediction"))


@query(
    f"""WITH {LINEAR_FIT}
        SELECT event_id AS request_id,
               CASE event_type WHEN 'error' THEN 'Exception:malformed request'
                               WHEN 'signup' THEN 'Exception:missing or non-numeric feature'
                               WHEN 'view' THEN 'Exception:expected 1 features, got 2'
                               ELSE 'answered' END AS status,
               CASE WHEN event_type IN ('click', 'purchase') THEN round(intercept + slope * x, 4) END AS prediction
        FROM pts, fit"""
)
def score_stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad requests of three kinds, by event type, each answered by its reason."""
    k = F.get_json_object("props", "$.k")
    data = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("not json "), "props"))
        .when(F.col("event_type") == "signup", F.lit('{"data":[null]}'))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"data":['), k, F.lit(",1]}")))
        .otherwise(F.concat(F.lit('{"data":['), k, F.lit("]}")))
    )
    requests = _write_requests(table(spark, sf_dir, "events"), "event_id", data)
    responses = _stream(spark, requests, "ml", _linear_model(spark, sf_dir), threadParallel=1)
    failed = F.col("result").startswith("Exception:")
    prediction = F.get_json_object(F.when(~failed, F.col("result")), "$.prediction").cast("double")
    return responses.select(
        "request_id",
        F.when(failed, F.col("result")).otherwise("answered").alias("status"),
        F.round(prediction, 4).alias("prediction"),
    )


@query(
    """WITH s AS (SELECT avg(value) AS mean, stddev_pop(value) AS deviation FROM events)
       SELECT event_id AS request_id,
              CASE event_type WHEN 'error' THEN 'Exception:malformed request'
                              WHEN 'signup' THEN 'Exception:value is missing'
                              ELSE 'answered' END AS status,
              CASE WHEN event_type NOT IN ('error', 'signup') THEN round((value - mean) / deviation, 6) END AS deviation
       FROM events, s"""
)
def score_stream_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin model on a stream: what it raises for one request answers that request."""
    value = F.to_json(F.struct("value"))
    data = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("<"), value))
        .when(F.col("event_type") == "signup", F.lit("{}"))
        .otherwise(value)
    )
    requests = _write_requests(table(spark, sf_dir, "events"), "event_id", data)
    model = _deviation_model(spark, sf_dir)
    responses = _stream(spark, requests, "deviation_plugin.DeviationScorer", model, algoPluginPath=PLUGIN)
    failed = F.col("result").startswith("Exception:")
    deviation = F.get_json_object(F.when(~failed, F.col("result")), "$.deviation").cast("double")
    return responses.select(
        "request_id",
        F.when(failed, F.col("result")).otherwise("answered").alias("status"),
        F.round(deviation, 6).alias("deviation"),
    )


def _als_model(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "als")
    run_train(spark, als_job(sf_dir, modelSavePath=path), OrderRatings(find_estimator("ALS")))
    return path


@query(
    """WITH buyers AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
       SELECT CAST(o.o_custkey AS INTEGER) AS "user", count(*) AS n_orders,
              CASE WHEN b.o_custkey IS NOT NULL THEN CAST(3 AS INTEGER) END AS n_items
       FROM orders o LEFT JOIN buyers b ON o.o_custkey = b.o_custkey
       GROUP BY o.o_custkey, b.o_custkey"""
)
def train_als_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order gets the three items its customer should like best."""
    job = {
        "appName": "recommend",
        "modelClass": "recommend",
        "modelPath": _als_model(spark, sf_dir),
        "modelParameter": {"numItems": 3},
        "sourceParameter": parquet_source(sf_dir, "orders"),
        "dataParameter": {"columns": {"user": "cast(o_custkey as int)"}, "keep": ["o_orderkey", "user"]},
        "resultSavePath": fresh_path(spark, "recommendations"),
    }
    items = F.size(F.array_distinct("recommendations.item"))
    return run_batch(spark, job).groupBy("user").agg(
        F.count(F.lit(1)).alias("n_orders"), F.min(F.when(F.col("recommendations").isNotNull(), items)).alias("n_items")
    )


@query(
    """WITH buyers AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
       SELECT c_custkey AS request_id,
              CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Exception:malformed request'
                   WHEN c_mktsegment = 'BUILDING' THEN 'Exception:missing user'
                   WHEN o_custkey IS NULL THEN 'Exception:unknown user ' || c_custkey
                   ELSE 'answered' END AS status,
              CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND o_custkey IS NOT NULL
                   THEN CAST(3 AS INTEGER) END AS n_items
       FROM customer LEFT JOIN buyers ON c_custkey = o_custkey"""
)
def recommend_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for recommendations; those who never bought are unknown."""
    data = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("not json"))
        .when(F.col("c_mktsegment") == "BUILDING", F.lit("{}"))
        .otherwise(F.to_json(F.struct(F.col("c_custkey").alias("user"))))
    )
    requests = _write_requests(table(spark, sf_dir, "customer"), "c_custkey", data)
    responses = _stream(
        spark, requests, "recommend", _als_model(spark, sf_dir), modelParameter={"numItems": 3}
    )
    failed = F.col("result").startswith("Exception:")
    lists = F.from_json(F.when(~failed, F.col("result")), "recommendations array<struct<item:int,rating:float>>")
    return responses.select(
        "request_id",
        F.when(failed, F.col("result")).otherwise("answered").alias("status"),
        F.when(~failed, F.size(lists["recommendations"])).alias("n_items"),
    )


@query(
    """SELECT CAST(u.vec_id AS INTEGER) AS "user", CAST(i.vec_id AS INTEGER) AS item,
              CAST(row_number() OVER (PARTITION BY u.vec_id ORDER BY list_inner_product(u.embedding, i.embedding) DESC, i.vec_id) AS INTEGER) AS rank
       FROM embeddings u, embeddings i QUALIFY rank <= 3"""
)
def topn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best items of each user, vectors being both, over many packs of items."""
    factors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("features"))
    lists = top_items(factors, factors, 3, factors.count(), items_per_pack=64)
    best = lists.select("user", F.posexplode("recommendations").alias("place", "best"))
    return best.select("user", F.col("best.item").alias("item"), (F.col("place") + 1).alias("rank"))
