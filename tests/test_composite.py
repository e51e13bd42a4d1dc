"""Models made of stages: loading, refusing, scoring."""

from __future__ import annotations

import json

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from trainscore import run_batch, run_stream
from trainscore.operators.isolate import answered_apart
from trainscore.operators.scorers import MLScorer, load_ml_model
from trainscore.plugins import RESPONSE_SCHEMA


@pytest.fixture(scope="module")
def rows(spark):
    kind = F.when(F.col("id") % 2 == 0, "even").otherwise("odd")
    return spark.range(200).select("id", kind.alias("kind"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 3.0 + (F.col("id") % 2) * 10).alias("label")).persist()


@pytest.fixture(scope="module")
def stages():
    return [StringIndexer(inputCol="kind", outputCol="k"), VectorAssembler(inputCols=["x", "k"], outputCol="features"), LinearRegression(solver="normal")]


@pytest.fixture(scope="module")
def pipeline_path(rows, stages, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('pipeline')}/m"
    Pipeline(stages=stages).fit(rows).save(path)
    return path


def tuned(rows, stages, path, kind):
    evaluator, line = RegressionEvaluator(), stages[-1]
    grid = ParamGridBuilder().addGrid(line.regParam, [0.0, 100.0]).build()
    kind(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=evaluator, seed=1).fit(rows).save(path)


@pytest.mark.parametrize("kind", [CrossValidator, TrainValidationSplit])
def test_tuned_pipelines_score(spark, rows, stages, tmp_path, kind):
    tuned(rows, stages, f"{tmp_path}/m", kind)
    rows.write.parquet(f"{tmp_path}/rows")
    job = {
        "appName": "t",
        "modelClass": "ml",
        "modelPath": f"{tmp_path}/m",
        "sourceParameter": {"source": f"{tmp_path}/rows", "type": "parquet"},
        "dataParameter": {"keep": ["id", "kind", "x"]},
        "resultSavePath": f"{tmp_path}/scores",
    }
    got = run_batch(spark, job)
    assert got.columns == ["id", "kind", "x", "k", "prediction"]
    assert got.where("abs(prediction - (id * 3 + (id % 2) * 10)) < 0.001").count() == 200


def test_requests_go_through_the_stages(spark, pipeline_path, tmp_path):
    scorer = MLScorer({"schema": "kind string, n int", "columns": {"x": "n * 1.0"}})
    scorer.load_model(spark, pipeline_path)
    assert scorer.runs_jobs
    asked = [{"kind": "odd", "n": 3}, {"kind": "even", "n": 4}, {"kind": "new", "n": 4}, {"kind": "odd"}]
    data = [*map(json.dumps, asked), "not json", None]
    requests = spark.createDataFrame(list(enumerate(data)), "request_id long, data string").persist()
    got = {r.request_id: r.result for r in answered_apart(scorer, requests).collect()}
    assert abs(json.loads(got[0])["prediction"] - 19) < 1e-3 and abs(json.loads(got[1])["prediction"] - 12) < 1e-3
    assert all(got[i].startswith("Exception:") for i in (2, 3)) and got[4] == got[5] == "Exception:malformed request"

    folder = tmp_path / "requests"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"request_id": i, "data": d}) for i, d in enumerate(data[:3])))
    job = {
        "appName": "stages",
        "modelClass": "ml",
        "modelPath": pipeline_path,
        "requestPath": str(folder),
        "responsePath": f"{tmp_path}/responses",
        "checkpointPath": f"{tmp_path}/checkpoint",
        "modelParameter": scorer.parameter,
    }
    run_stream(spark, job)
    streamed = {r.request_id: r.result for r in spark.read.schema(RESPONSE_SCHEMA).parquet(f"{tmp_path}/responses").collect()}
    assert streamed == {i: got[i] for i in range(3)}


def test_features_made_outside_the_pipeline(spark, rows, tmp_path):
    given = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    Pipeline(stages=[LinearRegression(solver="normal")]).fit(given).save(f"{tmp_path}/m")
    scorer = MLScorer({"schema": "x double", "features": ["x"]})
    scorer.load_model(spark, f"{tmp_path}/m")
    requests = spark.createDataFrame([(1, '{"x": 2}'), (2, '{"x": null}'), (3, '{"x": "a"}')], "request_id long, data string")
    got = {r.request_id: r.result for r in answered_apart(scorer, requests).collect()}
    assert "prediction" in got[1] and got[2] == "Exception:missing or non-numeric feature" and got[3] == "Exception:malformed request"


def renamed(path, name):
    """Give the first metadata below a folder another class."""
    file = next(f for f in sorted(path.rglob("metadata/part-*")) if not f.name.endswith(".crc"))
    meta = json.loads(file.read_text())
    meta["class"] = name
    file.write_text(json.dumps(meta))
    for crc in file.parent.glob(".*.crc"):
        crc.write_bytes(b"")
        crc.unlink()


@pytest.mark.parametrize("inside", ["stages", "bestModel/stages", "model_1"])
def test_a_foreign_class_inside_is_refused_before_loading(spark, rows, stages, tmp_path, inside):
    path = f"{tmp_path}/m"
    if inside == "stages":
        Pipeline(stages=stages).fit(rows).save(path)
    elif inside == "model_1":
        three = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.withColumn("label", F.col("id") % 3))
        OneVsRest(classifier=LogisticRegression(maxIter=2)).fit(three.select("features", F.col("label").cast("double"))).save(path)
    else:
        tuned(rows, stages, path, TrainValidationSplit)
    assert load_ml_model(spark, path) is not None
    renamed(tmp_path / "m" / inside, "tests.unknown_module.Stage")
    with pytest.raises(ValueError, match="tests.unknown_module.Stage"):
        load_ml_model(spark, path)


@pytest.mark.parametrize("name", ["os.system", "pyspark.ml.pipelines.Evil", "org.apache.spark.mllib.X", "pyspark.ml.feature.Binarizer", "pyspark.ml.tuning.CrossValidator"])
def test_a_foreign_class_outside_is_refused(spark, rows, stages, tmp_path, name):
    Pipeline(stages=stages[:1]).fit(rows).save(f"{tmp_path}/m")
    renamed(tmp_path / "m" / "metadata" / "..", name)
    with pytest.raises(ValueError, match="Refusing"):
        load_ml_model(spark, f"{tmp_path}/m")
