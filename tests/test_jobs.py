"""Train, batch and streaming jobs end to end on small tables."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from trainscore import run_batch, run_stream, run_train, start_stream
from trainscore.__main__ import JOBS, main
from trainscore.operators import estimators
from trainscore.operators.estimators import MLAlgorithm, als_blocks, factor_blocks, find_estimator, size_als
from trainscore.operators.scorers import MLScorer, PandasScorer, RecommendScorer, load_ml_model
from trainscore.plugins import (
    Algorithm,
    read_parameter,
    register_algorithm,
    register_scorer,
    resolve_algorithm,
    resolve_scorer,
)
from trainscore.storage import shared_root

ROOT = Path(__file__).resolve().parent.parent
EXAMPLE = str(ROOT / "examples" / "deviation_plugin.py")


@pytest.fixture(scope="module")
def line(spark, tmp_path_factory):
    """y = 3x + 1 on 200 rows, as Parquet."""
    path = str(tmp_path_factory.mktemp("line") / "t")
    spark.range(200).selectExpr("id", "cast(id as double) as x", "3.0 * id + 1 as y").write.parquet(path)
    return path


def train_job(path, **more):
    return {
        "appName": "t",
        "algoClass": "LinearRegression",
        "sourceParameter": {"source": path, "type": "parquet"},
        "dataParameter": {"features": ["x"], "label": "y", "keep": ["id"]},
        "algoParameter": {},
        **more,
    }


@pytest.fixture(scope="module")
def model_path(spark, line, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "m")
    run_train(spark, train_job(line, modelSavePath=path))
    return path


def write_requests(spark, path, requests):
    spark.createDataFrame(requests, "request_id bigint, data string").coalesce(1).write.mode("append").json(path)


def stream_job(base, model, **more):
    return {
        "appName": "s",
        "modelClass": "ml",
        "modelPath": model,
        "requestPath": f"{base}/in",
        "responsePath": f"{base}/out",
        "checkpointPath": f"{base}/ck",
        **more,
    }


def responses(spark, base):
    rows = spark.read.parquet(f"{base}/out").collect()
    assert len({r.request_id for r in rows}) == len(rows)
    return {r.request_id: r.result for r in rows}


def staged(spark):
    return {p.name for p in Path(shared_root(spark).removeprefix("file:")).glob("split-*")}


# -- train -------------------------------------------------------------------


@pytest.mark.parametrize("more", [{}, {"dataWeight": [0.7, 0.3]}, {"dataWeight": [0.7, 0.3], "splitKey": ["id"]}])
@pytest.mark.parametrize("persist", [False, True])
def test_train(spark, line, more, persist):
    before = staged(spark)
    result = run_train(spark, train_job(line, persist=persist, **more))
    assert result.model.coefficients[0] == pytest.approx(3.0, abs=1e-6)
    metrics = result.metrics.first()
    assert metrics.r2 == pytest.approx(1.0)
    assert metrics.n == 200 if not more else 0 < metrics.n < 200
    assert staged(spark) == before


def test_train_from_json_text(spark, line):
    job = train_job(line, dataWeight='{"dataWeight": [0.5, 0.3]}')
    job["sourceParameter"] = json.dumps(job["sourceParameter"])
    job["dataParameter"] = json.dumps(job["dataParameter"])
    job["algoParameter"] = '{"maxIter": 5}'
    assert run_train(spark, json.dumps(job)).model.getMaxIter() == 5


def test_saved_model_and_indicator(spark, line, tmp_path):
    model, indicator = f"{tmp_path}/m", f"{tmp_path}/i"
    job = train_job(line, modelSavePath=model, modelIndicatorSavePath=indicator)
    run_train(spark, job)
    assert load_ml_model(spark, model).intercept == pytest.approx(1.0, abs=1e-5)
    assert spark.read.json(indicator).first().n == 200
    with pytest.raises(Exception, match="already exists"):
        run_train(spark, job)
    run_train(spark, {**job, "overwriteModel": True})


def test_unknown_algorithm_parameter(spark, line):
    with pytest.raises(ValueError, match="Unknown parameter of LinearRegression: depth; valid are .*maxIter"):
        run_train(spark, train_job(line, algoParameter={"depth": 3}))


def test_missing_column_fails_at_analysis(spark, line):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        run_train(spark, train_job(line, dataParameter={"features": ["nope"], "label": "y"}))


@pytest.mark.parametrize(
    "name, params, metric",
    [
        ("DecisionTreeRegressor", {"maxDepth": 3}, "r2"),
        ("GeneralizedLinearRegression", {"family": "gaussian"}, "r2"),
        ("IsotonicRegression", {}, "r2"),
        ("LogisticRegression", {}, "accuracy"),
        ("RandomForestClassifier", {"numTrees": 3, "seed": 1}, "accuracy"),
        ("LinearSVC", {"maxIter": 5}, "accuracy"),
        ("OneVsRest", {"classifier": {"algoClass": "LinearSVC", "algoParameter": {"maxIter": 5}}}, "accuracy"),
        ("MultilayerPerceptronClassifier", {"layers": [1, 2], "seed": 1}, "accuracy"),
        ("KMeans", {"k": 2, "seed": 1}, "silhouette"),
        ("BisectingKMeans", {"k": 2, "seed": 1}, "silhouette"),
        ("GaussianMixture", {"k": 2, "seed": 1}, "silhouette"),
    ],
)
def test_any_estimator_trains_saves_and_scores(spark, line, tmp_path, name, params, metric):
    label = "y" if "egress" in name and name != "LogisticRegression" else "case when x >= 100 then 1 else 0 end"
    data = {"features": ["x"], "label": label}
    model = f"{tmp_path}/m"
    job = train_job(line, algoClass=name, algoParameter=params, dataParameter=data, modelSavePath=model)
    result = run_train(spark, job)
    assert result.metrics.first()[metric] > 0.5
    scored = run_batch(
        spark,
        {
            "appName": "b",
            "modelClass": "ml",
            "modelPath": model,
            "sourceParameter": {"source": line, "type": "parquet"},
            "dataParameter": {"features": ["x"], "keep": ["id"]},
            "resultSavePath": f"{tmp_path}/r",
        },
    )
    assert scored.columns == ["id", "prediction"] and scored.count() == 200


def test_split_without_key_stages_only_where_rows_have_no_place(spark, line, tmp_path, monkeypatch):
    from trainscore.plans import jobs

    staged_splits = []
    monkeypatch.setattr(jobs, "drop_sides", lambda split: staged_splits.append(split.staged))
    run_train(spark, train_job(line, dataWeight=[0.7, 0.3]))
    spark.read.parquet(line).write.option("header", "true").csv(f"{tmp_path}/c")
    csv = {"source": f"{tmp_path}/c", "type": "csv"}
    result = run_train(spark, train_job(line, dataWeight=[0.7, 0.3], sourceParameter=csv))
    assert result.metrics.first().r2 == pytest.approx(1.0)
    assert staged_splits[0] is None and staged_splits[1] is not None


def test_roc_is_asked_for(spark, line):
    data = {"features": ["x"], "label": "case when x >= 100 then 1 else 0 end"}
    job = train_job(line, algoClass="LogisticRegression", dataParameter=data)
    assert "area_under_roc" not in run_train(spark, job).metrics.columns
    metrics = run_train(spark, {**job, "algoParameter": {"areaUnderROC": True, "maxIter": 3}}).metrics.first()
    assert metrics.area_under_roc == 1.0
    with pytest.raises(ValueError, match="needs a classifier"):
        run_train(spark, train_job(line, algoParameter={"areaUnderROC": True}))


def test_topic_model(spark, line, tmp_path):
    model = f"{tmp_path}/m"
    data = {"features": ["x", "1"]}
    job = train_job(
        line, algoClass="LDA", algoParameter={"k": 2, "maxIter": 2, "seed": 1}, dataParameter=data, modelSavePath=model
    )
    assert run_train(spark, job).metrics.columns == ["n", "log_likelihood", "log_perplexity"]
    scorer = MLScorer({"schema": "data array<double>", "features": "data", "outputs": ["topicDistribution"]})
    scorer.load_model(spark, model)
    assert sum(json.loads(scorer.answer(spark, '{"data":[1,2]}'))["topicDistribution"]) == pytest.approx(1.0)
    assert scorer.answer(spark, '{"data":[1]}') == "Exception:expected 2 features, got 1"


class TextAlgorithm(Algorithm):
    """Everything a plugin may do itself: loader, model with save, textual indicator."""

    name = "text"

    def load(self, spark, source):
        return spark.range(4).withColumn("origin", F.lit(source.source))

    def parse(self, raw, data, source_type):
        assert source_type == "WHOLE"
        return raw.where(F.col("id") >= data.values["least"])

    def train(self, rows, params):
        count = rows.count()

        class Counted:
            def save(self, spark, path):
                spark.createDataFrame([(count,)], "n int").write.json(path)

        return Counted()

    def verify(self, rows, model):
        return json.dumps({"origin": rows.first().origin})


def test_registered_plugin(spark, tmp_path):
    register_algorithm("text-plugin")(TextAlgorithm)
    job = {
        "appName": "p",
        "algoClass": "text-plugin",
        "sourceParameter": {"source": "nowhere", "type": "whole"},
        "dataParameter": {"least": 1},
        "algoParameter": {},
        "modelSavePath": f"{tmp_path}/m",
        "modelIndicatorSavePath": f"{tmp_path}/i",
    }
    result = run_train(spark, job)
    assert result.metrics.first().indicator == '{"origin": "nowhere"}'
    assert spark.read.json(f"{tmp_path}/m").first().n == 3
    assert isinstance(resolve_algorithm("text-plugin"), TextAlgorithm)


# -- batch -------------------------------------------------------------------


def batch_job(source, model, result, **more):
    return {
        "appName": "b",
        "modelClass": "ml",
        "modelPath": model,
        "sourceParameter": {"source": source, "type": "parquet"},
        "dataParameter": {"features": ["x"], "keep": ["id"]},
        "resultSavePath": result,
        **more,
    }


def test_batch_failure_is_raised_and_model_unloaded(spark, line, model_path, tmp_path):
    unloaded = []

    class Watched(MLScorer):
        def unload(self):
            unloaded.append(self.model)
            super().unload()

    bad = {"features": ["case when id = 7 then null else x end"], "keep": ["id"]}
    with pytest.raises(Exception, match="null or non-numeric"):
        run_batch(spark, batch_job(line, model_path, f"{tmp_path}/r", dataParameter=bad), Watched())
    assert len(unloaded) == 1
    skipped = run_batch(
        spark, batch_job(line, model_path, f"{tmp_path}/s", dataParameter={**bad, "onInvalid": "skip"}), Watched()
    )
    assert skipped.count() == 199 and len(unloaded) == 2


def test_batch_is_one_narrow_plan(spark, line, model_path):
    scorer = MLScorer()
    scorer.load_model(spark, model_path)
    data = read_parameter({"features": ["x"], "keep": ["id"]})
    plan = scorer.predict(scorer.parse(spark.read.parquet(line), data, "PARQUET"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "ReadSchema: struct<id:bigint,x:double>" in text


def test_answers_to_requests_stay_in_the_jvm(spark, model_path):
    scorer = MLScorer()
    scorer.load_model(spark, model_path)
    requests = spark.range(10).selectExpr("id as request_id", "'{}' as data")
    text = scorer.respond(requests)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Pandas" not in text


def test_vector_outputs(spark, line, tmp_path):
    model = f"{tmp_path}/m"
    data = {"features": ["x"], "label": "case when x >= 100 then 1 else 0 end"}
    run_train(spark, train_job(line, algoClass="LogisticRegression", dataParameter=data, modelSavePath=model))
    out = run_batch(spark, batch_job(line, model, f"{tmp_path}/r", modelParameter={"outputs": ["probability"]}))
    assert dict(out.dtypes)["probability"] == "array<double>"


def test_only_model_classes_are_loaded(spark, tmp_path):
    path = f"{tmp_path}/m"
    meta = {"class": "os.system", "uid": "x", "timestamp": 0, "sparkVersion": "4", "paramMap": {}, "defaultParamMap": {}}
    spark.sparkContext.parallelize([json.dumps(meta)], 1).saveAsTextFile(f"{path}/metadata")
    with pytest.raises(ValueError, match="Refusing to load os.system"):
        load_ml_model(spark, path)


# -- requests ----------------------------------------------------------------


def test_single_answers(spark, model_path):
    scorer = MLScorer()
    scorer.load_model(spark, model_path)
    assert json.loads(scorer.answer(spark, '{"data":[2]}'))["prediction"] == pytest.approx(7.0, abs=1e-4)
    for text, reason in {
        "not json": "malformed request",
        "": "malformed request",
        '{"data":[1': "malformed request",
        "{}": "missing or non-numeric feature",
        '{"data":null}': "missing or non-numeric feature",
        '{"data":[null]}': "missing or non-numeric feature",
        '{"data":[1,2]}': "expected 1 features, got 2",
        '{"data":[]}': "expected 1 features, got 0",
    }.items():
        assert scorer.answer(spark, text) == f"Exception:{reason}", text
    assert scorer.answer(spark, None) == "Exception:malformed request"


def test_harness_requests_on_a_stream(spark, model_path, tmp_path):
    """Requests 1..30 with data [n], some spoilt, in two arrivals and one restart."""
    good = [(n, json.dumps({"data": [n]})) for n in range(1, 31)]
    write_requests(spark, f"{tmp_path}/in", good[:20] + [(100, "oops"), (101, None)])
    run_stream(spark, stream_job(tmp_path, model_path))
    write_requests(spark, f"{tmp_path}/in", good[20:])
    run_stream(spark, stream_job(tmp_path, model_path, threadParallel=1, maxFilesPerTrigger=1))
    got = responses(spark, tmp_path)
    assert set(got) == {*range(1, 31), 100, 101}
    assert got[100] == got[101] == "Exception:malformed request"
    for n in range(1, 31):
        assert json.loads(got[n])["prediction"] == pytest.approx(3 * n + 1, abs=1e-3)


def test_requests_from_any_stream(spark, model_path, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("5|4\n6|x\n")
    lines = spark.readStream.text(f"{tmp_path}/in")
    parts = F.split("value", "[|]")
    requests = lines.select(
        parts[0].cast("bigint").alias("request_id"), F.concat(F.lit('{"data":['), parts[1], F.lit("]}")).alias("data")
    )
    start_stream(spark, stream_job(tmp_path, model_path), requests=requests).awaitTermination()
    got = responses(spark, tmp_path)
    assert json.loads(got[5])["prediction"] == pytest.approx(13.0, abs=1e-3)
    assert got[6] == "Exception:malformed request"


def test_running_query_can_be_stopped(spark, model_path, tmp_path):
    write_requests(spark, f"{tmp_path}/in", [(1, '{"data":[1]}')])
    query = start_stream(spark, stream_job(tmp_path, model_path, triggerInterval="1 second"))
    query.processAllAvailable()
    write_requests(spark, f"{tmp_path}/in", [(2, '{"data":[2]}')])
    query.processAllAvailable()
    assert query.isActive and query.name == "s"
    query.stop()
    assert set(responses(spark, tmp_path)) == {1, 2}


def test_bernoulli_features_are_guarded(spark, tmp_path):
    df = spark.createDataFrame([(0.0, [0.0, 1.0]), (1.0, [1.0, 0.0])], "label double, f array<double>")
    from trainscore.functions import apply_data_spec
    from trainscore.spec import DataSpec

    rows = apply_data_spec(df, DataSpec.parse({"features": ["f"], "label": "label"}))
    NaiveBayes(modelType="bernoulli").fit(rows).save(f"{tmp_path}/m")
    scorer = resolve_scorer("ml", {"schema": "f array<double>", "features": "f"})
    scorer.load_model(spark, f"{tmp_path}/m")
    assert json.loads(scorer.answer(spark, '{"f":[1,0]}')) == {"prediction": 1.0}
    assert scorer.answer(spark, '{"f":[2,0]}') == "Exception:features must be 0 or 1"


def test_request_columns_and_probability(spark, line, tmp_path):
    model = f"{tmp_path}/m"
    data = {"features": ["x", "x * x"], "label": "case when x >= 100 then 1 else 0 end"}
    run_train(spark, train_job(line, algoClass="LogisticRegression", dataParameter=data, modelSavePath=model))
    request = {
        "schema": "x string",
        "columns": {"n": "try_cast(x as double)"},
        "features": ["n", "n * n"],
        "outputs": ["probability"],
    }
    scorer = MLScorer(request)
    scorer.load_model(spark, model)
    result = json.loads(scorer.answer(spark, '{"x":"150"}'))
    assert result["prediction"] == 1.0 and sum(result["probability"]) == pytest.approx(1.0)
    assert scorer.answer(spark, '{"x":"a"}') == "Exception:missing or non-numeric feature"


# -- custom scorers ----------------------------------------------------------


def test_plugin_file_raises_per_request(spark, tmp_path):
    spark.sparkContext.addPyFile(EXAMPLE)
    from deviation_plugin import DeviationModel

    DeviationModel(10.0, 2.0).save(spark, f"{tmp_path}/m")
    values = {i: float(i) for i in range(40)} | {7: -1.0, 23: -5.0}
    requests = [(i, json.dumps({"value": v})) for i, v in values.items()] + [(90, "x"), (91, "{}")]
    write_requests(spark, f"{tmp_path}/in", requests)
    job = stream_job(
        tmp_path, f"{tmp_path}/m", modelClass="deviation_plugin.DeviationScorer", algoPluginPath=EXAMPLE
    )
    run_stream(spark, job)
    got = responses(spark, tmp_path)
    assert got[90] == "Exception:malformed request" and got[91] == "Exception:value is missing"
    for i, v in values.items():
        if v < 0:
            assert got[i] == "Exception:value is negative"
        else:
            assert json.loads(got[i]) == {"deviation": (v - 10) / 2}


def test_batch_scoring_raises_row_errors(spark, tmp_path):
    spark.sparkContext.addPyFile(EXAMPLE)
    from deviation_plugin import DeviationModel

    DeviationModel(10.0, 2.0).save(spark, f"{tmp_path}/m")
    spark.createDataFrame([(1, None)], "id int, value double").write.parquet(f"{tmp_path}/t")
    job = batch_job(f"{tmp_path}/t", f"{tmp_path}/m", f"{tmp_path}/r", dataParameter={"keep": ["id", "value"]})
    with pytest.raises(Exception, match="value is missing"):
        run_batch(spark, {**job, "modelClass": "deviation_plugin.DeviationScorer", "algoPluginPath": EXAMPLE})


@pytest.mark.parametrize("in_task", [False, True])
def test_state_is_broadcast_or_loaded_in_tasks(spark, tmp_path, monkeypatch, in_task):
    class Adder(PandasScorer):
        load_in_task = in_task

        def load_state(self, path, spark=None):
            return int(Path(path).read_text())

        def predict_batch(self, state, batch):
            return pd.DataFrame({"prediction": batch["x"].astype(float) + state})

    (tmp_path / "m").write_text("5")
    scorer = Adder()
    scorer.load_model(spark, str(tmp_path / "m"))
    rows = scorer.predict(spark.range(10).selectExpr("id as x"))
    assert sorted(map(tuple, rows.collect())) == [(i, i + 5.0) for i in range(10)]
    scorer.unload()
    (tmp_path / "m").write_text("7")
    scorer.load_model(spark, str(tmp_path / "m"))
    assert scorer.predict(spark.range(1).selectExpr("id as x")).first()["prediction"] == 7.0


def test_registered_scorer(spark):
    class Named(MLScorer):
        pass

    register_scorer("named")(Named)
    assert isinstance(resolve_scorer("named"), Named)
    with pytest.raises(ValueError, match="Illegal option"):
        resolve_scorer("ml", {"surprise": 1})


# -- recommendations ---------------------------------------------------------


@pytest.fixture(scope="module")
def als(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("als")
    rng = np.random.default_rng(2)
    rows = [(int(u), int(i), float(rng.integers(1, 6))) for u in range(30) for i in rng.choice(20, 8, replace=False)]
    spark.createDataFrame(rows, "u bigint, i bigint, r double").write.parquet(f"{base}/t")
    job = {
        "appName": "r",
        "algoClass": "ALS",
        "sourceParameter": {"source": f"{base}/t", "type": "parquet"},
        "dataParameter": {"ratings": {"user": "u", "item": "i", "rating": "r", "aggregate": True}},
        "algoParameter": {"rank": 4, "maxIter": 3, "seed": 1},
        "dataWeight": [0.8, 0.2],
        "splitKey": ["user", "item"],
        "modelSavePath": f"{base}/m",
        "persist": True,
    }
    result = run_train(spark, job)
    metrics = result.metrics.first()
    assert metrics.n + metrics.n_unscored > 0 and metrics.rmse > 0
    return f"{base}/m"


def test_factor_blocks_do_not_grow_before_they_are_full():
    assert [als_blocks(n) for n in (0, 1, 600_000)] == [1, 1, 5]
    assert als_blocks(3_600_000) == als_blocks(36_000_000) == als_blocks(216_000_000) == 8
    assert als_blocks(10**10) == 313


@pytest.mark.parametrize("n, users, items, rank", [(216_000_000, 5_400_000, 7_200_000, 8), (216_000_000, 5_400_000, 7_200_000, 100), (10**9, 10**6, 1000, 50)])
def test_a_factor_block_fits_a_task(n, users, items, rank):
    for blocks, others in zip(factor_blocks(n, users, items, rank), (items, users), strict=True):
        ratings, factors = n / blocks, 20 + 4 * rank
        assert 36 * ratings <= estimators.TASK_BYTES
        assert 8 * ratings + factors * min(ratings, others) <= estimators.TASK_BYTES


def test_factor_blocks_grow_only_where_a_task_is_full():
    assert factor_blocks(600_000, 15_000, 20_000, 8) == (5, 5)
    assert factor_blocks(36_000_000, 900_000, 1_200_000, 8) == (8, 8)
    # Few items take little room: only the ratings that a block of users is built from count.
    assert factor_blocks(10**9, 10**6, 1000, 50)[0] == 63


def test_a_fit_of_many_ratings_keeps_them_on_disk(spark, monkeypatch):
    rows = spark.range(600).selectExpr("cast(id % 30 as int) user", "cast(id * 7 % 23 as int) item", "cast(id % 5 as double) rating").coalesce(2)
    train = lambda: MLAlgorithm(find_estimator("ALS")).train(rows, read_parameter({"rank": 3, "maxIter": 3, "seed": 1}))
    model = train()
    monkeypatch.setattr(estimators, "KEPT", estimators.TASK_BYTES)
    estimator = find_estimator("ALS")()
    size_als(estimator, rows, {"finalStorageLevel": "MEMORY_ONLY"})
    assert (estimator.getIntermediateStorageLevel(), estimator.getCheckpointInterval(), estimator.getNumItemBlocks()) == ("DISK_ONLY", 1, 1)
    assert estimator.getFinalStorageLevel() == "MEMORY_AND_DISK"  # what is given is set by the caller
    on_disk = train()
    for factors in ("userFactors", "itemFactors"):
        assert sorted(getattr(model, factors).collect()) == sorted(getattr(on_disk, factors).collect())


def test_persisted_rows_take_no_memory_of_a_fit(spark, line):
    class Watching(MLAlgorithm):
        def train(self, rows, params):
            self.level = rows.storageLevel
            return super().train(rows, params)

    watching = Watching(find_estimator("LinearRegression"))
    run_train(spark, train_job(line, persist=True), watching)
    assert watching.level.useDisk and not watching.level.useMemory


def test_recommendations_equal_brute_force(spark, als):
    scorer = RecommendScorer({"numItems": 5})
    scorer.load_model(spark, als)
    users = {r.id: np.array(r.features) for r in scorer.model.userFactors.collect()}
    items = {r.id: np.array(r.features) for r in scorer.model.itemFactors.collect()}
    rows = scorer.predict(spark.createDataFrame([(u % 30,) for u in range(90)] + [(999,)], "user int")).collect()
    assert len(rows) == 91
    for row in rows:
        if row.user == 999:
            assert row.recommendations is None
            continue
        best = sorted(items, key=lambda i: -(users[row.user] @ items[i]))[:5]
        assert [r.item for r in row.recommendations] == best


def test_recommendation_stream_replays_without_new_rows(spark, als, tmp_path):
    requests = [(i, json.dumps({"user": i % 3})) for i in range(50)]  # one user holds a third of them
    write_requests(spark, f"{tmp_path}/in", [*requests, (60, '{"user":12345}'), (61, "?"), (62, "{}")])
    job = stream_job(tmp_path, als, modelClass="recommend", modelParameter={"numItems": 2})
    run_stream(spark, job)
    got = responses(spark, tmp_path)
    assert len(got) == 53
    assert (got[60], got[61], got[62]) == (
        "Exception:unknown user 12345",
        "Exception:malformed request",
        "Exception:missing user",
    )
    assert all(len(json.loads(got[i])["recommendations"]) == 2 for i in range(50))

    # The batch is done again, as after a crash before its commit.
    for name in ("0", ".0.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    run_stream(spark, job)
    assert responses(spark, tmp_path) == got

    with pytest.raises(ValueError, match="would start again"):
        start_stream(spark, {**job, "checkpointPath": f"{tmp_path}/new"})


def test_hot_user_is_split_in_the_join(spark, als, tmp_path):
    """A user holding most rows of a table: adaptive execution cuts that partition."""
    spark.range(200_000).selectExpr(
        "id", "cast(if(id % 10 < 9, 1, id % 30) as int) as user", "repeat(md5(cast(id as string)), 4) as text"
    ).write.parquet(f"{tmp_path}/t")
    scorer = RecommendScorer({"numItems": 2})
    scorer.load_model(spark, als)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = scorer.predict(spark.read.parquet(f"{tmp_path}/t"))
        rows = out.groupBy("user").agg(F.count("recommendations").alias("n"))
        out.write.format("noop").mode("overwrite").save()
        assert sum(r.n for r in rows.collect()) == 200_000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_order_is_split_in_the_rating_join(spark, tmp_path):
    """One order holding a third of all lines: its partition is cut, its sum combined before."""
    from workload.common import ratings

    spark.range(300_000).selectExpr(
        "if(id % 3 = 0, 7, id % 50000) as l_orderkey", "abs(hash(id)) as l_partkey", "1.0 as l_quantity"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50_000).selectExpr("id as o_orderkey", "id % 1000 as o_custkey").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = ratings(spark, str(tmp_path))
        assert sum(r.rating for r in rows.collect()) == 300_000.0
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan and "partial_sum" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ml_scorer_and_als_model(spark, als, tmp_path):
    scorer = MLScorer()
    scorer.load_model(spark, als)
    with pytest.raises(ValueError, match="recommend scorer"):
        scorer.answer(spark, "{}")
    spark.createDataFrame([(1, 2), (1, 999)], "u int, i int").write.parquet(f"{tmp_path}/t")
    data = {"ratings": {"user": "u", "item": "i"}}
    out = run_batch(spark, batch_job(f"{tmp_path}/t", als, f"{tmp_path}/r", dataParameter=data)).collect()
    rating = {r.item: r.prediction for r in out}
    assert np.isnan(rating[999]) and 0 < rating[2] < 10


def test_recommender_needs_an_als_model(spark, model_path):
    with pytest.raises(ValueError, match="does not recommend"):
        RecommendScorer().load_model(spark, model_path)


def test_ratings_plugin_with_own_loader(spark):
    class Fixed(MLAlgorithm):
        def load(self, spark, source):
            return spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 1, 4.0)], "u int, i int, r double")

    job = {
        "appName": "r",
        "algoClass": "ALS",
        "sourceParameter": {"source": "-", "type": "object"},
        "dataParameter": {"ratings": {"user": "u", "item": "i", "rating": "r"}},
        "algoParameter": {"rank": 2, "seed": 1, "numUserBlocks": 1},
    }
    assert run_train(spark, job, Fixed(find_estimator("ALS"))).metrics.first().n == 3


@pytest.mark.parametrize(
    "name, params, data",
    [
        ("ALS", {"rank": 2, "seed": 1}, {"ratings": {"user": "id", "item": "id % 7", "rating": "y", "aggregate": True}}),
        ("LDA", {"k": 2, "maxIter": 2, "seed": 1, "optimizer": "em"}, {"features": ["x", "1"]}),
    ],
)
def test_distributed_models_do_not_need_the_training_rows(spark, line, tmp_path, name, params, data):
    """What the model is made of can be computed again after the source is gone."""
    source = f"{tmp_path}/t"
    spark.read.parquet(line).write.parquet(source)
    job = train_job(source, algoClass=name, algoParameter=params, dataParameter=data, dataWeight=[0.7, 0.3])
    model = run_train(spark, job).model
    for file in Path(source).glob("*"):
        file.write_bytes(b"")
    spark.catalog.clearCache()
    for rdd in spark.sparkContext._jsc.getPersistentRDDs().values():
        rdd.unpersist(True)
    model.save(f"{tmp_path}/m")
    if name == "ALS":
        assert load_ml_model(spark, f"{tmp_path}/m").userFactors.count() > 0


def test_estimator_with_own_parser(spark, line):
    class Doubled(MLAlgorithm):
        def parse(self, raw, data, source_type):
            factor = data.values["factor"]
            own = read_parameter({"features": [f"x * {factor}"], "label": "y"})
            return super().parse(raw, own, source_type)

    job = train_job(line, dataParameter={"factor": 2}, dataWeight=[0.5, 0.5])
    result = run_train(spark, job, Doubled(find_estimator("LinearRegression")))
    assert result.model.coefficients[0] == pytest.approx(1.5, abs=1e-6)


def test_command_line(line, model_path, tmp_path):
    assert sorted(JOBS) == ["batch", "stream", "train"]
    settings = tmp_path / "job.json"
    settings.write_text(json.dumps(batch_job(line, model_path, f"{tmp_path}/r")))
    command = [sys.executable, "-m", "trainscore", "batch", str(settings)]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert (tmp_path / "r" / "_SUCCESS").exists()
    with pytest.raises(ValueError, match="Missing option"):
        main(["batch", '{"appName": "x"}'])


def test_settings_are_checked_before_data_is_read(spark, line, model_path):
    def never(*_):
        raise AssertionError("data was touched")

    for more, reason in (
        ({"algoParameter": {"depth": 1}}, "Unknown parameter"),
        ({"dataParameter": {"feature": "x"}}, "Illegal option"),
        ({"modelSavePath": model_path}, "already exists"),
        ({"dataWeight": [0.7, 0.3], "splitKey": ["nobody"]}, "splitKey must be among"),
    ):
        algorithm = resolve_algorithm("LinearRegression")
        algorithm.load = never
        with pytest.raises(ValueError, match=reason):
            run_train(spark, train_job(line, **more), algorithm)
