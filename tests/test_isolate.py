"""Requests that make the plan fail are answered, one by one."""

from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.regression import LinearRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trainscore import run_stream
from trainscore.operators import isolate
from trainscore.operators.scorers import MLScorer
from trainscore.plugins import RESPONSE_SCHEMA

# Expression, the requests' fields, the start of the answer (None: a prediction).
POISON = [
    ("element_at(a, 0)", {"a": [1.0]}, "Exception:[INVALID_INDEX_OF_ZERO]"),
    ("raise_error(s)", {"s": "boom"}, "Exception:[USER_RAISED_EXCEPTION] boom"),
    ("if('x' rlike s, 1, 0)", {"s": "("}, "Exception:PatternSyntaxException"),
    ("k * 4000000000", {"k": 4000000000}, "Exception:[ARITHMETIC_OVERFLOW]"),
    ("k + 9223372036854775807", {"k": 1}, "Exception:[ARITHMETIC_OVERFLOW]"),
    ("k * 2", {"k": 4}, None),
    ("cast(s as double)", {"s": "abc"}, "Exception:missing or non-numeric feature"),
    ("1 / k", {"k": 0}, "Exception:missing or non-numeric feature"),
    ("element_at(a, 5)", {"a": [1.0]}, "Exception:missing or non-numeric feature"),
]
SCHEMA = "a array<double>, s string, k bigint"


@pytest.fixture(scope="module")
def model_path(spark, tmp_path_factory):
    rows = spark.createDataFrame([(Vectors.dense([float(x)]), 2.0 * x) for x in range(9)], ["features", "label"])
    path = f"{tmp_path_factory.mktemp('model')}/m"
    LinearRegression().fit(rows).save(path)
    return path


def scorer_of(spark, model_path, expression):
    scorer = MLScorer({"schema": SCHEMA, "columns": {"c": expression}, "features": ["c"]})
    scorer.load_model(spark, model_path)
    return scorer


@pytest.mark.parametrize("expression, fields, start", POISON)
def test_a_single_bad_request_has_an_answer(spark, model_path, expression, fields, start):
    got = scorer_of(spark, model_path, expression).answer(spark, json.dumps(fields))
    assert got.startswith(start or '{"prediction"'), got
    assert "\n" not in got


def test_others_keep_their_answers(spark, model_path):
    scorer = scorer_of(spark, model_path, "element_at(array(k * 4000000000), cast(a[0] as int)) / 4000000000")
    bad_index, too_large = {"k": 5, "a": [0.0]}, {"k": 10**10, "a": [1.0]}
    data = [json.dumps({"k": i, "a": [1.0]}) for i in range(300)]
    data[7] = data[8] = data[200] = json.dumps(bad_index)
    data[100], data[150], data[151] = json.dumps(too_large), "not json", None
    requests = spark.createDataFrame([*enumerate(data), (None, data[0]), (0, data[7])], "request_id long, data string")
    rows = isolate.answered_apart(scorer, requests.persist()).collect()
    assert len(rows) == 302
    by_id = {r.request_id: r.result for r in rows if r.request_id not in (None, 0)}
    for i in (7, 8, 200):
        assert by_id[i].startswith("Exception:[INVALID_INDEX_OF_ZERO]")
    assert by_id[100].startswith("Exception:[ARITHMETIC_OVERFLOW]")
    assert by_id[150] == by_id[151] == "Exception:malformed request"
    rest = [i for i in range(1, 300) if i not in (7, 8, 200, 100, 150, 151)]
    assert all(abs(json.loads(by_id[i])["prediction"] - 2 * i) < 1e-3 for i in rest)
    assert sorted(r.result[:10] for r in rows if r.request_id == 0) == ["Exception:", '{"predicti']
    assert isolate.faults(scorer, requests.limit(5)) == []


def test_a_stream_goes_on_and_a_restart_replays_the_answers(spark, model_path, tmp_path):
    folder = tmp_path / "requests"
    folder.mkdir()
    lines = [{"request_id": i, "data": json.dumps({"a": [2.0, 3.0], "k": i % 3})} for i in range(60)]
    (folder / "1.json").write_text("\n".join(map(json.dumps, lines)))
    job = {
        "appName": "poison",
        "modelClass": "ml",
        "modelPath": model_path,
        "requestPath": str(folder),
        "responsePath": f"{tmp_path}/responses",
        "checkpointPath": f"{tmp_path}/checkpoint",
        "modelParameter": {"schema": SCHEMA, "features": ["element_at(a, cast(k as int))"]},
    }
    run_stream(spark, job)
    (folder / "2.json").write_text(json.dumps({"request_id": 99, "data": json.dumps({"a": [4.0], "k": 1})}))
    run_stream(spark, job)
    got = {r.request_id: r.result for r in spark.read.schema(RESPONSE_SCHEMA).parquet(f"{tmp_path}/responses").collect()}
    assert len(got) == 61
    assert all(got[i].startswith("Exception:[INVALID_INDEX_OF_ZERO]") for i in range(0, 60, 3))
    assert all(abs(json.loads(got[i])["prediction"] - 2 * [2, 3][i % 3 - 1]) < 1e-3 for i in range(60) if i % 3)
    assert abs(json.loads(got[99])["prediction"] - 8) < 1e-3


def test_plain_fields_stay_in_the_stream_plan(spark):
    assert not MLScorer({"schema": "k double, `a b` double", "features": ["k", "`a b`"]}).runs_jobs
    assert not MLScorer().runs_jobs
    assert MLScorer({"schema": "k double", "features": ["k + 1"]}).runs_jobs


def test_other_failures_are_raised(spark):
    class Broken:
        def respond(self, requests):
            return requests.select("request_id", F.col("missing").alias("result"))

    requests = spark.createDataFrame([(1, "x")], "request_id long, data string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        isolate.answered_apart(Broken(), requests)
    assert isolate.data_fault(OSError("disk")) is None
