"""Settings are checked before any Spark work: no test here needs a session."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trainscore.operators.estimators import find_estimator
from trainscore.plugins import Parameter, read_parameter, resolve_algorithm, resolve_scorer
from trainscore.spec import SOURCE_TYPES, BatchSpec, DataSpec, SourceSpec, StreamSpec, TrainSpec, check_weights

SOURCE = {"source": "/data/x", "type": "csv"}
TRAIN = {
    "appName": "demo",
    "algoClass": "pyspark.ml.regression.LinearRegression",
    "sourceParameter": SOURCE,
    "dataParameter": {"features": ["x"]},
    "algoParameter": {},
}
BATCH = {
    "appName": "demo",
    "modelClass": "ml",
    "modelPath": "/m",
    "sourceParameter": SOURCE,
    "dataParameter": {},
    "resultSavePath": "/r",
}
STREAM = {
    "appName": "demo",
    "modelClass": "ml",
    "modelPath": "/m",
    "requestPath": "/in",
    "responsePath": "/out",
    "checkpointPath": "/ck",
}


@pytest.mark.parametrize("weights", [(1.0, 0), (0.7, 0.3), (0.5, 0.3), (0.01, 0.99), [1, 0]])
def test_valid_weights(weights):
    assert check_weights(weights) == (float(weights[0]), float(weights[1]))


@pytest.mark.parametrize(
    "weights", [(0, 1), (-0.1, 0.5), (1.1, 0), (0.7, 0.4), (1.0, 1.0), (0.5, -0.1), (1.0,), [0.6, 0.2, 0.1], [], "0.7", [True, 0], None]
)
def test_invalid_weights(weights):
    with pytest.raises(ValueError, match="Invalid weight"):
        check_weights(weights)


@given(st.floats(-2, 2), st.floats(-2, 2))
def test_weight_rule(train, verify):
    valid = 0 < train <= 1 and 0 <= verify <= 1 and train + verify <= 1
    if valid:
        assert check_weights([train, verify]) == (train, verify)
    else:
        with pytest.raises(ValueError):
            check_weights([train, verify])


def test_bad_weight_is_named():
    with pytest.raises(ValueError, match=r"0\.9, 0\.9"):
        TrainSpec.parse({**TRAIN, "dataWeight": [0.9, 0.9]})


def test_weights_in_all_forms():
    for form in ([0.7, 0.3], {"dataWeight": [0.7, 0.3]}, '{"dataWeight": [0.7, 0.3]}'):
        assert TrainSpec.parse({**TRAIN, "dataWeight": form}).dataWeight == (0.7, 0.3)
    assert TrainSpec.parse(TRAIN).dataWeight == (1.0, 0.0)


@pytest.mark.parametrize("kind", SOURCE_TYPES)
def test_source_type_in_any_case(kind):
    for name in (kind, kind.lower(), kind.title()):
        assert SourceSpec.parse({"source": "p", "type": name}).type == kind


def test_unsupported_source_type():
    with pytest.raises(ValueError, match="Unsupported source type:KAFKA"):
        SourceSpec.parse({"source": "p", "type": "kafka"})


def test_source_as_json_text():
    assert SourceSpec.parse('{"source": "a,b", "type": "text"}').paths == ["a", "b"]
    with pytest.raises(ValueError, match="not valid JSON"):
        SourceSpec.parse("{")
    with pytest.raises(ValueError, match="JSON object"):
        SourceSpec.parse("[1]")


@pytest.mark.parametrize("spec, setting", [(TrainSpec, TRAIN), (BatchSpec, BATCH), (StreamSpec, STREAM)])
def test_unknown_and_missing_keys(spec, setting):
    assert spec.parse(setting).appName == "demo"
    assert spec.parse(json.dumps(setting)) == spec.parse(setting)
    with pytest.raises(ValueError, match="Illegal option.*surprise"):
        spec.parse({**setting, "surprise": 1})
    for key in setting:
        with pytest.raises(ValueError, match=f"Missing option.*{key}"):
            spec.parse({k: v for k, v in setting.items() if k != key})


def test_app_names():
    assert TrainSpec.parse(TRAIN).app_name == "LinearRegression:demo"
    assert BatchSpec.parse(BATCH).app_name == "demo"
    assert StreamSpec.parse(STREAM).app_name == "demo"


def test_bad_values():
    for setting in ({"resultFormat": "xls"}, {"resultMode": "replace"}):
        with pytest.raises(ValueError, match="Invalid result"):
            BatchSpec.parse({**BATCH, **setting})
    for key in ("maxFilesPerTrigger", "threadParallel"):
        with pytest.raises(ValueError, match=key):
            StreamSpec.parse({**STREAM, key: 0})


def test_data_setting():
    for setting in (
        {"features": ["x"], "ratings": {"user": "u", "item": "i"}},
        {"ratings": {"user": "u"}},
        {"delimiter": ","},
        {"explode": True},
        {"features": [1]},
        {"onInvalid": "ignore"},
        {"colums": {}},
    ):
        with pytest.raises(ValueError):
            DataSpec.parse(setting)
    assert DataSpec.parse({"features": "x"}).features == ("x",)


def test_algorithm_by_name():
    assert find_estimator("ALS") is find_estimator("pyspark.ml.recommendation.ALS")
    assert find_estimator("ALSModel") is None
    assert find_estimator("pyspark.ml.feature.StringIndexer") is None
    assert resolve_algorithm("KMeans").kind == "clustering"
    for name in ("Nonsense", "os.path.join", "pyspark.ml.feature.StringIndexer", "no.such.Thing"):
        with pytest.raises(ValueError):
            resolve_algorithm(name)
    with pytest.raises(ValueError):
        resolve_scorer("os.path.join")


def test_parameters_from_dict_text_and_class():
    assert read_parameter({"a": 1}).values == read_parameter('{"a": 1}').values == {"a": 1}
    with pytest.raises(ValueError):
        read_parameter("[1]")
    with pytest.raises(ValueError, match="not a Parameter"):
        read_parameter({}, "json.JSONDecoder")
    given_one = Parameter()
    assert read_parameter(given_one) is given_one
