"""A model that takes another's place: whatever fails, one of them can be loaded."""

from __future__ import annotations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel

from trainscore import run_batch, run_train
from trainscore.operators import sinks
from trainscore.operators.scorers import load_ml_model
from trainscore.operators.sinks import current_model, save_model
from trainscore.storage import names_in


@pytest.fixture(scope="module")
def models(spark):
    """Models of slope 1, 2, 3 and 4."""
    out = []
    for slope in (1.0, 2.0, 3.0, 4.0):
        rows = spark.createDataFrame([(Vectors.dense([float(x)]), slope * x) for x in range(9)], ["features", "label"])
        out.append(LinearRegression(solver="normal").fit(rows))
    return out


def slope(spark, path):
    return round(load_ml_model(spark, path).coefficients[0])


def test_a_first_model_lies_plainly(spark, models, tmp_path):
    path = f"{tmp_path}/m"
    save_model(spark, models[0], path, overwrite=True)
    assert current_model(spark, path) == path and round(LinearRegressionModel.load(path).coefficients[0]) == 1
    with pytest.raises(Exception, match="already exists|exist"):
        save_model(spark, models[1], path)
    assert slope(spark, path) == 1


def test_versions_follow_each_other_and_old_ones_go(spark, models, tmp_path):
    path = f"{tmp_path}/m"
    places = []
    for i, model in enumerate(models, 1):
        save_model(spark, model, path, overwrite=True)
        assert slope(spark, f"{path}/") == i
        places.append(current_model(spark, path))
        if i > 1:  # the one before stays for those who are reading it
            assert round(LinearRegressionModel.load(places[-2]).coefficients[0]) == i - 1
    assert len(set(places)) == 4
    left = [n for n in names_in(spark, path) if n.startswith(sinks.VERSION)]
    assert left == sorted(p.rsplit("/", 1)[1] for p in places[-2:])
    assert set(names_in(spark, path)) == {sinks.COMMITTED, *left}


class Boom(Exception):
    pass


def failing(*args, **kwargs):
    raise Boom


@pytest.mark.parametrize("before", [1, 2, 3])
@pytest.mark.parametrize("step", ["_write_model", "half", "create_file", "delete_path"])
def test_a_failure_at_any_step_leaves_a_model(spark, models, tmp_path, monkeypatch, step, before):
    path = f"{tmp_path}/m"
    for model in models[:before]:
        save_model(spark, model, path, overwrite=True)

    def half(spark, model, path):
        model.write().save(f"{path}/metadata")  # something, but no model
        raise Boom

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_write_model" if step == "half" else step, half if step == "half" else failing)
        fails = step != "delete_path" or before > 1
        if fails:
            with pytest.raises(Boom):
                save_model(spark, models[before], path, overwrite=True)
        else:
            save_model(spark, models[before], path, overwrite=True)
    assert slope(spark, path) == (before + 1 if step == "delete_path" else before)
    save_model(spark, models[0], path, overwrite=True)
    assert slope(spark, path) == 1


def test_jobs_read_the_latest_version(spark, tmp_path):
    scores = []
    for factor in (2.0, 5.0):
        spark.createDataFrame([(float(i), factor * i) for i in range(20)], "x double, y double").write.mode("overwrite").parquet(f"{tmp_path}/rows")
        job = {
            "appName": "t",
            "algoClass": "LinearRegression",
            "sourceParameter": {"source": f"{tmp_path}/rows", "type": "parquet"},
            "dataParameter": {"features": ["x"], "label": "y"},
            "algoParameter": {"solver": "normal"},
            "modelSavePath": f"{tmp_path}/m",
            "overwriteModel": True,
        }
        run_train(spark, job)
        batch = {
            "appName": "s",
            "modelClass": "ml",
            "modelPath": f"{tmp_path}/m",
            "sourceParameter": job["sourceParameter"],
            "dataParameter": {"features": ["x"], "keep": ["x"]},
            "resultSavePath": f"{tmp_path}/scores{factor}",
        }
        scores.append(round(run_batch(spark, batch).where("x = 3").first().prediction))
    assert scores == [6, 15]
