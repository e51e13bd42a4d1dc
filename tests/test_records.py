"""The verdict on records: one rule for JSON, delimited text and CSV."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trainscore import load_source, run_batch, run_train
from trainscore.functions import apply_data_spec, divide, parse, rejected_records
from trainscore.spec import DataSpec

GOOD = [(1, 2.5), (2, None), (None, 3.0)]
JSON = {
    '{"a": 1, "b": 2.5}': None,
    ' {"a": 2}': None,
    '{"a": null, "b": 3, "other": [1]}': None,
    "not json": "no JSON object of the schema",
    '{"a": "x", "b": 3.0}': "no JSON object of the schema",
    '{"a": 4, "b": NaN}': "bad value of b",
    '{"a": 4, "b": 1e400}': "bad value of b",
    "null": "no JSON object of the schema",
    "": "no JSON object of the schema",
    "[1, 2]": "no JSON object of the schema",
    "7": "no JSON object of the schema",
    '{"a": 1': "no JSON object of the schema",
}
LINES = {
    "1|2.5": None,
    "2|": None,
    "|3": None,
    "x|3": "bad value of a",
    "4|x": "bad value of b",
    "4|NaN": "bad value of b",
    "4|-Infinity": "bad value of b",
    "4": "1 cells instead of 2",
    "4|5|6": "3 cells instead of 2",
    "": "1 cells instead of 2",
}
CSV = {"1,2.5": None, "2,": None, ",3": None, "x,3": "cell", "4,x": "cell", "4,NaN": "bad value of b", "4": "cell", "4,5,6": "cell"}
SCHEMA = "a bigint, b double"


def texts(spark, kind, tmp_path, rows=None):
    """The records as a source, with the setting to parse them."""
    if kind == "csv":
        (tmp_path / "t.csv").write_text("a,b\n" + "\n".join(rows or CSV) + "\n")
        return load_source(spark, {"source": str(tmp_path), "type": "csv", "schema": SCHEMA}, verdicts=True), {}, "CSV", CSV
    records = LINES if kind == "delimited" else JSON
    (tmp_path / "t.txt").write_text("\n".join(rows or records) + "\n")
    more = {"delimiter": "|"} if kind == "delimited" else {}
    return load_source(spark, {"source": str(tmp_path), "type": "text"}), {"schema": SCHEMA, **more}, "TEXT", records


KINDS = ["json", "delimited", "csv"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("condition", [None, "b > 0", "a > 0"])
def test_good_records_and_all_others(spark, tmp_path, kind, condition):
    raw, setting, source_type, records = texts(spark, kind, tmp_path)
    setting = {**setting, **({"filter": condition} if condition else {})}
    expected = [g for g in GOOD if condition is None or (g[1] if "b" in condition else g[0])]
    left = apply_data_spec(raw, DataSpec.parse({**setting, "onInvalid": "skip"}), source_type)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(expected, key=repr)
    assert left.count() == len(expected)

    good, rejected = divide(raw, DataSpec.parse(setting), source_type)
    assert sorted(map(tuple, good.collect()), key=repr) == sorted(expected, key=repr)
    bad = {t: r for t, r in records.items() if r}
    rows = rejected.collect()
    assert {r.text for r in rows} == set(bad) and len(rows) == len(bad)
    assert all(r.reason.startswith("malformed record: ") and bad[r.text] in r.reason and str(tmp_path) in r.path for r in rows)
    assert sorted(rejected_records(raw, DataSpec.parse(setting), source_type).collect()) == sorted(rows)


@pytest.mark.parametrize("kind", KINDS)
def test_each_bad_record_fails_with_or_without_filter(spark, tmp_path, kind):
    records = {"json": JSON, "delimited": LINES, "csv": CSV}[kind]
    for i, (text, reason) in enumerate(records.items()):
        if not reason:
            continue
        folder = tmp_path / str(i)
        folder.mkdir()
        raw, setting, source_type, _ = texts(spark, kind, folder, [next(iter(records)), text])
        for more in ({}, {"filter": "a > 100"}, {"filter": "b > 100", "keep": ["b"]}, {"keep": ["a"]}):
            with pytest.raises(Exception, match="malformed record"):
                apply_data_spec(raw, DataSpec.parse({**setting, **more}), source_type).collect()


@pytest.mark.parametrize("schema", ["a int, b int", "a int, b double", "a string, b int"])
def test_csv_verdict_does_not_hang_on_types_or_use(spark, tmp_path, schema):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n1,x\n")
    source = {"source": str(tmp_path), "type": "csv", "schema": schema}
    for use in (lambda d: d.where("a = 7"), lambda d: d.select("a"), lambda d: d.where("b > 3").select("a")):
        with pytest.raises(Exception, match="malformed record"):
            use(load_source(spark, source)).collect()
    raw = load_source(spark, source, verdicts=True)
    for setting in ({"keep": ["a"]}, {"keep": ["b"]}, {"filter": "a = 1"}):
        rows = apply_data_spec(raw, DataSpec.parse({**setting, "onInvalid": "skip"}), "CSV")
        assert rows.count() == 1 == len(rows.collect())


def test_elements_of_documents_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": "y"}, null,\n {"x": 2.0, "s": "a\\n\\"b\\""}, 3]')
    (tmp_path / "b.json").write_text("[{")
    (tmp_path / "c.json").write_text("[]")
    raw = load_source(spark, {"source": str(tmp_path), "type": "json"})
    data = {"schema": "x double, s string, n array<double>", "explode": True}
    good, rejected = divide(raw, DataSpec.parse(data), "JSON")
    assert sorted((r.x, r.s) for r in good.collect()) == [(1.0, None), (2.0, 'a\n"b"')]
    found = sorted((r.path.rsplit("/", 1)[1], r.text) for r in rejected.collect())
    assert [(f, t.replace(" ", "")) for f, t in found] == [("a.json", "3"), ("a.json", "null"), ("a.json", '{"x":"y"}'), ("b.json", "[{")]
    nested = spark.createDataFrame([('{"x": 1, "n": [1, NaN]}',), ('{"x": 1, "n": [1, null]}',)], "value string")
    kept = apply_data_spec(nested, DataSpec.parse({**data, "explode": False, "onInvalid": "skip"}), "TEXT")
    assert [r.n for r in kept.collect()] == [[1.0, None]]


def test_inputs_that_no_model_takes_are_rejected_too(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2", 3.0), (2, "x", 3.0), (3, "2", float("nan")), (4, None, 1.0)], "id long, f string, y double")
    setting = {"features": ["f"], "label": "y", "keep": ["id"], "onInvalid": "reject", "rejectPath": f"{tmp_path}/bad"}
    good = apply_data_spec(rows, DataSpec.parse(setting))
    assert [(r.id, r.label, list(r.features)) for r in good.collect()] == [(1, 3.0, [2.0])]
    assert good.schema["features"].metadata == {"ml_attr": {"num_attrs": 1}}
    bad = sorted(r.text for r in spark.read.parquet(f"{tmp_path}/bad").collect())
    assert bad == ['{"label":"NaN","f":"2"}', '{"label":1.0,"f":null}', '{"label":3.0,"f":"x"}']
    ratings = {"ratings": {"user": "id", "item": "f", "rating": "y", "aggregate": True}, "onInvalid": "reject", "rejectPath": f"{tmp_path}/bad2"}
    assert [tuple(r) for r in apply_data_spec(rows, DataSpec.parse(ratings)).collect()] == [(1, 2, 3.0)]
    assert spark.read.parquet(f"{tmp_path}/bad2").count() == 3


def test_expressions_are_not_evaluated_for_rejected_records(spark, tmp_path):
    raw = spark.createDataFrame([("1|2",), ("x|2",)], "value string")
    data = {"schema": "a int, b int", "delimiter": "|", "columns": {"c": "if(a is null, raise_error('evaluated'), a)"}, "filter": "assert_true(a is not null) is null"}
    good, rejected = divide(raw, DataSpec.parse(data), "TEXT")
    assert [r.c for r in good.collect()] == [1] and rejected.count() == 1


def test_a_job_parses_once_and_leaves_no_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"{i}|{2 * i + 1}" for i in range(50)] + ["bad|1", "3"]
    (tmp_path / "in" / "t.txt").write_text("\n".join(lines))
    data = {"schema": "x double, y double", "delimiter": "|", "features": ["x"], "onInvalid": "reject", "rejectPath": f"{tmp_path}/bad"}
    source = {"source": f"{tmp_path}/in", "type": "text"}
    train = {"appName": "t", "algoClass": "LinearRegression", "sourceParameter": source, "dataParameter": {**data, "label": "y"}, "algoParameter": {}, "modelSavePath": f"{tmp_path}/m"}
    result = run_train(spark, train)
    assert abs(result.model.coefficients[0] - 2) < 1e-6
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 2
    batch = {"appName": "s", "modelClass": "ml", "modelPath": f"{tmp_path}/m", "sourceParameter": source, "dataParameter": {**data, "keep": ["y"]}, "resultSavePath": f"{tmp_path}/scores"}
    assert run_batch(spark, batch).where("abs(prediction - y) < 0.001").count() == 50
    assert {r.reason for r in spark.read.parquet(f"{tmp_path}/bad").collect()} == {"malformed record: bad value of x", "malformed record: 1 cells instead of 2"}


def test_reject_needs_a_path():
    for bad in ({"onInvalid": "reject"}, {"rejectPath": "/x"}):
        with pytest.raises(ValueError, match="rejectPath"):
            DataSpec.parse(bad)


def test_divide_sorts_nothing_and_keeps_the_text_of_rejected_records_alone(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part").write_text("1|2.5\n2|x\n3|4\n")
    raw = load_source(spark, {"source": str(tmp_path / "in"), "type": "text"})
    monkeypatch.setattr(parse, "working_path", lambda *_: f"{tmp_path}/parsed")
    good, rejected = divide(raw, DataSpec.parse({"schema": "a int, b double", "delimiter": "|"}), "TEXT")
    assert sorted(map(tuple, good.collect())) == [(1, 2.5), (3, 4.0)] and [r.text for r in rejected.collect()] == ["2|x"]
    # Folders of parted rows would be written in their order, a sort of all that a task reads.
    assert not [p for p in (tmp_path / "parsed").iterdir() if p.is_dir()]
    stored = spark.read.parquet(f"{tmp_path}/parsed")
    assert stored.where("__reason is null and (__text is not null or __path is not null)").count() == 0
