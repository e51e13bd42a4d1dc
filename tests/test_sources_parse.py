from __future__ import annotations

import pytest
from pyspark.ml.linalg import DenseVector, Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainscore import load_source
from trainscore.functions import apply_data_spec
from trainscore.spec import DataSpec


def parse(df, kind="PARQUET", with_label=True, **data):
    return apply_data_spec(df, DataSpec.parse(data), kind, with_label=with_label)


def test_text_paths_and_globs(spark, tmp_path):
    for name, text in {"a.txt": "one\ntwo\n", "b.txt": "three", "c.log": "four"}.items():
        (tmp_path / name).write_text(text)
    read = lambda s: sorted(r.value for r in load_source(spark, {"source": s, "type": "text"}).collect())
    assert read(f"{tmp_path}/a.txt,{tmp_path}/b.txt") == ["one", "three", "two"]
    assert read(f"{tmp_path}/*.txt") == ["one", "three", "two"]


def test_whole_files_keep_content(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"x": 1},\n {"x": 2}\n]')
    (tmp_path / "b.json").write_text('[{"x": 3}]')
    for kind in ("json", "whole"):
        rows = load_source(spark, {"source": str(tmp_path), "type": kind}).collect()
        assert {r.path.rsplit("/", 1)[1]: r.content for r in rows} == {
            f.name: f.read_text() for f in tmp_path.iterdir()
        }
    raw = load_source(spark, {"source": str(tmp_path), "type": "json"})
    parsed = parse(raw, "JSON", schema="x int", explode=True, keep=["x"])
    assert sorted(r.x for r in parsed.collect()) == [1, 2, 3]


def test_malformed_document_fails_or_is_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}]')
    (tmp_path / "b.json").write_text("[{")
    raw = load_source(spark, {"source": str(tmp_path), "type": "json"})
    with pytest.raises(Exception, match="(?i)malformed"):
        parse(raw, "JSON", schema="x int", explode=True, keep=["x"]).collect()
    kept = parse(raw, "JSON", schema="x int", explode=True, features=["x"], onInvalid="skip")
    assert [r.features for r in kept.collect()] == [DenseVector([1.0])]


def test_csv_without_schema_is_strings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\n")
    df = load_source(spark, {"source": str(tmp_path), "type": "CSV"})
    assert df.dtypes == [("id", "string"), ("v", "string")]
    semi = tmp_path / "b"
    semi.mkdir()
    (semi / "b.csv").write_text("1;2.5\n")
    setting = {"source": str(semi), "type": "CSV", "schema": "id int, v double", "options": {"header": "false", "sep": ";"}}
    assert load_source(spark, setting).collect() == [(1, 2.5)]


def test_hadoop_default_format_has_offsets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ab\ncde\n")
    rows = load_source(spark, {"source": str(tmp_path), "type": "hadoop"}).collect()
    assert sorted(map(tuple, rows)) == [(0, "ab"), (3, "cde")]


def test_sequence_of_other_types(spark, tmp_path):
    path = f"{tmp_path}/seq"
    spark.sparkContext.parallelize([("a", 1.5), ("b", 2.5)], 2).saveAsSequenceFile(path)
    df = load_source(spark, {"source": path, "type": "sequence", "schema": "key string, value double"})
    assert sorted(map(tuple, df.collect())) == [("a", 1.5), ("b", 2.5)]


def test_object_needs_schema_and_keeps_it_when_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        load_source(spark, {"source": str(tmp_path), "type": "object"})
    path = f"{tmp_path}/empty"
    spark.sparkContext.parallelize([], 1).saveAsPickleFile(path)
    df = load_source(spark, {"source": path, "type": "object", "schema": "id int, v double"})
    assert df.columns == ["id", "v"] and df.count() == 0


def test_delimiter_is_taken_literally(spark):
    df = spark.createDataFrame([("1||x",), ("2||",), ("||y",)], "value string")
    rows = parse(df, "TEXT", schema="n int, s string", delimiter="||").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, ""), (None, "y")]


def test_features_of_all_kinds(spark):
    df = spark.createDataFrame(
        [(1, "2.5", [3.0, 4.0], Vectors.dense([5.0])), (6, "7", [8.0], Vectors.sparse(2, {1: 9.0}))],
        T.StructType.fromDDL("a int, b string, c array<float>").add("v", VectorUDT()),
    )
    rows = parse(df, features=["a", "b", "c", "v", "a * 10"], label="b").collect()
    assert [list(r.features) for r in rows] == [[1, 2.5, 3, 4, 5, 10], [6, 7, 8, 0, 9, 60]]
    assert [r.label for r in rows] == [2.5, 7.0]


def test_scalar_features_carry_their_number(spark):
    df = spark.range(3).selectExpr("id as a", "id as b")
    assert parse(df, features=["a", "b"]).schema["features"].metadata == {"ml_attr": {"num_attrs": 2}}


@pytest.mark.parametrize(
    "bad", [(None, [1.0], "1"), (1.0, None, "1"), (1.0, [None], "1"), (1.0, [1.0], "x"), (1.0, [1.0], None)]
)
def test_invalid_rows(spark, bad):
    df = spark.createDataFrame([(0.0, [2.0], "3"), bad], "a double, c array<double>, y string")
    data = {"features": ["a", "c"], "label": "y"}
    with pytest.raises(Exception, match="null or non-numeric feature or label"):
        parse(df, **data).select("features").collect()
    assert [r.label for r in parse(df, **data, onInvalid="skip").collect()] == [3.0]


def test_scoring_side_needs_no_label(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, a double")
    rows = parse(df, with_label=False, features=["a"], label="missing_column", keep=["id"])
    assert rows.columns == ["id", "features"]
    assert parse(df, with_label=False, features=["a"], label="label", keep=["id"]).count() == 1


def test_ratings(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 5, 3.0), (2, 5, 1.0)], "u bigint, i bigint, r double")
    setting = {"user": "u", "item": "i", "rating": "r"}
    plain = parse(df, ratings=setting)
    assert plain.dtypes == [("user", "int"), ("item", "int"), ("rating", "double")] and plain.count() == 3
    summed = parse(df, ratings={**setting, "aggregate": True})
    assert sorted(map(tuple, summed.collect())) == [(1, 5, 5.0), (2, 5, 1.0)]
    too_big = spark.createDataFrame([(2**40, 5, 2.0)], df.schema)
    with pytest.raises(Exception, match="non-integer user"):
        parse(too_big, ratings=setting).collect()


def test_filter_and_pruning_reach_the_scan(spark, sf_dir):
    df = load_source(spark, {"source": f"{sf_dir}/lineitem.parquet", "type": "parquet"})
    rows = parse(df, features=["l_quantity"], label="l_tax", filter="l_discount > 0.05")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_discount,0.05)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double>" in plan
    assert "Exchange" not in plan


def test_summed_ratings_combine_before_the_shuffle(spark):
    hot = spark.range(30_000).select(
        F.lit(7).alias("u"), (F.col("id") % 3).alias("i"), F.lit(1.0).alias("r")
    )
    rows = parse(hot, ratings={"user": "u", "item": "i", "rating": "r", "aggregate": True})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")
    assert sorted(map(tuple, rows.collect())) == [(7, 0, 10000.0), (7, 1, 10000.0), (7, 2, 10000.0)]


BROKEN = {"bad cell": "3|bad", "bad key": "x|3.5", "short": "4", "long": "5|6|7", "nan": "5|NaN", "infinite": "5|1e400"}


@pytest.mark.parametrize("way", BROKEN)
@pytest.mark.parametrize("condition", [None, "b > 0"])
def test_malformed_lines_fail_or_are_left_out(spark, way, condition):
    raw = spark.createDataFrame([("1|2.5",), (BROKEN[way],), ("2|",)], "value string")
    setting = {"schema": "a bigint, b double", "delimiter": "|", "keep": ["a"], **({"filter": condition} if condition else {})}
    with pytest.raises(Exception, match="malformed record"):
        apply_data_spec(raw, DataSpec.parse(setting), "TEXT").collect()
    left = apply_data_spec(raw, DataSpec.parse({**setting, "onInvalid": "skip"}), "TEXT")
    assert sorted(r.a for r in left.collect()) == ([1] if condition else [1, 2])


@pytest.mark.parametrize("cell", ["bad,3", "1,2,3", "1"])
@pytest.mark.parametrize("condition", ["true", "a > 0"])
def test_malformed_csv_fails(spark, tmp_path, cell, condition):
    (tmp_path / "t.csv").write_text(f"a,b\n1,2\n{cell}\n")
    source = {"source": str(tmp_path), "type": "csv", "schema": "a int, b int"}
    with pytest.raises(Exception, match="(?i)malformed"):
        load_source(spark, source).where(condition).collect()
    assert load_source(spark, {**source, "options": {"mode": "DROPMALFORMED"}}).where(condition).collect() == [(1, 2)]


def test_nan_is_no_feature_label_or_rating(spark):
    rows = spark.createDataFrame([(1.0, [1.0]), (float("nan"), [1.0]), (1.0, [float("inf")])], "y double, x array<double>")
    setting = {"label": "y", "features": ["x"], "onInvalid": "skip"}
    assert apply_data_spec(rows, DataSpec.parse(setting)).count() == 1
    ratings = {"ratings": {"user": "1", "item": "1", "rating": "y"}, "onInvalid": "skip"}
    assert apply_data_spec(rows, DataSpec.parse(ratings)).count() == 2


def test_pairs_become_rows_in_the_jvm(spark, tmp_path):
    spark.sparkContext.parallelize([(1, "a"), (2, "b")]).saveAsSequenceFile(f"{tmp_path}/s")
    rows = load_source(spark, {"source": f"{tmp_path}/s", "type": "sequence"})
    assert sorted(rows.collect()) == [(1, "a"), (2, "b")]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "k").write_text("a\tb\tc\nno tab\n\t\n")
    form = "org.apache.hadoop.mapred.KeyValueTextInputFormat"
    pairs = load_source(spark, {"source": f"{tmp_path}/k", "type": "hadoop", "inputFormat": form})
    assert sorted(pairs.collect()) == [("", ""), ("a", "b\tc"), ("no tab", "")]


def test_braces_hold_a_path_together(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(name)
    assert sorted(r.value for r in load_source(spark, {"source": f"{tmp_path}/{{a,b}}.txt", "type": "text"}).collect()) == ["a", "b"]


def test_new_interface_of_hadoop(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ab\ncde\n")
    setting = {"source": str(tmp_path), "type": "hadoop"}
    rows = load_source(spark, {**setting, "inputFormat": "org.apache.hadoop.mapreduce.lib.input.TextInputFormat"})
    assert sorted(map(tuple, rows.collect())) == [(0, "ab"), (3, "cde")]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="Unknown input format"):
        load_source(spark, {**setting, "inputFormat": "org.example.Missing"})
    path = f"{tmp_path}/seq"
    spark.sparkContext.parallelize([(1, 2.5), (2, 3.5)], 2).saveAsSequenceFile(path)
    kinds = {"keyClass": "org.apache.hadoop.io.IntWritable", "valueClass": "org.apache.hadoop.io.DoubleWritable", "schema": "key int, value double"}
    form = "org.apache.hadoop.mapreduce.lib.input.SequenceFileInputFormat"
    assert sorted(map(tuple, load_source(spark, {**setting, **kinds, "source": path, "inputFormat": form}).collect())) == [(1, 2.5), (2, 3.5)]
