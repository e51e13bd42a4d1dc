from __future__ import annotations

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainscore.functions import (
    area_under_roc,
    classification_by_class,
    classification_metrics,
    clustering_metrics,
    confusion,
    regression_metrics,
)
from trainscore.operators import (
    drop_sides,
    keyed_split,
    random_split,
    row_split,
    save_indicator,
    current_model,
    save_model,
    save_predictions,
    topn,
    with_row_key,
)
from trainscore import storage
from trainscore.storage import delete_path, fresh_path, path_exists


def ids(df):
    return sorted(r[0] for r in df.collect())


# -- split -------------------------------------------------------------------


@pytest.mark.parametrize("weights, share", [((0.7, 0.3), 0.7), ((0.5, 0.3), 0.625), ((0.01, 0.99), 0.01)])
def test_keyed_split_follows_the_hash(spark, weights, share):
    split = keyed_split(spark.range(2000), ["id"], weights)
    bits = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i in range(2000)}
    assert ids(split.train) == [i for i in range(2000) if bits[i] < share * 2**32]
    assert ids(split.verify) == [i for i in range(2000) if not bits[i] < share * 2**32]


def test_keyed_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    one = keyed_split(df.repartition(1), ["id"], (0.7, 0.3))
    many = keyed_split(df.repartition(7), ["id"], (0.7, 0.3))
    assert ids(one.train) == ids(many.train)
    other = keyed_split(df, ["id"], (0.7, 0.3), seed=1)
    assert ids(other.train) != ids(one.train)


def test_keyed_split_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "a int, b int")
    split = keyed_split(df, ["a"], (0.5, 0.5))
    assert split.train.count() + split.verify.count() == 3


def test_random_split_is_whole_and_disjoint(spark):
    df = spark.range(5000).repartition(5)
    split = random_split(df, (0.6, 0.4), seed=3)
    train, verify = ids(split.train), ids(split.verify)
    assert sorted(train + verify) == list(range(5000))
    assert abs(len(train) - 3000) < 5 * math.sqrt(5000 * 0.24)
    assert split.train.dtypes == df.dtypes
    assert path_exists(spark, split.staged)
    drop_sides(split)
    assert not path_exists(spark, split.staged)


def test_random_split_parts_read_their_own_files(spark):
    split = random_split(spark.range(100), (0.5, 0.5))
    plan = split.train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__side" in plan
    drop_sides(split)


def test_rows_are_split_by_their_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    # Every row is a copy of every other.
    spark.range(4000).selectExpr("7 as v").repartition(4).write.parquet(path)
    scan = spark.read.parquet(path)
    split = row_split(with_row_key(scan), (0.6, 0.4), seed=5)
    n_train, n_verify = split.train.count(), split.verify.count()
    assert n_train + n_verify == 4000 and abs(n_train - 2400) < 5 * math.sqrt(4000 * 0.24)
    assert split.train.columns == ["v"] and split.staged is None
    again = row_split(with_row_key(scan.repartition(1).sparkSession.read.parquet(path)), (0.6, 0.4), seed=5)
    assert again.train.count() == n_train
    assert "Exchange" not in split.train._jdf.queryExecution().executedPlan().toString()


def test_verify_weight_zero(spark):
    df = spark.range(10)
    for split in (random_split(df, (1.0, 0)), keyed_split(df, ["id"], (0.5, 0))):
        assert split.train is df and split.verify is df and split.staged is None
        drop_sides(split)


# -- metrics -----------------------------------------------------------------


def test_regression_metrics_count_what_was_not_scored(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, float("nan")), (7.0, None)], "label double, prediction double")
    m = regression_metrics(df).first()
    assert (m.n, m.n_unscored, m.mae, m.rmse) == (2, 2, 0.5, math.sqrt(0.5))
    assert m.r2 == pytest.approx(1 - 1 / 2)
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert regression_metrics(constant).first().r2 is None


def test_classification_metrics(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 2)] + [(3, 0)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    assert confusion(df).count() == 5
    per_class = {r["class"]: r for r in classification_by_class(df).collect()}
    assert (per_class[0].precision, per_class[0].recall) == (5 / 6, 5 / 7)
    assert (per_class[2].n_actual, per_class[2].precision, per_class[2].recall, per_class[2].f1) == (0, 0.0, 0.0, 0.0)
    assert per_class[3].recall == 0.0
    m = classification_metrics(df).first()
    assert (m.n, m.accuracy) == (12, 8 / 12)
    assert m.recall == pytest.approx(m.accuracy)


def test_area_under_roc_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(float(rng.random() < 0.4), float(rng.randrange(6))) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    df = spark.createDataFrame(rows, "label double, score double")
    assert area_under_roc(df, score="score").first()[0] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


def test_clustering_metrics_with_one_cluster(spark):
    df = spark.createDataFrame([(0,), (0,)], "prediction int")
    assert tuple(clustering_metrics(df).first()) == (2, 1, None)


# -- sinks -------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_predictions_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 0.5), (2, -1.25)], "id bigint, prediction double")
    path = f"{tmp_path}/out"
    saved = save_predictions(df, path, fmt)
    assert saved.dtypes == df.dtypes and sorted(saved.collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="(?i)already exists"):
        save_predictions(df, path, fmt)
    assert save_predictions(df, path, fmt, "overwrite").count() == 2
    assert save_predictions(df, path, fmt, "append").count() == 4


def test_indicator_is_one_replaced_file(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    for n in (1, 2):
        save_indicator(spark.createDataFrame([(n,)], "n int").coalesce(1), spark, path)
    parts = list(Path(path).glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text().strip() == '{"n":2}'


def test_csv_and_json_give_back_what_was_written(spark, tmp_path):
    texts = ["", None, 'a "quoted", text', "two\nlines\r\n", "  outer ", "\\n", "x,y", '"', "NULL"]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, [0.5, None, float("inf"), 1e-300, 2.0, 3.0, 4.0, 5.0, 6.0]))]
    df = spark.createDataFrame(rows, "i int, t string, x double")
    for fmt in ("csv", "json"):
        assert sorted(map(tuple, save_predictions(df, f"{tmp_path}/{fmt}", fmt).collect())) == rows
    nan = save_predictions(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/nan", "json")
    assert math.isnan(nan.first()["x"])


def test_ties_at_the_last_place_go_to_the_smaller_item(spark):
    user = spark.createDataFrame([(1, [1.0, 0.0])], "id int, features array<float>")
    items = [(-2_000_000_000, [1.0, 0.0]), (5, [1.0, 3.0]), (2_000_000_000, [1.0, 1.0]), (7, [2.0, 0.0])]
    for order in (items, items[::-1]):
        frame = spark.createDataFrame(order, "id int, features array<float>").coalesce(1)
        got = topn.top_items(user, frame, 2, 1, 3).first()["recommendations"]
        assert [r.item for r in got] == [7, -2_000_000_000]


def test_own_model_is_overwritten_whole(spark, tmp_path):
    class Text:
        def __init__(self, text):
            self.text = text

        def save(self, spark, path):
            Path(path).mkdir()
            Path(path, "m").write_text(self.text)

    path = tmp_path / "model"
    save_model(spark, Text("one"), str(path))
    save_model(spark, Text("two"), str(path), overwrite=True)
    assert Path(current_model(spark, str(path)), "m").read_text() == "two" and [p.name for p in tmp_path.iterdir()] == ["model"]


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "label double, prediction double, rawPrediction double")
    assert classification_metrics(empty).first()["n"] == 0
    assert area_under_roc(empty).first()["area_under_roc"] is None


def test_model_without_save_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no save"):
        save_model(spark, object(), f"{tmp_path}/m")


def test_storage(spark):
    path = fresh_path(spark, "x")
    assert path != fresh_path(spark, "x") and not path_exists(spark, path)
    spark.range(1).write.parquet(path)
    assert path_exists(spark, path)
    delete_path(spark, path)
    assert not path_exists(spark, path)


def test_sizes_follow_the_source(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    spark.range(10_000).write.parquet(path)
    size = storage.stored_bytes(spark, [path])
    assert storage.stored_bytes(spark, ["jdbc:some://where", "a:b:c"]) == 0
    assert size > 10_000 and 0 < storage.stored_bytes(spark, [f"{path}/*.parquet", f"{tmp_path}/none"]) <= size
    partitions = lambda: spark.conf.get(storage.INITIAL_PARTITIONS, None)
    split = lambda: int(spark.conf.get(storage.SPLIT_BYTES).rstrip("b"))
    with storage.sized_for(spark, [path]):
        assert partitions() is None and split() == storage.DEFAULT_SPLIT_BYTES  # small data: as usual
    monkeypatch.setattr(storage, "STORED_BYTES_PER_PARTITION", 1000)
    with storage.sized_for(spark, [path]):
        assert int(partitions()) == math.ceil(size / 1000)
        with storage.sized_for(spark, [f"{tmp_path}/none"]):
            assert int(partitions()) == math.ceil(size / 1000)
        assert spark.range(100).groupBy("id").count().count() == 100
    monkeypatch.setattr(storage, "stored_bytes", lambda *_: 100 * 10**12)
    with storage.sized_for(spark, [path]):
        assert int(partitions()) == storage.MAX_SHUFFLE_PARTITIONS
        assert 256 * storage.MB < split() <= storage.MAX_SPLIT_BYTES
    assert partitions() is None and split() == storage.DEFAULT_SPLIT_BYTES


# -- top-N -------------------------------------------------------------------


@pytest.mark.parametrize("per_block", [(32_768, 32_768), (10, 7), (3, 100)])
def test_top_items_against_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(topn, "USERS_PER_BLOCK", per_block[0])
    rng = np.random.default_rng(1)
    users, items = rng.normal(size=(37, 5)).astype(np.float32), rng.normal(size=(23, 5)).astype(np.float32)
    frame = lambda m: spark.createDataFrame(
        [(i * 3, [float(x) for x in row]) for i, row in enumerate(m)], "id int, features array<float>"
    )
    got = {
        r.user: [(x.item, x.rating) for x in r.recommendations]
        for r in topn.top_items(frame(users), frame(items), 4, len(users), per_block[1]).collect()
    }
    scores = users @ items.T
    assert len(got) == len(users)
    for u, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda i: -row[i])[:4]
        assert [i for i, _ in got[u * 3]] == [i * 3 for i in best]
        assert [r for _, r in got[u * 3]] == pytest.approx([row[i] for i in best], rel=1e-5)


@pytest.mark.parametrize("many", [False, True])
def test_items_in_chunks_and_ties_between_them(spark, monkeypatch, many):
    monkeypatch.setattr(topn, "MIN_USERS_PER_BLOCK", 20)
    monkeypatch.setattr(topn, "ITEMS_PER_CHUNK", 900 if many else 10**6)
    monkeypatch.setattr(topn, "ITEMS_PER_STEP", 128)
    rng = np.random.default_rng(5)
    users, items = rng.integers(-4, 5, (60, 3)).astype(np.float32), rng.integers(-20, 21, (4000, 3)).astype(np.float32)
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id int, features array<float>")
    found = topn.top_items(frame(users), frame(items), 7, 60, 64)
    got = {r.user: [(x.item, x.rating) for x in r.recommendations] for r in found.collect()}
    scores = users @ items.T
    assert len(got) == 60
    for user, row in enumerate(scores):
        best = np.lexsort((np.arange(4000), -row))[:7]
        assert got[user] == [(i, row[i]) for i in best.tolist()]
    # A task rates one block of users with one chunk of items, however many items there are.
    assert ("collect_list" in found._jdf.queryExecution().toString()) == many


def test_chunks_are_larger_where_blocks_make_enough_tasks(spark, monkeypatch):
    monkeypatch.setattr(topn, "MIN_USERS_PER_BLOCK", 1)
    monkeypatch.setattr(topn, "USERS_PER_BLOCK", 2)
    monkeypatch.setattr(topn, "ITEMS_PER_CHUNK", 100)
    cores = spark.sparkContext.defaultParallelism
    frame = lambda n: spark.range(n).selectExpr("cast(id as int) id", "array(cast(id as float), float(1)) features")
    for n_users, cells in ((8 * cores, 4 * cores * 4), (2, 2 * 16)):
        found = topn.top_items(frame(n_users), frame(1600), 3, n_users, 16)
        assert f", {cells}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert [x.item for x in found.where("user = 1").first().recommendations] == [1599, 1598, 1597]


def test_top_items_with_fewer_items_than_asked(spark):
    user, item = (spark.createDataFrame([(1, [1.0, 2.0])], "id int, features array<float>") for _ in range(2))
    assert topn.top_items(user, item, 10, 1).select(F.size("recommendations")).collect() == [(1,)]


def counted(spark, rows, schema):
    """Rows of a source and the number of them that have been read."""
    read = spark.sparkContext.accumulator(0)

    def note(row):
        read.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(note), schema), read


@pytest.mark.parametrize("name, params, kind", [("LogisticRegression", {"areaUnderROC": True, "maxIter": 2}, "classification"), ("KMeans", {"k": 3, "seed": 1}, "clustering")])
def test_verifying_reads_its_rows_once(spark, name, params, kind):
    from trainscore.functions import apply_data_spec
    from trainscore.operators.estimators import MLAlgorithm, find_estimator
    from trainscore.plugins import read_parameter
    from trainscore.spec import DataSpec

    rows = [(float(i % 2), float(i % 10), float(i % 7)) for i in range(400)]
    data = DataSpec.parse({"features": ["a", "b"], **({"label": "y"} if kind == "classification" else {})})
    plain = apply_data_spec(spark.createDataFrame(rows, "y double, a double, b double"), data)
    algorithm = MLAlgorithm(find_estimator(name))
    model = algorithm.train(plain, read_parameter(params))
    source, read = counted(spark, rows, "y double, a double, b double")
    metrics = algorithm.verify(apply_data_spec(source, data), model).first()
    assert metrics.n == 400 and read.value == 400
    if kind == "classification":
        scored = model.transform(plain)
        assert metrics.area_under_roc == pytest.approx(area_under_roc(scored).first()[0])
        assert metrics.accuracy == pytest.approx(scored.where("label = prediction").count() / 400)


def test_long_items_spare_most_pairs(spark):
    rng = np.random.default_rng(3)
    users = rng.normal(size=(300, 6)).astype(np.float32)
    lengths = rng.pareto(1.5, 4000)[:, None] + 0.01
    items = (rng.normal(size=(4000, 6)) * lengths).astype(np.float32)
    items[10] = items[20] = items[30] = items[np.argmax(np.linalg.norm(items, axis=1))]
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id int, features array<float>")
    rated = spark.sparkContext.accumulator(0)
    got = {r.user: [x.item for x in r.recommendations] for r in topn.top_items(frame(users), frame(items), 5, 300, 50, rated).collect()}
    scores = users @ items.T
    for user in range(300):
        mine = np.array([np.float32(users[user : user + 1] @ items[i : i + 1].T)[0, 0] for i in got[user]])
        assert np.allclose(mine, np.sort(scores[user])[::-1][:5], rtol=1e-5)
    assert 0 < rated.value < 0.35 * users.shape[0] * items.shape[0]
