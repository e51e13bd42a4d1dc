"""Jobs have sessions of their own: what one sets, neither its caller nor another job sees."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from trainscore import run_batch, run_train, storage
from trainscore.functions import apply_data_spec
from trainscore.operators.scorers import ANSI
from trainscore.plugins import Algorithm, Scorer
from trainscore.spec import DataSpec

KEYS = (storage.INITIAL_PARTITIONS, storage.SPLIT_BYTES, ANSI)


def settings(spark):
    return {key: spark.conf.get(key, None) for key in KEYS}


class Meeting(Algorithm):
    """Sets ANSI its own way, waits for the other job, and notes what it sees then."""

    def __init__(self, ansi, barrier, caller):
        self.ansi, self.barrier, self.caller, self.seen = ansi, barrier, caller, {}

    def load(self, spark, source):
        spark.conf.set(ANSI, self.ansi)
        self.barrier.wait(60)
        self.seen["own"], self.seen["caller"] = settings(spark), settings(self.caller)
        self.barrier.wait(60)
        return spark.read.parquet(source.source)

    def parse(self, raw, data, source_type):
        return apply_data_spec(raw, DataSpec.parse(data.values))

    def train(self, rows, params):
        return rows.select(F.sum("x")).first()[0]

    def verify(self, rows, model):
        return rows.agg(F.count("*").alias("n"))


def test_two_jobs_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "STORED_BYTES_PER_PARTITION", 100)
    before = settings(spark)
    barrier = threading.Barrier(2)
    jobs, results = [], {}
    for name, rows, ansi in (("small", 200, "false"), ("large", 5000, "true")):
        spark.range(rows).withColumnRenamed("id", "x").write.parquet(f"{tmp_path}/{name}")
        algorithm = Meeting(ansi, barrier, spark)
        setting = {"appName": name, "algoClass": "meeting", "sourceParameter": {"source": f"{tmp_path}/{name}", "type": "parquet"}, "dataParameter": {"keep": ["x"]}, "algoParameter": {}}

        def run(name=name, setting=setting, algorithm=algorithm):
            results[name] = run_train(spark, setting, algorithm)

        jobs.append((threading.Thread(target=run), algorithm, ansi))
    for thread, *_ in jobs:
        thread.start()
    for thread, *_ in jobs:
        thread.join(120)
    sizes = []
    for _, algorithm, ansi in jobs:
        assert algorithm.seen["caller"] == before
        assert algorithm.seen["own"][ANSI] == ansi
        sizes.append(int(algorithm.seen["own"][storage.INITIAL_PARTITIONS]))
    assert sizes[0] < sizes[1]
    assert settings(spark) == before
    assert [results[n].metrics.first().n for n in ("small", "large")] == [200, 5000]


class Plain(Scorer):
    def load_model(self, spark, path):
        self.setting = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "3")

    def parse(self, raw, data, source_type):
        return raw

    def predict(self, rows):
        return rows

    def respond(self, requests):
        return requests


def test_results_belong_to_the_caller(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/rows")
    scorer = Plain()
    job = {"appName": "s", "modelClass": "plain", "modelPath": f"{tmp_path}", "sourceParameter": {"source": f"{tmp_path}/rows", "type": "parquet"}, "dataParameter": {}, "resultSavePath": f"{tmp_path}/scores"}
    run_batch(spark, job, scorer).createOrReplaceTempView("scores_of_the_caller")
    assert spark.sql("SELECT count(*) FROM scores_of_the_caller").first()[0] == 5
    assert scorer.setting == "8" and spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_a_job_starts_with_the_callers_settings(spark):
    mine = spark.newSession()
    mine.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    mine.conf.set("spark.own.setting", "7")
    own = storage.job_session(mine)
    assert own.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo" and own.conf.get("spark.own.setting") == "7"
    own.conf.set("spark.own.setting", "8")
    assert mine.conf.get("spark.own.setting") == "7"
    with pytest.raises(Exception):
        spark.conf.get("spark.own.setting")
