"""The train job and the batch scoring job."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators.estimators import DISTRIBUTED_MODELS, MLAlgorithm, settled
from ..operators.sinks import current_model, read_predictions, save_indicator, save_model
from ..operators.split import (
    ROW_KEY,
    Split,
    drop_sides,
    keyed_split,
    random_split,
    row_split,
    with_row_key,
)
from ..plugins import Algorithm, Parameter, Scorer, read_parameter, resolve_algorithm, resolve_scorer
from ..spec import BatchSpec, TrainSpec
from ..storage import fresh_path, job_session, path_exists, ship_package, sized_for, working_storage

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class TrainResult:
    model: Any
    metrics: DataFrame


def add_plugin_code(spark: SparkSession, path: str | None) -> None:
    """Ship plugin code (a .py, .zip or .egg) to driver and executors."""
    if path:
        ship_package(spark)
        spark.sparkContext.addPyFile(path)


def _split(rows: DataFrame, spec: TrainSpec) -> Split:
    if spec.splitKey:
        return keyed_split(rows, spec.splitKey, spec.dataWeight, spec.seed)
    if set(ROW_KEY) <= set(rows.columns):
        return row_split(rows, spec.dataWeight, spec.seed)
    return random_split(rows, spec.dataWeight, spec.seed)


def _settled_indicator(caller: SparkSession, indicator: DataFrame) -> DataFrame:
    """The indicator, independent of the rows it was computed from: one row as a constant, more as a table."""
    rows = indicator.take(2)
    if len(rows) < 2:
        return caller.createDataFrame(rows, indicator.schema)
    path = fresh_path(caller, "indicator")
    indicator.write.parquet(path)
    return caller.read.schema(indicator.schema).parquet(path)


def _saved(spark: SparkSession, spec: TrainSpec, model: Any) -> Any:
    """The model once nothing that follows can lose it.

    It is saved before it is verified. A model that is data on the executors is read
    back from where it lies then, as the rows it was fitted on are about to go.
    """
    if spec.modelSavePath:
        save_model(spark, model, spec.modelSavePath, overwrite=spec.overwriteModel)
        return type(model).load(current_model(spark, spec.modelSavePath)) if isinstance(model, DISTRIBUTED_MODELS) else model
    return settled(spark, model) if isinstance(model, DISTRIBUTED_MODELS) else model


def _splits_by_row(spec: TrainSpec, algorithm: Algorithm, data: Parameter) -> bool:
    """No key is named, but the rows of a Parquet scan can be told by their place."""
    if spec.splitKey or spec.dataWeight[1] == 0 or spec.sourceParameter.type != "PARQUET":
        return False
    return isinstance(algorithm, MLAlgorithm) and algorithm.keeps_row_key(data)


def _fit_and_verify(
    caller: SparkSession, spark: SparkSession, spec: TrainSpec, algorithm: Algorithm, data: Parameter, params: Parameter
) -> tuple[Any, DataFrame | str]:
    raw = algorithm.load(spark, spec.sourceParameter)
    if _splits_by_row(spec, algorithm, data):
        raw = with_row_key(raw)
    rows = algorithm.parse(raw, data, spec.sourceParameter.type)
    if spec.persist:
        # On disk alone: what a fit holds in a task beside Spark's account would not push cached rows out of memory.
        rows.persist(StorageLevel.DISK_ONLY)
    split: Split | None = None
    try:
        split = _split(rows, spec)
        log.info("%s: training, weights %s", spec.app_name, spec.dataWeight)
        model = _saved(spark, spec, algorithm.train(split.train, params))
        indicator = algorithm.verify(split.verify, model)
        return model, indicator if isinstance(indicator, str) else _settled_indicator(caller, indicator)
    finally:
        if split is not None:
            drop_sides(split)
        if spec.persist:
            rows.unpersist()


def run_train(
    spark: SparkSession, setting: TrainSpec | dict[str, Any] | str, algorithm: Algorithm | None = None
) -> TrainResult:
    """load -> parse -> split -> train -> save model -> verify -> save indicator.

    Rows are scanned once per step and not cached by default: a pruned Parquet
    scan is cheaper than spilling a copy of a large table, and the iterative
    estimators cache what they iterate over themselves. ``persist`` caches the
    parsed rows, for sources that are slow to read or parse. The job has a session of its own.
    """
    spec, caller = TrainSpec.parse(setting), spark
    spark = job_session(caller)
    add_plugin_code(spark, spec.algoPluginPath)
    algorithm = algorithm or resolve_algorithm(spec.algoClass)
    data = read_parameter(spec.dataParameter, spec.dataParameterClass)
    params = read_parameter(spec.algoParameter, spec.algoParameterClass)

    algorithm.check(data, params)
    if isinstance(algorithm, MLAlgorithm):
        algorithm.check_split_key(data, spec.splitKey)
    if spec.modelSavePath and not spec.overwriteModel and path_exists(spark, spec.modelSavePath):
        raise ValueError(f"{spec.modelSavePath} already exists: ask for overwriteModel or name another path")

    with working_storage(spark), sized_for(spark, spec.sourceParameter.paths):
        model, metrics = _fit_and_verify(caller, spark, spec, algorithm, data, params)

    if spec.modelIndicatorSavePath:
        save_indicator(metrics, spark, spec.modelIndicatorSavePath)
    if isinstance(metrics, str):
        metrics = caller.createDataFrame([(metrics,)], "indicator string")
    log.info("%s: done", spec.app_name)
    return TrainResult(model, metrics)


def run_batch(
    spark: SparkSession, setting: BatchSpec | dict[str, Any] | str, scorer: Scorer | None = None
) -> DataFrame:
    """load model -> load -> parse -> predict and save -> unload.

    From scan to write this is one Spark plan; its failures are raised. Returns
    the saved predictions. The job has a session of its own.
    """
    spec, caller = BatchSpec.parse(setting), spark
    spark = job_session(caller)
    add_plugin_code(spark, spec.algoPluginPath)
    scorer = scorer or resolve_scorer(spec.modelClass, spec.modelParameter)
    data = read_parameter(spec.dataParameter, spec.dataParameterClass)
    try:
        scorer.load_model(spark, current_model(spark, spec.modelPath))
        with working_storage(spark), sized_for(spark, spec.sourceParameter.paths):
            raw = scorer.load(spark, spec.sourceParameter)
            rows = scorer.parse(raw, data, spec.sourceParameter.type)
            saved = scorer.save(scorer.predict(rows), spec.resultSavePath, spec.resultFormat, spec.resultMode)
            if type(scorer).save is Scorer.save:
                return read_predictions(caller, saved.schema, spec.resultSavePath, spec.resultFormat)
            return saved
    finally:
        scorer.unload()
