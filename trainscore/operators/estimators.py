"""One algorithm plugin for every estimator of ``pyspark.ml``."""

from __future__ import annotations

import atexit
import math
from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from py4j.protocol import Py4JError
from pyspark.ml import Estimator, Model, classification, clustering, recommendation, regression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import (
    classification_metrics,
    classification_with_roc,
    clustering_metrics,
    regression_metrics,
    score_counts,
    topic_metrics,
)
from ..functions.parse import apply_data_spec
from ..plugins import Algorithm, Parameter
from ..spec import DataSpec
from ..storage import delete_path, ensure_checkpoint_dir, fresh_path, working_path
from .split import ROW_KEY

ML_MODULES = (classification, regression, clustering, recommendation)

RATINGS_PER_BLOCK_PAIR = 25_000
# Each half-iteration sends a user's or item's factors once to every block that rates with it: with more blocks
# than a user has ratings, once for each rating. Up to this number blocks follow the square root of the ratings.
FACTOR_BLOCKS = 8
# Beyond, blocks are full.
RATINGS_PER_BLOCK = 32_000_000
# What a task of a fit may hold in objects that Spark does not count, so that it cannot spill them. Blocks that are
# much smaller would shuffle more.
TASK_BYTES = 576_000_000
# Bytes a rating while its block is built: as received, in three arrays that double (to 2**24 at 16 million), and copied.
BUILDING = 36
# Bytes a rating in a finished block.
BUILT = 8
# Bytes a rating that a fit keeps: in a pair of blocks, in a block of users and in one of items.
KEPT = 28

DISTRIBUTED_MODELS = (recommendation.ALSModel, clustering.DistributedLDAModel)

ROC = "areaUnderROC"


def find_estimator(name: str) -> type[Estimator] | None:
    """``LinearRegression`` or ``pyspark.ml.regression.LinearRegression`` as a class."""
    module_name, _, class_name = name.rpartition(".")
    for module in ML_MODULES:
        if module_name in ("", module.__name__) and class_name in module.__all__:
            found = getattr(module, class_name)
            if isinstance(found, type) and issubclass(found, Estimator):
                return found
    return None


def configure(estimator_class: type[Estimator], params: dict[str, Any]) -> Estimator:
    """An estimator with ``params`` set; an unknown name lists the valid ones.

    A value ``{"algoClass": ..., "algoParameter": {...}}`` is itself an estimator,
    as ``OneVsRest`` wants for its classifier.
    """
    estimator = estimator_class()
    unknown = sorted(k for k in params if not estimator.hasParam(k))
    if unknown:
        valid = ", ".join(sorted(p.name for p in estimator.params))
        raise ValueError(
            f"Unknown parameter of {estimator_class.__name__}: {', '.join(unknown)}; valid are {valid}"
        )
    return estimator.copy({estimator.getParam(k): _typed(estimator, k, v) for k, v in params.items()})


def _typed(estimator: Estimator, name: str, value: Any) -> Any:
    if isinstance(value, dict) and "algoClass" in value:
        inner = find_estimator(value["algoClass"])
        if inner is None:
            raise ValueError(f"Unknown algorithm: {value['algoClass']}")
        return configure(inner, value.get("algoParameter") or {})
    return estimator.getParam(name).typeConverter(value)


def als_blocks(n_ratings: int) -> int:
    """Factor blocks that follow the data: the same model on every cluster.

    Users and items are cut into so many blocks each, and ratings into pairs of blocks. The factors that are
    shuffled grow with the users and items, times the blocks; so their number stays the same until blocks are full.
    """
    wanted = math.ceil(math.sqrt(n_ratings / RATINGS_PER_BLOCK_PAIR))
    return max(1, min(wanted, FACTOR_BLOCKS), math.ceil(n_ratings / RATINGS_PER_BLOCK))


def factor_blocks(n_ratings: int, n_users: int, n_items: int, rank: int) -> tuple[int, int]:
    """Blocks of users and blocks of items: ``als_blocks``, or more where a task could not hold one in ``TASK_BYTES``.

    A task holds the ratings of its block while it builds it. While it solves it, it holds the built block and the factors
    of all that the block rates, which are no more than its ratings and no more than there are.
    """
    factors = 20 + 4 * rank

    def blocks(n_others: int) -> int:
        solved = max(TASK_BYTES / (BUILT + factors), (TASK_BYTES - n_others * factors) / BUILT)
        return max(als_blocks(n_ratings), math.ceil(n_ratings / min(TASK_BYTES / BUILDING, solved)))

    return blocks(n_items), blocks(n_users)


def size_als(estimator: recommendation.ALS, rows: DataFrame, given: dict[str, Any]) -> None:
    """Blocks that follow the data, and a fit of many ratings that keeps them on disk; what is ``given`` stays as it is.

    What lies in memory on Spark's account does not yield to what a task builds beside it. A checkpoint in each
    iteration lets the shuffles of the one before go.
    """
    if {"numUserBlocks", "numItemBlocks"} <= given.keys():
        return
    users, items = (F.approx_count_distinct(c) for c in (estimator.getUserCol(), estimator.getItemCol()))
    n_ratings, n_users, n_items = rows.agg(F.count(F.lit(1)), users, items).first()
    wanted = dict(zip(("numUserBlocks", "numItemBlocks"), factor_blocks(n_ratings, n_users, n_items, estimator.getRank()), strict=True))
    if n_ratings * KEPT > TASK_BYTES:
        wanted |= {"intermediateStorageLevel": "DISK_ONLY", "finalStorageLevel": "DISK_ONLY", "checkpointInterval": 1}
    for name, value in wanted.items():
        if name not in given:
            estimator.set(estimator.getParam(name), value)


def settled(spark: SparkSession, model: Model) -> Model:
    """The model as written to the shared folder and read back.

    Some models are data on the executors, computed from the training rows. If one
    of those executors is lost after the job has dropped its split table or cache,
    that data must not have to be computed again. The copy goes when the driver ends.
    """
    path = fresh_path(spark, "model")
    model.save(path)
    atexit.register(_forget, spark, path)
    return type(model).load(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the session is gone


def _once(rows: DataFrame) -> DataFrame:
    """Rows that several passes need, written by the one pass that scores."""
    path = working_path(rows.sparkSession, "scored")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class MLAlgorithm(Algorithm):
    """Fits one ``pyspark.ml`` estimator and verifies it by its kind's metrics.

    Beside the estimator's own parameters, ``areaUnderROC: true`` adds that metric
    for a classifier of two classes; it sorts the distinct scores, so it is asked for.
    """

    def __init__(self, estimator_class: type[Estimator]) -> None:
        self.estimator_class = estimator_class
        self.name = estimator_class.__name__
        self.kind = estimator_class.__module__.rpartition(".")[2]
        self.with_roc = False

    def _estimator(self, params: Parameter) -> Estimator:
        return configure(self.estimator_class, {k: v for k, v in params.values.items() if k != ROC})

    def _parses_as_usual(self) -> bool:
        return type(self).parse is MLAlgorithm.parse

    def check(self, data: Parameter, params: Parameter) -> None:
        if self._parses_as_usual():
            DataSpec.parse(data.values)
        self._estimator(params)
        if params.values.get(ROC) and self.kind != "classification":
            raise ValueError(f"{ROC} needs a classifier, not {self.name}")

    def parse(self, raw: DataFrame, data: Parameter, source_type: str) -> DataFrame:
        spec = DataSpec.parse(data.values)
        if set(ROW_KEY) <= set(raw.columns) and (spec.keep or spec.features or spec.ratings):
            spec = replace(spec, keep=(*spec.keep, *ROW_KEY))
        return apply_data_spec(raw, spec, source_type)

    def check_split_key(self, data: Parameter, keys: Sequence[str]) -> None:
        """Rows are divided after parsing: the key must be a column that parsing leaves."""
        if not keys or not self._parses_as_usual():
            return
        spec = DataSpec.parse(data.values)
        if not (spec.keep or spec.features or spec.ratings):
            return
        summed = (spec.ratings or {}).get("aggregate")
        left = {"user", "item"} if summed else {*spec.keep, *(("user", "item") if spec.ratings else ("label",))}
        lost = [k for k in keys if k not in left]
        if lost:
            raise ValueError(f"splitKey must be among the columns to keep: {', '.join(lost)}")

    def keeps_row_key(self, data: Parameter) -> bool:
        """Whether each parsed row stands for one row of the source, read the usual way."""
        if type(self).load is not Algorithm.load or not self._parses_as_usual():
            return False
        spec = DataSpec.parse(data.values)
        return not spec.explode and not (spec.ratings or {}).get("aggregate")

    def train(self, rows: DataFrame, params: Parameter) -> Model:
        spark = rows.sparkSession
        self.with_roc = bool(params.values.get(ROC))
        estimator = self._estimator(params)
        if estimator.hasParam("checkpointInterval"):
            ensure_checkpoint_dir(spark)
        if isinstance(estimator, recommendation.ALS):
            size_als(estimator, rows, params.values)
        return estimator.fit(rows)

    def verify(self, rows: DataFrame, model: Any) -> DataFrame:
        if isinstance(model, clustering.LDAModel):
            return topic_metrics(rows, model)
        scored = model.transform(rows)
        if self.kind == "classification":
            return classification_with_roc(_once(score_counts(scored))) if self.with_roc else classification_metrics(scored)
        if self.kind == "clustering":
            return clustering_metrics(_once(scored.select("features", "prediction")))
        if self.kind == "recommendation":
            return regression_metrics(scored, label="rating")
        return regression_metrics(scored)
