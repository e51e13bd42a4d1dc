"""The plugin contract: what a user writes to add an algorithm or a model.

An ``Algorithm`` trains: load -> parse -> train -> verify. A ``Scorer`` applies a
trained model: load_model -> load -> parse -> predict for tables, ``respond`` for
requests, unload at the end. Every step takes and returns DataFrames.
"""

from __future__ import annotations

import importlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .sources import load_source
from .spec import SourceSpec

# The shape of a request and of its answer.
REQUEST_SCHEMA = "request_id bigint, data string"
RESPONSE_SCHEMA = "request_id bigint, result string"
ERROR_PREFIX = "Exception:"


class Parameter:
    """A JSON setting whose meaning the plugin defines.

    Subclass it and override ``parse`` to give a setting a type of its own; it
    is shipped to the executors, so keep it picklable.
    """

    def __init__(self) -> None:
        self.values: dict[str, Any] = {}

    def parse(self, text: str) -> None:
        self.values = json.loads(text)
        if not isinstance(self.values, dict):
            raise ValueError("a parameter must be a JSON object")


class Algorithm(ABC):
    """Trains and verifies a model."""

    name: str = ""

    def check(self, data: Parameter, params: Parameter) -> None:
        """Raise ``ValueError`` for settings that cannot work; called before any data is read."""

    def load(self, spark: SparkSession, source: SourceSpec) -> DataFrame:
        """Raw rows of the source, for ``apply_data_spec``; override to read something else."""
        return load_source(spark, source, verdicts=True)

    @abstractmethod
    def parse(self, raw: DataFrame, data: Parameter, source_type: str) -> DataFrame:
        """Raw rows -> the shape ``train`` expects."""

    @abstractmethod
    def train(self, rows: DataFrame, params: Parameter) -> Any:
        """Fit and return the model: MLlib, or any object with ``save(spark, path)``."""

    @abstractmethod
    def verify(self, rows: DataFrame, model: Any) -> DataFrame | str:
        """Indicator of the model: a metrics row, or text (JSON preferred)."""


class Scorer(ABC):
    """Applies a model to tables and to requests.

    ``runs_jobs`` is True for a scorer whose answer needs Spark jobs of its own
    (joins, top-N) or whose plan a request can make fail; a stream then hands it one
    micro-batch at a time, and a request that makes it fail is answered with the failure.
    """

    name: str = ""
    runs_jobs: bool = False

    def __init__(self, parameter: dict[str, Any] | None = None) -> None:
        self.parameter = dict(parameter or {})

    @abstractmethod
    def load_model(self, spark: SparkSession, path: str) -> None:
        """Prepare everything needed for predicting."""

    def load(self, spark: SparkSession, source: SourceSpec) -> DataFrame:
        return load_source(spark, source, verdicts=True)

    @abstractmethod
    def parse(self, raw: DataFrame, data: Parameter, source_type: str) -> DataFrame:
        """Raw rows -> the shape ``predict`` expects; no label is needed."""

    @abstractmethod
    def predict(self, rows: DataFrame) -> DataFrame:
        """Parsed rows -> predictions."""

    def save(self, predictions: DataFrame, path: str, fmt: str, mode: str) -> DataFrame:
        """Write the predictions and return them as read back; override to save in another way."""
        from .operators.sinks import save_predictions

        return save_predictions(predictions, path, fmt, mode)

    @abstractmethod
    def respond(self, requests: DataFrame) -> DataFrame:
        """``request_id, data`` -> ``request_id, result``, one row per request."""

    def answer(self, spark: SparkSession, data: str) -> str:
        """The result for a single request."""
        from .operators.isolate import answered_apart

        return answered_apart(self, spark.createDataFrame([(0, data)], REQUEST_SCHEMA)).first()["result"]

    def unload(self) -> None:
        """Release resources, if any."""


_ALGORITHMS: dict[str, Callable[..., Algorithm]] = {}
_SCORERS: dict[str, Callable[..., Scorer]] = {}


def register_algorithm(name: str) -> Callable[[Callable[..., Algorithm]], Callable[..., Algorithm]]:
    def add(factory: Callable[..., Algorithm]) -> Callable[..., Algorithm]:
        _ALGORITHMS[name] = factory
        return factory

    return add


def register_scorer(name: str) -> Callable[[Callable[..., Scorer]], Callable[..., Scorer]]:
    def add(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        _SCORERS[name] = factory
        return factory

    return add


def import_class(dotted: str, base: type) -> type:
    """``package.module.Class`` as a class, checked to extend ``base``."""
    module, _, name = dotted.rpartition(".")
    if not module:
        raise ValueError(f"Unknown {base.__name__.lower()}: {dotted}")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as err:
        raise ValueError(f"Unknown {base.__name__.lower()}: {dotted} ({err})") from None
    if not (isinstance(found, type) and issubclass(found, base)):
        raise ValueError(f"{dotted} is not a {base.__name__}")
    return found


def resolve_algorithm(name: str) -> Algorithm:
    """A registered name, an estimator class of ``pyspark.ml``, or a plugin class."""
    from .operators.estimators import MLAlgorithm, find_estimator

    if name in _ALGORITHMS:
        return _ALGORITHMS[name]()
    estimator = find_estimator(name)
    if estimator is not None:
        return MLAlgorithm(estimator)
    return import_class(name, Algorithm)()


def resolve_scorer(name: str, parameter: dict[str, Any] | None = None) -> Scorer:
    """A registered name (``ml``, ``recommend``) or a plugin class."""
    from .operators import scorers  # noqa: F401  registers the built-in ones

    factory = _SCORERS.get(name) or import_class(name, Scorer)
    return factory(parameter)


def read_parameter(setting: Any, class_name: str | None = None) -> Parameter:
    """A setting (dictionary or JSON text) as the plugin's parameter object."""
    if isinstance(setting, Parameter):
        return setting
    parameter = (import_class(class_name, Parameter) if class_name else Parameter)()
    parameter.parse(setting if isinstance(setting, str) else json.dumps(setting))
    return parameter
