"""Scorers: MLlib models, top-N recommenders, and user code on pandas batches."""

from __future__ import annotations

import threading
import uuid
from abc import abstractmethod
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.clustering import LDAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.recommendation import ALSModel
from pyspark.ml.tuning import CrossValidatorModel, TrainValidationSplitModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import FeatureColumns, apply_data_spec
from ..plugins import ERROR_PREFIX, Parameter, Scorer, import_class, register_scorer
from ..spec import DataSpec, check_keys
from ..storage import metadata_below, ship_package
from .sinks import VERSION, current_model
from .topn import ITEMS_PER_PACK, packs, top_items

ROOTS = ("org.apache.spark.ml.", "pyspark.ml.")
# The modules a saved model's class may come from, those that may stand inside one, and the models of stages.
MODEL_MODULES = ("classification", "regression", "clustering", "recommendation")
INNER_MODULES = (*MODEL_MODULES, "feature", "evaluation", "fpm", "tuning")
JVM_INNER = "org.apache.spark.mllib."
TUNED = ("tuning.CrossValidatorModel", "tuning.TrainValidationSplitModel")
PIPELINES = ("PipelineModel", "pipeline.PipelineModel", "Pipeline", "pipeline.Pipeline")

# The request a model answers when no other shape is described.
DEFAULT_REQUEST = {"schema": "data array<double>", "features": ["data"]}

# In a worker process: the state that ``load_in_task`` has loaded.
_states: dict[tuple, Any] = {}

ANSI = "spark.sql.ansi.enabled"
_building = threading.RLock()  # the setting belongs to the session, which threads share
CORRUPT = "__corrupt"
REASON = "__reason"


def _below(class_name: str) -> str:
    """The class name without the root of MLlib's packages; empty for any other class."""
    return next((class_name.removeprefix(root) for root in ROOTS if class_name.startswith(root)), "")


def check_classes(spark: SparkSession, path: str) -> str:
    """The class of the saved model at ``path``; raises unless it and all that is saved inside it are MLlib's.

    Loading imports the classes that the metadata name, so every metadata folder of the tree is read before:
    stages of pipelines, best and sub-models of a tuning, the models of one-versus-rest. Only folders are listed.
    """
    class_name = DefaultParamsReader.loadMetadata(path, spark)["class"]
    below = _below(class_name)
    whole = below.startswith(tuple(f"{m}." for m in MODEL_MODULES)) or below in (*TUNED, *PIPELINES[:2])
    if not whole:
        raise ValueError(f"Refusing to load {class_name}: not an MLlib model class")
    for inner in metadata_below(spark, path, VERSION):
        name = DefaultParamsReader.loadMetadata(inner, spark)["class"]
        if name.startswith(JVM_INNER):
            continue  # read by the JVM's own model, never imported
        if not (_below(name).startswith(tuple(f"{m}." for m in INNER_MODULES)) or _below(name) in PIPELINES):
            raise ValueError(f"Refusing to load {class_name}: it holds {name}, which is not a class of MLlib")
    return class_name


def load_ml_model(spark: SparkSession, path: str) -> Model:
    """The saved MLlib model at ``path``, all its classes checked before it is loaded."""
    path = current_model(spark, path)
    class_name = check_classes(spark, path)
    return import_class(class_name.replace("org.apache.spark", "pyspark"), Model).load(path)


def is_composite(model: Model) -> bool:
    """Whether the model is made of stages, which may take any columns."""
    return isinstance(model, (PipelineModel, CrossValidatorModel, TrainValidationSplitModel))


def feature_count(model: Model) -> int | None:
    """How many features the model expects, where it says so."""
    if isinstance(model, OneVsRestModel):
        return feature_count(model.models[0])
    count = model.vocabSize() if isinstance(model, LDAModel) else getattr(model, "numFeatures", None)
    return int(count) if count is not None and int(count) >= 0 else None


def parse_requests(requests: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """Add the fields of the request's JSON; ``__corrupt`` says it was malformed."""
    record = T.StructType.fromDDL(schema)
    names = record.fieldNames()
    clash = sorted({"request_id", CORRUPT, REASON} & set(names))
    if clash:
        raise ValueError(f"request schema uses reserved names: {', '.join(clash)}")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    with_corrupt = T.StructType([*record.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = requests.select("request_id", F.from_json("data", with_corrupt, options).alias("__r"))
    malformed = F.col("__r").isNull() | F.col(f"__r.{CORRUPT}").isNotNull()
    fields = [F.col(f"__r.`{n}`").alias(n) for n in names]
    return parsed.select("request_id", malformed.alias(CORRUPT), *fields), names


@contextmanager
def built_with_ansi(spark: SparkSession, on: bool) -> Iterator[None]:
    """Expressions built here raise (or not) where a cast, a division or a sum fails.

    Whether an expression raises is fixed when it is built, so the setting need not last until it runs.
    """
    with _building:
        before = spark.conf.get(ANSI)
        spark.conf.set(ANSI, str(on).lower())
        try:
            yield
        finally:
            spark.conf.set(ANSI, before)


def _failure(reason: Column | str) -> Column:
    return F.concat(F.lit(ERROR_PREFIX), F.lit(reason) if isinstance(reason, str) else reason)


@register_scorer("ml")
class MLScorer(Scorer):
    """Any saved ``pyspark.ml`` model with a features column.

    Parameter: ``schema``, ``columns`` and ``features`` describe the request's
    JSON; ``outputs`` names vector results (``probability``, ``rawPrediction``)
    to answer beside the prediction.
    """

    name = "ml"

    def __init__(self, parameter: dict[str, Any] | None = None) -> None:
        super().__init__(parameter)
        check_keys(self.parameter, set(), {"schema", "columns", "features", "outputs"}, "modelParameter")
        self.outputs = list(self.parameter.get("outputs") or [])
        request = {k: v for k, v in self.parameter.items() if k != "outputs"}
        self.request = DataSpec.parse(request or DEFAULT_REQUEST)
        # Plain fields cannot fail; expressions can.
        fields = {f"`{n}`" for n in T.StructType.fromDDL(self.request.schema).fieldNames()} if self.request.schema else set()
        self.runs_jobs = bool(self.request.columns) or not all(f"`{e.strip('`')}`" in fields for e in self.request.features)
        self.model: Model | None = None

    def load_model(self, spark: SparkSession, path: str) -> None:
        self.model = load_ml_model(spark, path)
        self.runs_jobs = self.runs_jobs or is_composite(self.model)

    def parse(self, raw: DataFrame, data: Parameter, source_type: str) -> DataFrame:
        return apply_data_spec(raw, DataSpec.parse(data.values), source_type, with_label=False)

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows)
        columns = []
        for fld in scored.schema.fields:
            if not isinstance(fld.dataType, VectorUDT):
                columns.append(F.col(f"`{fld.name}`"))
            elif fld.name in self.outputs:
                columns.append(vector_to_array(fld.name).alias(fld.name))
        return scored.select(*columns)

    def respond(self, requests: DataFrame) -> DataFrame:
        """Bad requests are answered, not raised.

        What the model would fail on is found before it: such rows carry a row of
        zeros through the model and their reason beside it.
        """
        if isinstance(self.model, ALSModel):
            raise ValueError("an ALS model answers requests through the recommend scorer")
        if not self.request.schema or not (self.request.features or is_composite(self.model)):
            raise ValueError("modelParameter must give schema and features of a request")
        if not self.request.features:
            return self._respond_by_stages(requests)
        parsed, names = parse_requests(requests, self.request.schema)
        columns = self.request.columns
        # Without ANSI rules casts and divisions that fail give null, which has an answer of its own. Where all is
        # well the values are computed by ANSI rules, so that a sum beyond its type fails and is never a wrong number.
        with built_with_ansi(requests.sparkSession, False):
            asked = F.struct(*[F.col(f"`{n}`") for n in names]).alias("__request")
            loose = parsed.select("request_id", CORRUPT, asked, *[F.col(f"`{n}`") for n in names])
            if columns:
                loose = loose.withColumns({n: F.expr(sql) for n, sql in columns.items()})
            features = FeatureColumns(loose, self.request.features)
            loose = loose.select("request_id", CORRUPT, "__request", *features.parts)
        rows = loose.select("request_id", CORRUPT, features.complete.alias("__complete"), features.values.alias("__values"), "__request")
        if self.runs_jobs:
            complete = F.col("__complete")
            with built_with_ansi(requests.sparkSession, True):
                strict = rows.select("request_id", CORRUPT, "__complete", "__request.*")
                if columns:
                    strict = strict.withColumns({n: F.when(complete, F.expr(sql)) for n, sql in columns.items()})
                features = FeatureColumns(strict, self.request.features, complete)
                strict = strict.select("request_id", CORRUPT, "__complete", *features.parts)
            rows = strict.select("request_id", CORRUPT, "__complete", features.values.alias("__values"))

        size = feature_count(self.model)
        reason = F.when(F.col(CORRUPT), _failure("malformed request")).when(
            ~F.col("__complete"), _failure("missing or non-numeric feature")
        )
        if size is not None and size != features.size:
            got = F.size("__values").cast("string")
            reason = reason.when(
                F.size("__values") != size, _failure(F.concat(F.lit(f"expected {size} features, got "), got))
            )
        if self.model.hasParam("modelType") and self.model.getOrDefault("modelType") == "bernoulli":
            beyond = F.exists("__values", lambda v: ~v.isin(0.0, 1.0))
            reason = reason.when(beyond, _failure("features must be 0 or 1"))

        rows = rows.withColumn(REASON, reason)
        if is_composite(self.model):
            good = rows.where(F.col(REASON).isNull()).select("request_id", array_to_vector("__values").alias("features"))
            return self._results(good).unionByName(rows.where(F.col(REASON).isNotNull()).select("request_id", F.col(REASON).alias("result")))
        zeros = F.array_repeat(F.lit(0.0), size if size is not None else 1)
        safe = F.when(F.col(REASON).isNull(), F.col("__values")).otherwise(zeros)
        scored = self.model.transform(rows.select("request_id", REASON, array_to_vector(safe).alias("features")))
        fields = [F.col(c) for c in scored.columns if c == "prediction"]
        fields += [vector_to_array(o).alias(o) for o in self.outputs]
        return scored.select("request_id", F.coalesce(REASON, F.to_json(F.struct(*fields))).alias("result"))

    def _results(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows)
        fields = [F.col(c) for c in scored.columns if c == "prediction"] + [vector_to_array(o).alias(o) for o in self.outputs]
        return scored.select("request_id", F.to_json(F.struct(*fields)).alias("result"))

    def _respond_by_stages(self, requests: DataFrame) -> DataFrame:
        """Requests whose fields the stages of the model take as they are.

        What a stage refuses (a null, a label it has not seen) makes the plan fail and is answered one by one.
        """
        parsed, names = parse_requests(requests, self.request.schema)
        refused = parsed.where(CORRUPT).select("request_id", _failure("malformed request").alias("result"))
        with built_with_ansi(requests.sparkSession, True):
            asked = parsed.where(~F.col(CORRUPT)).select("request_id", *[F.col(f"`{n}`") for n in names])
            if self.request.columns:
                asked = asked.withColumns({n: F.expr(sql) for n, sql in self.request.columns.items()})
        return self._results(asked).unionByName(refused)

    def unload(self) -> None:
        self.model = None


@register_scorer("recommend")
class RecommendScorer(Scorer):
    """Top-N items for users, from a saved ALS model.

    Parameter: ``numItems`` (default 10). Tables need a ``user`` column, requests
    are ``{"user": id}``. A user the model has never seen gets no list: a null in
    tables, an error response for a request.
    """

    name = "recommend"
    runs_jobs = True

    def __init__(self, parameter: dict[str, Any] | None = None) -> None:
        super().__init__(parameter)
        check_keys(self.parameter, set(), {"numItems"}, "modelParameter")
        self.num_items = int(self.parameter.get("numItems", 10))
        if self.num_items < 1:
            raise ValueError("numItems must be positive")
        self.model: ALSModel | None = None
        self.items: DataFrame | None = None

    def load_model(self, spark: SparkSession, path: str) -> None:
        model = load_ml_model(spark, path)
        if not isinstance(model, ALSModel):
            raise ValueError(f"{type(model).__name__} does not recommend items")
        ship_package(spark)
        self.model = model
        self.n_users, self.n_items = model.userFactors.count(), model.itemFactors.count()
        # Packed once and kept: each micro-batch only sends the packs to its blocks of users.
        self.items = packs(model.itemFactors, ITEMS_PER_PACK).persist(StorageLevel.MEMORY_AND_DISK)

    def parse(self, raw: DataFrame, data: Parameter, source_type: str) -> DataFrame:
        return apply_data_spec(raw, DataSpec.parse(data.values), source_type, with_label=False)

    def recommend(self, rows: DataFrame, n_users: int) -> DataFrame:
        """``rows``, at most ``n_users`` users among them, with ``recommendations array<struct<item, rating>>`` added.

        Each distinct user is scored once, then joined back to all rows asking for
        it. The join is left to adaptive execution: it broadcasts the lists when
        they turn out small and splits a user who holds a large share of the rows.
        """
        factors = self.model.userFactors
        users = rows.select("user").distinct().join(factors, F.col("user") == F.col("id")).select("id", "features")
        lists = top_items(users, self.items, self.num_items, n_users, n_items=self.n_items)
        return rows.join(lists, "user", "left")

    def predict(self, rows: DataFrame) -> DataFrame:
        """A table may name every user of the model, so blocks are made for all."""
        return self.recommend(rows, self.n_users)

    def respond(self, requests: DataFrame) -> DataFrame:
        parsed, _ = parse_requests(requests, "user int")
        bad = F.col(CORRUPT) | F.col("user").isNull()
        # Requests without a user are answered on their own path, so they do not
        # meet under one null join key.
        reason = F.when(F.col(CORRUPT), _failure("malformed request")).otherwise(_failure("missing user"))
        refused = parsed.where(bad).select("request_id", reason.alias("result"))
        asked = parsed.where(~bad).select("request_id", "user")
        n_users = min(asked.select("user").distinct().count(), self.n_users)
        asked = self.recommend(asked, n_users)
        unknown = _failure(F.concat(F.lit("unknown user "), F.col("user").cast("string")))
        found = F.to_json(F.struct("user", "recommendations"))
        answered = asked.select(
            "request_id", F.when(F.col("recommendations").isNull(), unknown).otherwise(found).alias("result")
        )
        return answered.unionByName(refused)

    def unload(self) -> None:
        if self.items is not None:
            self.items.unpersist()
        self.model = self.items = None


class PandasScorer(Scorer):
    """Base for models that are plain Python: the model state meets Arrow batches.

    Implement ``load_state`` and ``predict_batch`` and set ``result_schema``. The
    state is broadcast once; for a large one set ``load_in_task``, and each worker
    process loads it from shared storage once.
    """

    result_schema: str = "prediction double"
    request_schema: str = DEFAULT_REQUEST["schema"]
    load_in_task: bool = False

    def __init__(self, parameter: dict[str, Any] | None = None) -> None:
        super().__init__(parameter)
        self._path: str | None = None
        self._loaded = ""
        self._state = None

    @abstractmethod
    def load_state(self, path: str, spark: SparkSession | None = None) -> Any:
        """The model at ``path`` as a picklable object; tasks call it without ``spark``."""

    @abstractmethod
    def predict_batch(self, state: Any, batch: pd.DataFrame) -> pd.DataFrame:
        """One batch of parsed rows -> the columns of ``result_schema``, row for row.

        A further column ``error`` may say, for each row, why it has no result.
        """

    def load_model(self, spark: SparkSession, path: str) -> None:
        ship_package(spark)
        self._path, self._loaded = path, uuid.uuid4().hex
        if not self.load_in_task:
            self._state = spark.sparkContext.broadcast(self.load_state(path, spark))

    def parse(self, raw: DataFrame, data: Parameter, source_type: str) -> DataFrame:
        return apply_data_spec(raw, DataSpec.parse(data.values), source_type, with_label=False)

    def _state_in_task(self) -> Any:
        if not self.load_in_task:
            return self._state.value
        # Once per worker process and loading of the model, not once per task.
        key = (type(self).__qualname__, self._path, self._loaded)
        if key not in _states:
            _states.clear()
            _states[key] = self.load_state(self._path)
        return _states[key]

    def _run(self, state: Any, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.reset_index(drop=True)
        out = self.predict_batch(state, batch).reset_index(drop=True)
        if len(out) != len(batch):
            raise ValueError(f"{len(out)} predictions for {len(batch)} rows")
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """All input columns beside the predicted ones; an error in a row is raised."""
        result = T.StructType.fromDDL(self.result_schema)
        schema = T.StructType([*rows.schema.fields, *result.fields])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = self._state_in_task()
            for batch in batches:
                out = self._run(state, batch)
                if "error" in out and out["error"].notna().any():
                    raise ValueError(out["error"].dropna().iloc[0])
                yield pd.concat([batch.reset_index(drop=True), out[result.names]], axis=1)

        return rows.mapInPandas(run, schema)

    def respond(self, requests: DataFrame) -> DataFrame:
        """Whatever is raised for a request answers that request.

        Batches are predicted whole. One that raises is halved until the request
        at fault stands alone, so the others keep their answer. Python returns
        columns; the JSON of the responses is written by Spark.
        """
        parsed, names = parse_requests(requests, self.request_schema)
        result = T.StructType.fromDDL(self.result_schema)
        fields = [T.StructField("request_id", T.LongType()), *result.fields, T.StructField(REASON, T.StringType())]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = self._state_in_task()

            def predict(rows: pd.DataFrame) -> list[pd.DataFrame]:
                try:
                    out = self._run(state, rows[names])
                    reasons = out["error"] if "error" in out else None
                except Exception as err:
                    if len(rows) > 1:
                        half = len(rows) // 2
                        return predict(rows.iloc[:half]) + predict(rows.iloc[half:])
                    out, reasons = pd.DataFrame(dict.fromkeys(result.names), index=[0]), str(err)
                ids = rows["request_id"].reset_index(drop=True)
                return [out[result.names].assign(request_id=ids, **{REASON: reasons})]

            for batch in batches:
                malformed = batch[CORRUPT]
                refused = batch.loc[malformed, ["request_id"]]
                if len(refused):
                    yield refused.assign(**dict.fromkeys(result.names), **{REASON: "malformed request"})
                if not malformed.all():
                    yield from predict(batch.loc[~malformed])

        answered = parsed.mapInPandas(run, T.StructType(fields))
        text = F.to_json(F.struct(*[F.col(f"`{n}`") for n in result.names]), {"ignoreNullFields": "false"})
        failed = F.when(F.col(REASON).isNotNull(), _failure(F.col(REASON)))
        return answered.select("request_id", F.coalesce(failed, text).alias("result"))

    def unload(self) -> None:
        if self._state is not None:
            self._state.unpersist()
            self._state = None
