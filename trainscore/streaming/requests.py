"""The streaming scoring job: request files in, response files out.

Each request is independent, so the query is stateless and append-only. The model
is loaded once, before the query starts.
"""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sinks import current_model
from ..operators.isolate import answered_apart, data_fault
from ..plans.jobs import add_plugin_code
from ..plugins import REQUEST_SCHEMA, Scorer, resolve_scorer
from ..sources.readers import registered_source
from ..spec import StreamSpec
from ..storage import job_session, path_exists


def read_requests(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    """Request files, or what a data source of one's own delivers, as a stream of ``request_id, data``."""
    options = dict(spec.requestOptions)
    if spec.maxFilesPerTrigger:
        options["maxFilesPerTrigger"] = str(spec.maxFilesPerTrigger)
    fmt = registered_source(spark, spec.requestFormat) if "." in spec.requestFormat else spec.requestFormat
    reader = spark.readStream.format(fmt).schema(REQUEST_SCHEMA).options(**options)
    requests = reader.load(spec.requestPath)
    if spec.threadParallel:
        # Round robin over all cores, for few large request files.
        requests = requests.repartition(spark.sparkContext.defaultParallelism * spec.threadParallel)
    return requests


def _save_each_batch(scorer: Scorer, spec: StreamSpec):
    """A replayed micro-batch overwrites its own folder, so it adds no rows.

    If some requests make the plan fail they are told apart, and their failure is their answer.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        def write(responses: DataFrame) -> None:
            responses.write.mode("overwrite").format(spec.responseFormat).save(f"{spec.responsePath}/batch={batch_id}")

        batch.persist()
        try:
            write(scorer.respond(batch))
        except (PySparkException, Py4JJavaError) as err:
            if data_fault(err) is None:
                raise
            write(answered_apart(scorer, batch))
        finally:
            batch.unpersist()

    return save


def start_stream(
    spark: SparkSession,
    setting: StreamSpec | dict[str, Any] | str,
    scorer: Scorer | None = None,
    requests: DataFrame | None = None,
) -> StreamingQuery:
    """Load the model and start answering; returns the running query.

    ``requests`` may be any stream of ``request_id, data``, such as one read from a
    message topic; it then takes the place of the files under ``requestPath``, and the
    query runs in its session. Otherwise it has a session of its own.
    """
    spec = StreamSpec.parse(setting)
    spark = job_session(spark) if requests is None else spark
    add_plugin_code(spark, spec.algoPluginPath)
    scorer = scorer or resolve_scorer(spec.modelClass, spec.modelParameter)
    scorer.load_model(spark, current_model(spark, spec.modelPath))
    if requests is None:
        requests = read_requests(spark, spec)

    if scorer.runs_jobs:
        if path_exists(spark, spec.responsePath) and not path_exists(spark, f"{spec.checkpointPath}/metadata"):
            raise ValueError(
                f"{spec.responsePath} holds responses but {spec.checkpointPath} is new: "
                "batch numbers would start again and overwrite them"
            )
        writer = requests.writeStream.foreachBatch(_save_each_batch(scorer, spec))
    else:
        writer = (
            scorer.respond(requests)
            .writeStream.format(spec.responseFormat)
            .outputMode("append")
            .option("path", spec.responsePath)
        )
    writer = writer.option("checkpointLocation", spec.checkpointPath).queryName(spec.appName)
    if spec.triggerInterval:
        writer = writer.trigger(processingTime=spec.triggerInterval)
    else:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_stream(
    spark: SparkSession, setting: StreamSpec | dict[str, Any] | str, scorer: Scorer | None = None
) -> None:
    """Answer requests until the query ends or is stopped, then unload the model."""
    spec = StreamSpec.parse(setting)
    scorer = scorer or resolve_scorer(spec.modelClass, spec.modelParameter)
    query = None
    try:
        query = start_stream(spark, spec, scorer)
        query.awaitTermination()
    finally:
        if query is not None:
            query.stop()
        scorer.unload()
