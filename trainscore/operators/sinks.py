"""Writers for models, indicators and predictions. Any path Spark can write to."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..spec import SINK_FORMATS
from ..storage import create_file, delete_path, names_in, path_exists

# What makes a CSV file give back the text that was written: line breaks, quotes,
# outer white space. Null has a mark of its own (U+2400), empty text is a quoted nothing; a text
# that is nothing but the mark cannot be told from null.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "lineSep": "\n",
    "escape": '"',
    "nullValue": "\u2400",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# A path that has been overwritten holds versions, and a marker for each that is complete.
VERSION = "version-"
COMMITTED = "_committed"


def _committed(spark: SparkSession, path: str) -> list[str]:
    """The complete versions under ``path``, oldest first."""
    present = set(names_in(spark, path))
    return sorted(name for name in names_in(spark, f"{path}/{COMMITTED}") if name in present) if COMMITTED in present else []


def current_model(spark: SparkSession, path: str) -> str:
    """Where the model saved at ``path`` lies: its latest complete version, or ``path`` itself."""
    path = path.rstrip("/")
    versions = _committed(spark, path)
    return f"{path}/{versions[-1]}" if versions else path


def _write_model(spark: SparkSession, model: Any, path: str) -> None:
    if isinstance(model, MLWritable):
        model.write().save(path)
    elif callable(getattr(model, "save", None)):
        model.save(spark, path)
    else:
        raise ValueError(f"{type(model).__name__} has no save(spark, path) method")


def save_model(spark: SparkSession, model: Any, path: str, *, overwrite: bool = False) -> None:
    """Save an MLlib model, or any object with ``save(spark, path)``.

    An existing model is an error unless ``overwrite`` is asked for. A model that takes another's place is
    written to a version folder under ``path`` and counts from the moment its marker exists, which is
    created in one step; whatever fails before leaves the old model, whatever fails after leaves the new one.
    The model that was in place stays for those who are reading it and goes with the next but one.
    """
    path = path.rstrip("/")
    if not (overwrite and path_exists(spark, path)):
        _write_model(spark, model, path)
        return
    before = _committed(spark, path)
    number = 1 + (int(before[-1].removeprefix(VERSION).split("-")[0]) if before else 0)
    version = f"{VERSION}{number:09d}-{uuid.uuid4().hex}"
    _write_model(spark, model, f"{path}/{version}")
    create_file(spark, f"{path}/{COMMITTED}/{version}")
    for name in before[:-1]:
        delete_path(spark, f"{path}/{COMMITTED}/{name}")
        delete_path(spark, f"{path}/{name}")
    if before:  # a model that was saved plainly has been out of use for one version
        for name in names_in(spark, path):
            if name != COMMITTED and not name.startswith(VERSION):
                delete_path(spark, f"{path}/{name}")


def save_indicator(metrics: DataFrame | str, spark: SparkSession, path: str) -> None:
    """Write the metrics as JSON, or a plugin's text as it is, replacing what was there."""
    if isinstance(metrics, str):
        text = spark.createDataFrame([(metrics,)], "value string").coalesce(1)
        text.write.mode("overwrite").text(path)
    else:
        metrics.write.mode("overwrite").json(path)


def save_predictions(
    predictions: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> DataFrame:
    """Write predictions and return them as read back from ``path``."""
    if fmt not in SINK_FORMATS:
        raise ValueError(f"Unsupported result format:{fmt}")
    predictions.write.format(fmt).mode(mode).options(**_options(fmt)).save(path)
    return read_predictions(predictions.sparkSession, predictions.schema, path, fmt)


def read_predictions(spark: SparkSession, schema: StructType, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).options(**_options(fmt)).schema(schema).load(path)


def _options(fmt: str) -> dict[str, str]:
    return CSV_OPTIONS if fmt == "csv" else {}
