"""A plugin that uses no MLlib model: how far a value lies from the usual one.

Training keeps the mean and the standard deviation of ``value``; a prediction is
the distance from the mean in standard deviations. Refer to it by
``algoPluginPath`` (this file) and ``deviation_plugin.DeviationAlgorithm`` or
``deviation_plugin.DeviationScorer``.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscore.functions import apply_data_spec
from trainscore.operators.scorers import PandasScorer
from trainscore.plugins import Algorithm, Parameter
from trainscore.spec import DataSpec


class DeviationModel:
    def __init__(self, mean: float, deviation: float) -> None:
        self.mean = mean
        self.deviation = deviation

    def save(self, spark: SparkSession, path: str) -> None:
        row = spark.createDataFrame([(self.mean, self.deviation)], "mean double, deviation double")
        row.coalesce(1).write.mode("errorifexists").json(path)


class DeviationParameter(Parameter):
    """``{"population": true}`` divides by n, ``false`` by n - 1."""

    def parse(self, text: str) -> None:
        super().parse(text)
        self.population = bool(self.values.get("population", True))


class DeviationAlgorithm(Algorithm):
    name = "deviation"

    def parse(self, raw: DataFrame, data: Parameter, source_type: str) -> DataFrame:
        return apply_data_spec(raw, DataSpec.parse(data.values), source_type)

    def train(self, rows: DataFrame, params: DeviationParameter) -> DeviationModel:
        spread = F.stddev_pop if params.population else F.stddev_samp
        mean, deviation = rows.agg(F.avg("value"), spread("value")).first()
        return DeviationModel(mean, deviation)

    def verify(self, rows: DataFrame, model: DeviationModel) -> DataFrame:
        distance = F.abs(F.col("value") - model.mean) / model.deviation
        return rows.agg(F.count("value").alias("n"), F.avg(distance).alias("mean_distance"))


class DeviationScorer(PandasScorer):
    name = "deviation"
    result_schema = "deviation double"
    request_schema = "value double"

    def load_state(self, path: str, spark: SparkSession | None = None) -> Any:
        mean, deviation = spark.read.schema("mean double, deviation double").json(path).first()
        return {"mean": mean, "deviation": deviation}

    def predict_batch(self, state: Any, batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["value"] < 0).any():
            raise ValueError("value is negative")
        deviation = (batch["value"] - state["mean"]) / state["deviation"]
        error = batch["value"].isna().map({True: "value is missing", False: None})
        return pd.DataFrame({"deviation": deviation, "error": error})
