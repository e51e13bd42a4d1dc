"""Job settings: plain dictionaries (or JSON text) checked before any Spark work.

Every job is described by one dictionary. Unknown keys, missing mandatory keys
and bad values raise ``ValueError`` here, so a mistake costs no cluster time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

# The source types a setting may name.
SOURCE_TYPES = ("TEXT", "JSON", "CSV", "SEQUENCE", "OBJECT", "HADOOP", "WHOLE", "PARQUET", "PLUGIN")

# What a sink may write.
SINK_FORMATS = ("parquet", "json", "csv", "orc")
WRITE_MODES = ("errorifexists", "overwrite", "append", "ignore")

DEFAULT_WEIGHTS = (1.0, 0.0)


def as_mapping(setting: Any, what: str) -> dict[str, Any]:
    """Accept a setting as a dictionary or as JSON text."""
    if isinstance(setting, str):
        try:
            setting = json.loads(setting)
        except ValueError as err:
            raise ValueError(f"{what} is not valid JSON: {err}") from None
    if not isinstance(setting, Mapping):
        raise ValueError(f"{what} must be a JSON object, got {type(setting).__name__}")
    return dict(setting)


def check_keys(given: Mapping[str, Any], mandatory: set[str], optional: set[str], what: str) -> None:
    unknown = sorted(set(given) - mandatory - optional)
    if unknown:
        raise ValueError(f"Illegal option in {what}: {', '.join(unknown)}")
    missing = sorted(k for k in mandatory if given.get(k) is None)
    if missing:
        raise ValueError(f"Missing option in {what}: {', '.join(missing)}")


def _one_of(value: Any, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"Invalid {what}: {value!r}, expected one of {', '.join(allowed)}")
    return value


def _string_list(value: Any, what: str) -> tuple[str, ...]:
    items = [value] if isinstance(value, str) else list(value or ())
    if not all(isinstance(v, str) and v for v in items):
        raise ValueError(f"{what} must be a name or a list of names, got {value!r}")
    return tuple(items)


def _positive_int(value: Any, what: str) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{what} must be a positive integer, got {value!r}")
    return value


def _request_format(value: Any) -> str:
    """A file format, or the ``module.Class`` of a data source."""
    return value if isinstance(value, str) and "." in value else _one_of(value, SINK_FORMATS, "requestFormat")


def check_weights(weights: Any) -> tuple[float, float]:
    """Train weight in (0, 1], verify weight in [0, 1], their sum at most 1."""
    if isinstance(weights, Mapping):
        check_keys(weights, {"dataWeight"}, set(), "dataWeight")
        weights = weights["dataWeight"]
    if not isinstance(weights, (list, tuple)) or len(weights) != 2:
        raise ValueError(f"Invalid weight:{weights!r}, expected [train, verify]")
    pair = weights
    if any(isinstance(w, bool) or not isinstance(w, (int, float)) for w in pair):
        raise ValueError(f"Invalid weight:{pair!r}")
    train, verify = (float(w) for w in pair)
    if not (0 < train <= 1 and 0 <= verify <= 1 and train + verify <= 1):
        raise ValueError(f"Invalid weight:({train}, {verify})")
    return train, verify


def split_paths(source: str) -> list[str]:
    """Paths divided by commas; commas inside the braces of a glob belong to it."""
    paths, depth = [""], 0
    for ch in source:
        depth += (ch == "{") - (ch == "}" and depth > 0)
        if ch == "," and not depth:
            paths.append("")
        else:
            paths[-1] += ch
    return [p.strip() for p in paths if p.strip()]


@dataclass(frozen=True)
class SourceSpec:
    """Where the raw data lies and how to read it."""

    source: str
    type: str
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    inputFormat: str | None = None
    keyClass: str | None = None
    valueClass: str | None = None

    @classmethod
    def parse(cls, setting: Any) -> SourceSpec:
        if isinstance(setting, cls):
            return setting
        raw = as_mapping(setting, "sourceParameter")
        check_keys(
            raw,
            {"source", "type"},
            {"schema", "options", "inputFormat", "keyClass", "valueClass"},
            "sourceParameter",
        )
        kind = str(raw["type"]).upper()
        if kind not in SOURCE_TYPES:
            raise ValueError(f"Unsupported source type:{kind}")
        return cls(**{**raw, "source": str(raw["source"]), "type": kind, "options": dict(raw.get("options") or {})})

    @property
    def paths(self) -> list[str]:
        return split_paths(self.source)


@dataclass(frozen=True)
class DataSpec:
    """What the raw columns mean; see ``functions.parse`` for how it is applied."""

    column: str | None = None
    schema: str | None = None
    delimiter: str | None = None
    explode: bool = False
    columns: dict[str, str] = field(default_factory=dict)
    filter: str | None = None
    label: str | None = None
    features: tuple[str, ...] = ()
    ratings: dict[str, Any] | None = None
    keep: tuple[str, ...] = ()
    onInvalid: str = "error"
    rejectPath: str | None = None

    @classmethod
    def parse(cls, setting: Any) -> DataSpec:
        if isinstance(setting, cls):
            return setting
        raw = as_mapping(setting, "dataParameter")
        check_keys(raw, set(), set(cls.__dataclass_fields__), "dataParameter")
        ratings = raw.get("ratings")
        if ratings is not None:
            ratings = as_mapping(ratings, "ratings")
            check_keys(ratings, {"user", "item"}, {"rating", "aggregate"}, "ratings")
        if ratings and raw.get("features"):
            raise ValueError("dataParameter names both ratings and features")
        if raw.get("delimiter") and not raw.get("schema"):
            raise ValueError("dataParameter has a delimiter but no schema")
        if raw.get("explode") and (raw.get("delimiter") or not raw.get("schema")):
            raise ValueError("explode needs a schema and no delimiter")
        if (raw.get("onInvalid") == "reject") != (raw.get("rejectPath") is not None):
            raise ValueError("onInvalid reject and a rejectPath need each other")
        return cls(
            **{
                **raw,
                "explode": bool(raw.get("explode", False)),
                "columns": dict(raw.get("columns") or {}),
                "features": _string_list(raw.get("features"), "features"),
                "keep": _string_list(raw.get("keep"), "keep"),
                "ratings": ratings,
                "onInvalid": _one_of(raw.get("onInvalid", "error"), ("error", "skip", "reject"), "onInvalid"),
            }
        )


@dataclass(frozen=True)
class TrainSpec:
    appName: str
    algoClass: str
    sourceParameter: SourceSpec
    dataParameter: Any
    algoParameter: Any
    algoPluginPath: str | None = None
    dataParameterClass: str | None = None
    algoParameterClass: str | None = None
    dataWeight: tuple[float, float] = DEFAULT_WEIGHTS
    splitKey: tuple[str, ...] = ()
    seed: int = 0
    persist: bool = False
    modelSavePath: str | None = None
    modelIndicatorSavePath: str | None = None
    overwriteModel: bool = False

    @classmethod
    def parse(cls, setting: Any) -> TrainSpec:
        if isinstance(setting, cls):
            return setting
        raw = as_mapping(setting, "train settings")
        mandatory = {"appName", "algoClass", "sourceParameter", "dataParameter", "algoParameter"}
        check_keys(raw, mandatory, set(cls.__dataclass_fields__) - mandatory, "train settings")
        if raw.get("dataWeight") is None:
            raw.pop("dataWeight", None)
        elif isinstance(raw["dataWeight"], str):
            raw["dataWeight"] = as_mapping(raw["dataWeight"], "dataWeight")
        return cls(
            **{
                **raw,
                "sourceParameter": SourceSpec.parse(raw["sourceParameter"]),
                "dataWeight": check_weights(raw.get("dataWeight", DEFAULT_WEIGHTS)),
                "splitKey": _string_list(raw.get("splitKey"), "splitKey"),
                "seed": int(raw.get("seed", 0)),
            }
        )

    @property
    def app_name(self) -> str:
        """``<last part of the algorithm class>:<appName>``."""
        return f"{self.algoClass.split('.')[-1]}:{self.appName}"


@dataclass(frozen=True)
class BatchSpec:
    appName: str
    modelClass: str
    modelPath: str
    sourceParameter: SourceSpec
    dataParameter: Any
    resultSavePath: str
    algoPluginPath: str | None = None
    dataParameterClass: str | None = None
    modelParameter: dict[str, Any] = field(default_factory=dict)
    resultFormat: str = "parquet"
    resultMode: str = "errorifexists"

    @classmethod
    def parse(cls, setting: Any) -> BatchSpec:
        if isinstance(setting, cls):
            return setting
        raw = as_mapping(setting, "batch settings")
        mandatory = {"appName", "modelClass", "modelPath", "sourceParameter", "dataParameter", "resultSavePath"}
        check_keys(raw, mandatory, set(cls.__dataclass_fields__) - mandatory, "batch settings")
        return cls(
            **{
                **raw,
                "sourceParameter": SourceSpec.parse(raw["sourceParameter"]),
                "modelParameter": as_mapping(raw.get("modelParameter") or {}, "modelParameter"),
                "resultFormat": _one_of(raw.get("resultFormat", "parquet"), SINK_FORMATS, "resultFormat"),
                "resultMode": _one_of(raw.get("resultMode", "errorifexists"), WRITE_MODES, "resultMode"),
            }
        )

    @property
    def app_name(self) -> str:
        return self.appName


@dataclass(frozen=True)
class StreamSpec:
    """Where requests arrive, which model answers them, where answers go.

    ``maxFilesPerTrigger`` bounds one micro-batch, ``threadParallel`` spreads it
    over that many partitions per core, ``triggerInterval`` (``"10 seconds"``)
    keeps the query running; without it the query answers what is there and ends.
    """

    appName: str
    modelClass: str
    modelPath: str
    requestPath: str
    responsePath: str
    checkpointPath: str
    algoPluginPath: str | None = None
    modelParameter: dict[str, Any] = field(default_factory=dict)
    requestFormat: str = "json"
    requestOptions: dict[str, str] = field(default_factory=dict)
    responseFormat: str = "parquet"
    maxFilesPerTrigger: int | None = None
    threadParallel: int | None = None
    triggerInterval: str | None = None

    @classmethod
    def parse(cls, setting: Any) -> StreamSpec:
        if isinstance(setting, cls):
            return setting
        raw = as_mapping(setting, "stream settings")
        mandatory = {"appName", "modelClass", "modelPath", "requestPath", "responsePath", "checkpointPath"}
        check_keys(raw, mandatory, set(cls.__dataclass_fields__) - mandatory, "stream settings")
        _positive_int(raw.get("maxFilesPerTrigger"), "maxFilesPerTrigger")
        _positive_int(raw.get("threadParallel"), "threadParallel")
        return cls(
            **{
                **raw,
                "modelParameter": as_mapping(raw.get("modelParameter") or {}, "modelParameter"),
                "requestFormat": _request_format(raw.get("requestFormat", "json")),
                "requestOptions": dict(raw.get("requestOptions") or {}),
                "responseFormat": _one_of(raw.get("responseFormat", "parquet"), SINK_FORMATS, "responseFormat"),
            }
        )

    @property
    def app_name(self) -> str:
        return self.appName
