"""From raw rows to model input, driven by a ``DataSpec``.

The steps are one chain of projections and filters that Catalyst folds into the
scan: ``filter`` reaches the Parquet reader, and columns that neither the model
nor ``keep`` needs are never read. The only shuffle is the optional sum of
repeated (user, item) pairs.

Steps, each optional:

1. ``schema`` (+ ``delimiter`` or ``explode``): text column -> typed record fields
2. ``columns``: derived columns as SQL expressions
3. ``filter``: SQL condition
4. ``features`` / ``label``: -> ``features vector, label double``
   or ``ratings``: -> ``user int, item int, rating double``
5. ``keep``: columns passed through beside the model input

Records that cannot be used fail the job (``onInvalid: error``), are left out (``skip``), or are written
with their file, text and reason to ``rejectPath`` (``reject``); ``records`` has the rule.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DataSpec
from ..storage import working_path
from .records import CORRUPT, PATH, REASON, TEXT, all_of, finite, judged, kept, quoted, sound_cells

REJECTED = "__rejected"


def parse_records(df: DataFrame, data: DataSpec, source_type: str) -> DataFrame:
    """Turn the raw text column into the record fields of ``data.schema``."""
    return kept(judged(df, data, source_type), data.onInvalid)


class FeatureColumns:
    """Feature expressions, each a number, an array of numbers or an ML vector.

    ``parts`` are the typed columns to select under their names; ``values`` joins
    them to one ``array<double>`` and ``complete`` says that all of it is finite numbers.
    Scalars are tested one by one, which stays inside generated code.
    """

    def __init__(self, df: DataFrame, features: tuple[str, ...], when: Column | None = None) -> None:
        """``when``: rows for which the expressions are not to be evaluated get nulls."""
        names = [f"__f{i}" for i in range(len(features))]
        types = df.select(*[F.expr(e).alias(n) for e, n in zip(features, names, strict=True)]).schema.fields
        self.parts: list[Column] = []
        tests: list[Column] = []
        arrays: list[Column] = []
        scalars: list[str] = []
        for expression, fld in zip(features, types, strict=True):
            column, name, kind = F.expr(expression), fld.name, fld.dataType
            column = column if when is None else F.when(when, column)
            tests.append(F.col(name).isNotNull())
            if not isinstance(kind, (VectorUDT, T.ArrayType)):
                self.parts.append(column.try_cast("double").alias(name))
                tests.append(finite(F.col(name)))
                scalars.append(name)
                continue
            if scalars:
                arrays.append(F.array(*scalars))
                scalars = []
            arrays.append(F.col(name))
            if isinstance(kind, VectorUDT):
                self.parts.append(F.when(column.isNotNull(), vector_to_array(column)).alias(name))
            else:
                self.parts.append(column.try_cast("array<double>").alias(name))
            tests.append(F.forall(name, lambda v: F.coalesce(finite(v), F.lit(False))))
        if scalars:
            arrays.append(F.array(*scalars))
        self.values = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
        self.size = len(features) if len(scalars) == len(features) else None
        self.complete = F.coalesce(all_of(tests), F.lit(False))


class Inputs(NamedTuple):
    """Model input before its check: ``rows`` with ``__valid``, a column that every model reads, what a failing row lacks."""

    rows: DataFrame
    guard: str
    what: str


def _check_rows(inputs: Inputs, on_invalid: str) -> DataFrame:
    """Drop rows that are not ``__valid`` (``skip``) or fail on the first one (``error``).

    The failing branch sits in the projection of ``guard``, a column every model
    reads, so pruning cannot remove the check.
    """
    df, guard, what = inputs
    if on_invalid == "skip":
        return df.where("__valid").drop("__valid")
    fail = F.raise_error(F.lit(what)).cast(df.schema[guard].dataType)
    return df.withColumn(guard, F.when(F.col("__valid"), F.col(guard)).otherwise(fail)).drop("__valid")


def _as_text(df: DataFrame, expressions: dict[str, str], good: Column | None) -> list[Column]:
    """In a traced parse, the text of a record that was none before: its inputs as JSON."""
    if good is None:
        return []
    kinds = df.select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(expressions.values())]).schema.fields
    values = [F.when(good, vector_to_array(F.expr(e)) if isinstance(f.dataType, VectorUDT) else F.expr(e)) for e, f in zip(expressions.values(), kinds, strict=True)]
    whole = F.to_json(F.struct(*[v.alias(name) for name, v in zip(expressions, values, strict=True)]), {"ignoreNullFields": "false"})
    return [F.col(PATH), F.col(REASON), F.coalesce(F.col(TEXT), whole).alias(TEXT)]


def _labeled(df: DataFrame, data: DataSpec, with_label: bool, good: Column | None = None) -> Inputs:
    features = FeatureColumns(df, data.features, good)
    with_label = with_label and data.label is not None
    keep = [quoted(c) for c in data.keep if c != "features" and not (with_label and c == "label")]
    target = F.expr(data.label) if with_label else None
    label = [(target if good is None else F.when(good, target)).try_cast("double").alias("label")] if with_label else []
    named = {**({"label": data.label} if with_label else {}), **{e: e for e in data.features}}
    trace = _as_text(df, named, good)
    picked = df.select(*keep, *trace, *label, *features.parts)

    valid = features.complete
    if with_label:
        valid = valid & F.coalesce(finite(F.col("label")), F.lit(False))
    others = [*keep, *([PATH, REASON, TEXT] if trace else []), *(["label"] if with_label else [])]
    rows = picked.select(*others, features.values.alias("__features"), valid.alias("__valid"))
    return Inputs(rows, "__features", "null or non-numeric feature or label")


def _as_vectors(rows: DataFrame, data: DataSpec, size: int | None) -> DataFrame:
    # The known vector size spares estimators a job that looks for it.
    metadata = {"ml_attr": {"num_attrs": size}} if size else None
    others = [quoted(c) for c in rows.columns if c != "__features"]
    return rows.select(*others, array_to_vector("__features").alias("features", metadata=metadata))


def _ratings(df: DataFrame, data: DataSpec, with_label: bool, good: Column | None = None) -> Inputs:
    setting = data.ratings or {}
    with_rating = with_label and setting.get("rating") is not None
    kinds = {"user": "int", "item": "int", **({"rating": "double"} if with_rating else {})}
    columns = []
    for name, kind in kinds.items():
        value = F.expr(setting[name])
        columns.append((value if good is None else F.when(good, value)).try_cast(kind).alias(name))
    keep = [quoted(c) for c in data.keep if c not in ("user", "item", "rating")]
    if _sums(data, with_label) and keep:
        raise ValueError("ratings cannot be both aggregated and kept beside other columns")
    picked = df.select(*keep, *_as_text(df, {n: setting[n] for n in kinds}, good), *columns)

    tests = [F.col(c).isNotNull() for c in kinds]
    if with_rating:
        tests.append(F.coalesce(finite(F.col("rating")), F.lit(False)))
    return Inputs(picked.select("*", all_of(tests).alias("__valid")), "user", "null or non-integer user, item or rating")


def _sums(data: DataSpec, with_label: bool) -> bool:
    setting = data.ratings or {}
    return with_label and setting.get("rating") is not None and bool(setting.get("aggregate"))


def _finished(rows: DataFrame, df: DataFrame, data: DataSpec, with_label: bool) -> DataFrame:
    """Checked inputs in the shape that models take."""
    if data.features and not data.ratings:
        return _as_vectors(rows, data, FeatureColumns(df, data.features).size)
    if _sums(data, with_label):
        # Summed map-side first: a very active user shuffles at most one row per
        # item and task, however many raw rows there are.
        return rows.groupBy("user", "item").agg(F.sum("rating").alias("rating"))
    return rows


def traced(df: DataFrame, data: DataSpec, source_type: str = "PARQUET", *, with_label: bool = True) -> tuple[DataFrame, DataFrame]:
    """All records in one table, good and rejected: model input beside ``__path, __text, __reason``; and the fields it came from.

    Derived columns, the filter and features are evaluated for good records only.
    """
    rows = judged(df, data, source_type, trace=True)
    good = F.col(REASON).isNull()
    if data.columns:
        rows = rows.withColumns({name: F.when(good, F.expr(sql)) for name, sql in data.columns.items()})
    if data.filter:
        rows = rows.where(~good | F.when(good, F.expr(data.filter)))
    if not (data.ratings or data.features):
        return (rows.select(*[quoted(c) for c in data.keep], PATH, TEXT, REASON) if data.keep else rows), rows
    rows_in, _, what = (_ratings if data.ratings else _labeled)(rows, data, with_label, good)
    reason = F.coalesce(F.col(REASON), F.when(~F.col("__valid"), F.lit(what)))
    return rows_in.withColumn(REASON, reason).drop("__valid"), rows


def rejected_records(df: DataFrame, data: DataSpec, source_type: str = "PARQUET", *, with_label: bool = True) -> DataFrame:
    """``path, text, reason`` of the records that cannot be used; ``path`` is null where no file is known."""
    rows, _ = traced(df, data, source_type, with_label=with_label)
    return _as_rejects(rows.where(F.col(REASON).isNotNull()))


def _as_rejects(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(PATH).alias("path"), F.col(TEXT).alias("text"), F.col(REASON).alias("reason"))


def divide(df: DataFrame, data: DataSpec, source_type: str = "PARQUET", *, with_label: bool = True) -> tuple[DataFrame, DataFrame]:
    """Model input of the good records, and the rejected ones: rows of one table that is written in a single parse.

    What reads the good ones again, such as an iterative fit, reads typed columns and does not parse anew. Only
    rejected records keep their path and text. A mark tells them apart and no folders do, as Spark would sort
    each task's rows to write those.
    """
    spark = df.sparkSession
    rows, fields = traced(df, data, source_type, with_label=with_label)
    path = working_path(spark, "parsed")
    rejected = F.col(REASON).isNotNull()
    rows = rows.withColumns({REJECTED: rejected, PATH: F.when(rejected, F.col(PATH)), TEXT: F.when(rejected, F.col(TEXT))})
    rows.write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    good = table.where(~F.col(REJECTED)).drop(REJECTED, PATH, TEXT, REASON)
    return _finished(good, fields, data, with_label), _as_rejects(table.where(REJECTED))


def apply_data_spec(
    df: DataFrame, data: DataSpec, source_type: str = "PARQUET", *, with_label: bool = True
) -> DataFrame:
    """Raw rows -> model input. ``with_label=False`` is the scoring side."""
    if data.onInvalid == "reject":
        good, rejected = divide(df, data, source_type, with_label=with_label)
        rejected.write.mode("overwrite").parquet(data.rejectPath)
        return good
    if data.schema or CORRUPT in df.columns:
        df = parse_records(df, data, source_type)
    elif source_type == "CSV":
        df = kept(sound_cells(df), data.onInvalid)
    if data.columns:
        df = df.withColumns({name: F.expr(sql) for name, sql in data.columns.items()})
    if data.filter:
        df = df.where(data.filter)
    if data.ratings or data.features:
        inputs = (_ratings if data.ratings else _labeled)(df, data, with_label)
        return _finished(_check_rows(inputs, data.onInvalid), df, data, with_label)
    return df.select(*[quoted(c) for c in data.keep]) if data.keep else df
