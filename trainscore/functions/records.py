"""Records and the verdict on them: one rule for JSON, delimited text and typed CSV.

A record is good if it has the shape of its schema: a JSON object of the schema's types, or as many cells as
fields, each empty or of its field's type; and if no floating-point value in it is NaN or infinite.
Missing fields, JSON nulls and empty cells are null values of a good record. The verdict covers
all fields, whether they are used later or not, and is there before any filter.

``judged`` adds it as ``__reason``, null for good records; ``kept`` drops the others or fails on
the first. With ``trace`` there are ``__path`` and ``__text``, what a rejected record is reported with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DataSpec

CORRUPT = "__corrupt"  # the text of a record that a reader could not parse
REASON, PATH, TEXT = "__reason", "__path", "__text"

# The text column each source type delivers.
RAW_COLUMN = {
    "TEXT": "value",
    "JSON": "content",
    "WHOLE": "content",
    "SEQUENCE": "value",
    "HADOOP": "value",
    "OBJECT": "value",
}

MALFORMED = "malformed record: "
LEAST_INT = -(2**31)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _sound(value: Column, kind: T.DataType) -> Column | None:
    """Null or without NaN and infinity, also inside arrays, maps and structures; None where there can be none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(finite(value), F.lit(True))
    if isinstance(kind, T.ArrayType) and _sound(value, kind.elementType) is not None:
        return F.coalesce(F.forall(value, lambda v: _sound(v, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType):
        return _sound(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        tests = [_sound(value[f.name], f.dataType) for f in kind]
        tests = [t for t in tests if t is not None]
        return all_of(tests) if tests else None
    return None


def _first_bad(record: T.StructType, good: dict[str, Column]) -> Column:
    """The reason that names the first field whose test fails, else null."""
    reason = F.lit(None).cast("string")
    for f in reversed(record.fields):
        if f.name in good:
            reason = F.when(~good[f.name], F.lit(f"{MALFORMED}bad value of {f.name}")).otherwise(reason)
    return reason


def _sound_fields(record: T.StructType) -> dict[str, Column]:
    tests = {f.name: _sound(F.col(quoted(f.name)), f.dataType) for f in record}
    return {name: test for name, test in tests.items() if test is not None}


def literal_regex(delimiter: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in delimiter)


def _delimited(df: DataFrame, others: list[str], text: Column, record: T.StructType, delimiter: str) -> DataFrame:
    parts = F.split(text, literal_regex(delimiter), -1)
    cells = [F.get(parts, F.lit(i)) for i in range(len(record))]
    fields = [cell.try_cast(f.dataType) for cell, f in zip(cells, record, strict=True)]
    good = {}
    for cell, fld, f in zip(cells, fields, record, strict=True):
        if not isinstance(f.dataType, T.StringType):
            usable = fld.isNotNull() & finite(fld) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else fld.isNotNull()
            good[f.name] = F.coalesce((cell == "") | usable, F.lit(False))
    count = F.size(parts)
    reason = (
        F.when(text.isNull(), F.lit(f"{MALFORMED}null"))
        .when(count != len(record), F.concat(F.lit(MALFORMED), count.cast("string"), F.lit(f" cells instead of {len(record)}")))
        .otherwise(_first_bad(record, good))
    )
    return df.select(*others, *[fld.alias(f.name) for fld, f in zip(fields, record, strict=True)], reason.alias(REASON))


def _json(df: DataFrame, others: list[str], text: Column, record: T.StructType, explode: bool) -> DataFrame:
    if explode:
        # One text per element, so that each has a verdict of its own; a document that is no array is one bad record.
        elements = F.from_json(text, "array<string>")
        df = df.select(*others, F.explode(F.when(elements.isNull(), F.array(text)).otherwise(elements)).alias("__element"))
        text = F.col("__element")
    with_corrupt = T.StructType([*record.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(text, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = df.select(*others, text.alias("__json"), parsed.alias("__record")).select(*others, "__json", "__record.*")
    is_object = F.coalesce(F.col("__json").rlike(r"^\s*\{"), F.lit(False))
    reason = (
        F.when(F.col("__json").isNull(), F.lit(f"{MALFORMED}null"))
        .when(~is_object | F.col(CORRUPT).isNotNull(), F.lit(f"{MALFORMED}no JSON object of the schema"))
        .otherwise(_first_bad(record, _sound_fields(record)))
    )
    return rows.select(*others, *[quoted(f.name) for f in record], reason.alias(REASON), "__json")


def csv_judged(df: DataFrame) -> DataFrame:
    """Rows that a typed CSV reader delivered with the text of malformed ones."""
    record = T.StructType([f for f in df.schema.fields if f.name != CORRUPT])
    typed = [quoted(f.name) for f in record if not isinstance(f.dataType, T.StringType)] or [quoted(record[0].name)]
    # Always true, but it makes the reader convert every typed cell.
    read = F.hash(*typed) >= F.lit(LEAST_INT)
    bad = F.col(CORRUPT).isNotNull() | ~read
    reason = F.when(bad, F.lit(f"{MALFORMED}bad cell, or too few or too many")).otherwise(_first_bad(record, _sound_fields(record)))
    return df.withColumn(REASON, reason)


def sound_cells(df: DataFrame) -> DataFrame:
    """Typed rows of any reader: those with NaN or infinity are malformed."""
    record = df.schema
    return df.withColumn(REASON, _first_bad(record, _sound_fields(record)))


def judged(df: DataFrame, data: DataSpec, source_type: str, *, trace: bool = False) -> DataFrame:
    """The record fields with the verdict on each record."""
    own = [PATH, TEXT] if trace else []
    if trace:
        path = F.col("path") if source_type in ("JSON", "WHOLE") and "path" in df.columns else F.nullif(F.input_file_name(), F.lit(""))
        df = df.withColumn(PATH, path)
    if not data.schema:
        if CORRUPT in df.columns:
            rows = csv_judged(df)
            text = F.coalesce(CORRUPT, F.to_csv(F.struct(*[quoted(c) for c in df.columns if c not in (CORRUPT, PATH)])))
            return (rows.withColumn(TEXT, text) if trace else rows).drop(CORRUPT)
        rows = sound_cells(df) if source_type == "CSV" else df.withColumn(REASON, F.lit(None).cast("string"))
        return rows.withColumn(TEXT, F.lit(None).cast("string")) if trace else rows

    column = data.column or RAW_COLUMN.get(source_type)
    if column is None:
        raise ValueError(f"dataParameter has a schema but {source_type} needs a column to apply it to")
    record = T.StructType.fromDDL(data.schema)
    text = F.col(quoted(column))
    if trace:
        df = df.withColumn(TEXT, text.cast("string"))
    others = [quoted(c) for c in df.columns if c != column and c not in own]
    if data.delimiter is not None:
        return _delimited(df, [*others, *own], text, record, data.delimiter)
    rows = _json(df, [*others, *own], text, record, data.explode)
    if trace and data.explode:
        rows = rows.withColumn(TEXT, F.coalesce("__json", F.lit("null")))
    return rows.drop("__json")


def kept(rows: DataFrame, on_invalid: str) -> DataFrame:
    """Good records; others are dropped (``skip``) or fail (``error``).

    The failure must come before any later filter. A projection with an expression that is not
    deterministic is evaluated for each row, and no filter is pushed below it.
    """
    good = F.col(REASON).isNull()
    if on_invalid == "skip":
        return rows.where(good).drop(REASON)
    always = F.monotonically_increasing_id() >= 0
    passed = F.when(good, always).otherwise(F.raise_error(F.col(REASON)).cast("boolean"))
    return rows.withColumn(REASON, passed).where(REASON).drop(REASON)
