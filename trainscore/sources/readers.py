"""Readers behind ``load_source``: a source setting in, a DataFrame out.

Column contract per type:

========  =================================================================
TEXT      ``value`` - one row per line
JSON      ``path, content`` - one row per file, parsed later by the data setting
WHOLE     ``path, content`` - one row per file, left as it is
CSV       the columns of the schema (or of the header, all strings)
PARQUET   the columns of the files
SEQUENCE  ``key, value`` of a Hadoop sequence file
HADOOP    ``key, value`` of any Hadoop input format, of the old or the new interface
OBJECT    the fields of the records, as named in the schema: pickled ones, or
          with the option ``serialization: java`` those of a JVM program
PLUGIN    the columns of a data source of one's own, a ``DataSource`` of
          ``pyspark.sql.datasource`` that ``inputFormat`` names as ``module.Class``
========  =================================================================

TEXT, JSON, WHOLE, CSV, PARQUET and key-value text are native scans. SEQUENCE and
other HADOOP input is turned into rows inside the JVM. OBJECT passes through Python
once per record: convert such data to Parquet when it is read more than once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import RDD, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from ..functions.records import CORRUPT, csv_judged, kept
from ..spec import SourceSpec

KEY_VALUE_INPUT_FORMAT = "org.apache.hadoop.mapred.KeyValueTextInputFormat"
TEXT_INPUT_FORMAT = "org.apache.hadoop.mapred.TextInputFormat"
NEW_TEXT_INPUT_FORMAT = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat"
NEW_API = "org.apache.hadoop.mapreduce.InputFormat"
LONG_WRITABLE = "org.apache.hadoop.io.LongWritable"
TEXT_WRITABLE = "org.apache.hadoop.io.Text"


def _text(spark: SparkSession, src: SourceSpec) -> DataFrame:
    return spark.read.options(**src.options).text(src.paths)


def _whole_files(spark: SparkSession, src: SourceSpec) -> DataFrame:
    files = spark.read.options(**src.options).text(src.paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _csv(spark: SparkSession, src: SourceSpec) -> DataFrame:
    # Without a schema the header names the columns and all stay strings:
    # type inference would read the whole source once more. With one, malformed rows
    # come with their text in a further column, unless ``mode`` says what to do with them.
    reader = spark.read.options(**{"header": "true", "columnPruning": "false", **src.options})
    if not src.schema:
        return reader.csv(src.paths)
    if "mode" in src.options:
        return reader.schema(src.schema).csv(src.paths)
    schema = T.StructType.fromDDL(src.schema).add(CORRUPT, T.StringType())
    return reader.option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(src.paths)


def _parquet(spark: SparkSession, src: SourceSpec) -> DataFrame:
    reader = spark.read.options(**src.options)
    return (reader.schema(src.schema) if src.schema else reader).parquet(*src.paths)


def _rows_in_jvm(spark: SparkSession, pairs: RDD, schema: str) -> DataFrame:
    """Pairs that a Hadoop reader delivers become rows without passing through a Python worker."""
    arrays = spark.sparkContext._jvm.SerDeUtil.toJavaArray(pairs._to_java_object_rdd())
    fields = T.StructType.fromDDL(schema)
    return DataFrame(spark._jsparkSession.applySchemaToPythonRDD(arrays.rdd(), fields.json()), spark)


def _sequence(spark: SparkSession, src: SourceSpec) -> DataFrame:
    pairs = spark.sparkContext.sequenceFile(src.source, src.keyClass, src.valueClass)
    return _rows_in_jvm(spark, pairs, src.schema or "key bigint, value string")


def _key_value_text(spark: SparkSession, src: SourceSpec) -> DataFrame:
    """Lines of key, tab, value by the text reader; without a tab the line is the key."""
    lines = spark.read.text(src.paths)
    tab = F.instr("value", "\t")
    key = F.when(tab > 0, F.substring(F.col("value"), F.lit(1), tab - 1)).otherwise(F.col("value"))
    value = F.when(tab > 0, F.substring(F.col("value"), tab + 1, F.length("value"))).otherwise(F.lit(""))
    return lines.select(key.alias("key"), value.alias("value"))


def _hadoop(spark: SparkSession, src: SourceSpec) -> DataFrame:
    input_format = src.inputFormat or TEXT_INPUT_FORMAT
    plain = not (src.options or src.keyClass or src.valueClass or src.schema)
    if input_format == KEY_VALUE_INPUT_FORMAT and plain:
        return _key_value_text(spark, src)
    is_text = input_format in (TEXT_INPUT_FORMAT, NEW_TEXT_INPUT_FORMAT)
    sc = spark.sparkContext
    read = sc.newAPIHadoopFile if _is_new_api(spark, input_format) else sc.hadoopFile
    pairs = read(
        src.source,
        input_format,
        src.keyClass or (LONG_WRITABLE if is_text else TEXT_WRITABLE),
        src.valueClass or TEXT_WRITABLE,
        conf=src.options or None,
    )
    return _rows_in_jvm(spark, pairs, src.schema or ("key bigint, value string" if is_text else "key string, value string"))


def _is_new_api(spark: SparkSession, input_format: str) -> bool:
    """Whether the class is an input format of Hadoop's newer interface; only looked up, not run."""
    loader = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    try:
        return loader.loadClass(NEW_API).isAssignableFrom(loader.loadClass(input_format))
    except Py4JJavaError:
        raise ValueError(f"Unknown input format:{input_format}") from None


def _pickled(spark: SparkSession, src: SourceSpec) -> DataFrame:
    # Unpickling, like reading serialised JVM objects, runs code: read trusted paths only.
    if not src.schema:
        raise ValueError("OBJECT sources need a schema")
    serialization = src.options.get("serialization", "python")
    if serialization == "java":
        return _java_objects(spark, src)
    if serialization != "python":
        raise ValueError(f"Unsupported serialization of objects:{serialization}")
    return spark.sparkContext.pickleFile(src.source).toDF(src.schema)


def _java_objects(spark: SparkSession, src: SourceSpec) -> DataFrame:
    """Records that a JVM program saved as an object file: maps by field name, tuples, lists, single values."""
    sc = spark.sparkContext
    records = RDD(sc._jvm.SerDeUtil.javaToPython(sc._jsc.objectFile(src.source)), sc)
    schema = T.StructType.fromDDL(src.schema)
    names = schema.fieldNames()

    def row(record: Any) -> tuple:
        if isinstance(record, dict):
            if "__class__" in record:
                raise ValueError(f"records of {record['__class__']} cannot be read: save maps, tuples or plain values")
            return tuple(record.get(name) for name in names)
        if isinstance(record, (list, tuple)):
            return tuple(record)
        if len(names) == 1:
            return (record,)
        raise ValueError(f"a record of {type(record).__name__} has no fields for {', '.join(names)}")

    return records.map(row).toDF(schema)


def registered_source(spark: SparkSession, dotted: str) -> str:
    """Make a ``DataSource`` class known to the session; returns the name of its format."""
    from ..plugins import import_class

    found = import_class(dotted, DataSource)
    # The driver's process that plans a stream does not get files that were added: the class travels whole.
    cloudpickle.register_pickle_by_value(sys.modules[found.__module__])
    # Spark refuses a name that the thread's active session has, if that is another one. ``createDataFrame`` makes its session active.
    before = SparkSession.getActiveSession()
    spark.createDataFrame([], "none int")
    try:
        spark.dataSource.register(found)
    finally:
        if before is not None:
            before.createDataFrame([], "none int")
    return found.name()


def _plugin(spark: SparkSession, src: SourceSpec) -> DataFrame:
    if not src.inputFormat:
        raise ValueError("PLUGIN sources need an inputFormat, the module.Class of the data source")
    reader = spark.read.format(registered_source(spark, src.inputFormat)).options(**src.options)
    return (reader.schema(src.schema) if src.schema else reader).load(src.source)


_READERS: dict[str, Callable[[SparkSession, SourceSpec], DataFrame]] = {
    "TEXT": _text,
    "JSON": _whole_files,
    "WHOLE": _whole_files,
    "CSV": _csv,
    "PARQUET": _parquet,
    "SEQUENCE": _sequence,
    "HADOOP": _hadoop,
    "OBJECT": _pickled,
    "PLUGIN": _plugin,
}


def load_source(spark: SparkSession, source: SourceSpec | dict[str, Any] | str, *, verdicts: bool = False) -> DataFrame:
    """Read ``source`` as a DataFrame; nothing but metadata is read here.

    A malformed row of a typed CSV fails. With ``verdicts`` its text stands in the column
    ``__corrupt`` instead, for ``apply_data_spec`` to decide by ``onInvalid``.
    """
    src = SourceSpec.parse(source)
    rows = _READERS[src.type](spark, src)
    if CORRUPT in rows.columns and not verdicts:
        return kept(csv_judged(rows), "error").drop(CORRUPT)
    return rows
