"""Reading every source type, and parsing into model input."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscore import load_source
from trainscore.functions import apply_data_spec, divide
from trainscore.operators.estimators import MLAlgorithm, find_estimator
from trainscore.plugins import Parameter
from trainscore.spec import DataSpec, SourceSpec
from trainscore.storage import fresh_path

from . import query
from .common import parquet_source, ratings, table

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMERS_PER_DOCUMENT = 1000


@query("SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEXT: the documents written as text, read back line by line."""
    path = fresh_path(spark, "text")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return load_source(spark, {"source": path, "type": "text"})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON: files that each hold one JSON array, parsed into one row per element."""
    path = fresh_path(spark, "json")
    # Documents of at most 1,000 customers by construction, one per file.
    document = F.expr(f"monotonically_increasing_id() div {CUSTOMERS_PER_DOCUMENT}")
    (
        table(spark, sf_dir, "customer")
        .select(document.alias("document"), F.struct("c_custkey", "c_name", "c_acctbal").alias("customer"))
        .groupBy("document")
        .agg(F.to_json(F.collect_list("customer")).alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    data = {"schema": "c_custkey bigint, c_name string, c_acctbal double", "explode": True}
    raw = load_source(spark, {"source": path, "type": "json"})
    return apply_data_spec(raw, DataSpec.parse(data), "JSON").drop("path")


@query(
    """SELECT CAST(sum(length(text) + 1) AS BIGINT) AS n_chars,
              CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines,
              TRUE AS has_paths
       FROM documents"""
)
def source_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WHOLE: the same files as (path, content), measured."""
    path = fresh_path(spark, "whole")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    files = load_source(spark, {"source": path, "type": "whole"})
    return files.agg(
        F.sum(F.length("content")).alias("n_chars"),
        F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).alias("n_lines"),
        F.every(F.col("path").contains(path)).alias("has_paths"),
    )


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    table(spark, sf_dir, "customer").write.option("header", "true").csv(path)
    return load_source(spark, {"source": path, "type": "csv", "schema": CUSTOMER})


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def source_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "sequence")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").rdd.map(tuple).saveAsSequenceFile(path)
    return load_source(spark, {"source": path, "type": "sequence"})


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def source_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "object")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").rdd.map(tuple).saveAsPickleFile(path)
    return load_source(spark, {"source": path, "type": "object", "schema": "key bigint, value string"})


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def source_hadoop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HADOOP: tab-separated pairs through another input format."""
    path = fresh_path(spark, "hadoop")
    table(spark, sf_dir, "customer").select(F.concat_ws("\t", "c_custkey", "c_name")).write.text(path)
    input_format = "org.apache.hadoop.mapred.KeyValueTextInputFormat"
    return load_source(spark, {"source": path, "type": "hadoop", "inputFormat": input_format})


@query("SELECT c_name AS value FROM customer")
def source_hadoop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HADOOP: lines through the default input format, without their offsets."""
    path = fresh_path(spark, "hadoop")
    table(spark, sf_dir, "customer").select("c_name").write.text(path)
    return load_source(spark, {"source": path, "type": "hadoop"}).select("value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def source_hadoop_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HADOOP: pairs with another separator through an input format of the newer interface."""
    path = fresh_path(spark, "hadoop")
    table(spark, sf_dir, "customer").select(F.concat_ws("|", "c_custkey", "c_name")).write.text(path)
    input_format = "org.apache.hadoop.mapreduce.lib.input.KeyValueTextInputFormat"
    options = {"mapreduce.input.keyvaluelinerecordreader.key.value.separator": "|"}
    return load_source(spark, {"source": path, "type": "hadoop", "inputFormat": input_format, "options": options})


class PartLines(MLAlgorithm):
    """A plugin whose loader joins two tables."""

    def load(self, spark: SparkSession, source: SourceSpec) -> DataFrame:
        lines = load_source(spark, parquet_source(source.source, "lineitem"))
        parts = load_source(spark, parquet_source(source.source, "part"))
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, p_brand, p_size
       FROM lineitem JOIN part ON l_partkey = p_partkey"""
)
def source_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    plugin = PartLines(find_estimator("LinearRegression"))
    raw = plugin.load(spark, SourceSpec.parse({"source": sf_dir, "type": "parquet"}))
    data = Parameter()
    data.values = {"keep": ["l_orderkey", "l_linenumber", "l_quantity", "p_brand", "p_size"]}
    return plugin.parse(raw, data, "PARQUET")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice
       FROM lineitem WHERE l_quantity >= 10 AND l_returnflag <> 'R'"""
)
def parse_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text lines to typed fields, with a filter on them."""
    path = fresh_path(spark, "delimited")
    fields = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    table(spark, sf_dir, "lineitem").select(F.concat_ws("|", *fields)).write.text(path)
    data = {
        "schema": "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, flag string",
        "delimiter": "|",
        "filter": "l_quantity >= 10 AND flag <> 'R'",
        "keep": ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
    }
    raw = load_source(spark, {"source": path, "type": "text"})
    return apply_data_spec(raw, DataSpec.parse(data), "TEXT")


@query(
    """SELECT CAST(o_custkey AS INTEGER) AS "user", CAST(l_partkey AS INTEGER) AS item, sum(l_quantity) AS rating
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"""
)
def parse_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir)


@query(
    """SELECT vec_id, CAST(label AS DOUBLE) AS label, CAST(len(embedding) AS INTEGER) AS size,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
       FROM embeddings"""
)
def parse_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = {"label": "label", "features": ["embedding"], "keep": ["vec_id"]}
    rows = apply_data_spec(table(spark, sf_dir, "embeddings"), DataSpec.parse(data))
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("vec_id", "label", F.size(values).alias("size"), F.round(total, 4).alias("total"))


# Every 100th line is broken, in four ways by turns.
LINE = "(l_orderkey * 10 + l_linenumber)"
BROKEN_FIELDS = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, flag string"
WHOLE_LINES = f"""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice
       FROM lineitem WHERE {LINE} % 100 <> 0 AND l_quantity >= 10"""


def _broken_lines(spark: SparkSession, sf_dir: str, delimiter: str) -> str:
    path = fresh_path(spark, "broken")
    way = F.expr(f"{LINE} % 400")
    quantity = F.when(way == 0, F.lit("bad")).otherwise(F.col("l_quantity").cast("string"))
    price = F.when(way == 100, F.lit("NaN")).otherwise(F.col("l_extendedprice").cast("string"))
    line = F.concat_ws(delimiter, "l_orderkey", "l_linenumber", quantity, price, "l_returnflag")
    short = F.concat_ws(delimiter, "l_orderkey", "l_linenumber", quantity, price)
    line = F.when(way == 200, short).when(way == 300, F.concat(line, F.lit(f"{delimiter}more"))).otherwise(line)
    table(spark, sf_dir, "lineitem").select(line).write.text(path)
    return path


@query(WHOLE_LINES)
def parse_delimited_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited lines with a bad cell, a missing one, one too many, or NaN are left out, and only they."""
    raw = load_source(spark, {"source": _broken_lines(spark, sf_dir, "|"), "type": "text"})
    data = {
        "schema": BROKEN_FIELDS,
        "delimiter": "|",
        "filter": "l_quantity >= 10",
        "keep": ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
        "onInvalid": "skip",
    }
    return apply_data_spec(raw, DataSpec.parse(data), "TEXT")


@query(WHOLE_LINES)
def source_csv_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a CSV source that leaves malformed rows out."""
    source = {"source": _broken_lines(spark, sf_dir, ","), "type": "csv", "schema": BROKEN_FIELDS}
    raw = load_source(spark, {**source, "options": {"header": "false", "mode": "DROPMALFORMED"}})
    keep = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return apply_data_spec(raw, DataSpec.parse({"filter": "l_quantity >= 10", "keep": keep, "onInvalid": "skip"}), "CSV")


# The same lines in three forms, with whole quantities; every 100th is broken, in four ways by turns.
RECORD = "l_orderkey bigint, l_linenumber int, l_quantity double"
FORMS = ("json", "delimited", "csv")


def _broken_records(spark: SparkSession, sf_dir: str, form: str) -> tuple[DataFrame, dict, str]:
    """The records as a source reads them, the setting that parses them, and the source's type."""
    path = fresh_path(spark, form)
    way = F.expr(f"{LINE} % 400")
    quantity = F.col("l_quantity").cast("int").cast("string")
    if form == "json":
        quantity = F.when(way == 0, F.lit('"bad"')).when(way == 100, F.lit("NaN")).otherwise(quantity)
        line = F.format_string('{"l_orderkey": %s, "l_linenumber": %s, "l_quantity": %s', "l_orderkey", "l_linenumber", quantity)
        line = F.when(way == 200, line).when(way == 300, F.lit("null")).otherwise(F.concat(line, F.lit("}")))
    else:
        delimiter = "|" if form == "delimited" else ","
        quantity = F.when(way == 0, F.lit("bad")).when(way == 100, F.lit("NaN")).otherwise(quantity)
        short = F.concat_ws(delimiter, "l_orderkey", "l_linenumber")
        line = F.concat_ws(delimiter, short, quantity)
        line = F.when(way == 200, short).when(way == 300, F.concat(line, F.lit(f"{delimiter}more"))).otherwise(line)
    table(spark, sf_dir, "lineitem").select(line).write.text(path)
    if form == "csv":
        source = {"source": path, "type": "csv", "schema": RECORD, "options": {"header": "false"}}
        return load_source(spark, source, verdicts=True), {}, "CSV"
    setting = {"schema": RECORD, **({"delimiter": "|"} if form == "delimited" else {})}
    return load_source(spark, {"source": path, "type": "text"}), setting, "TEXT"


@query(f"SELECT l_orderkey, l_linenumber, floor(l_quantity) AS l_quantity FROM lineitem WHERE {LINE} % 100 <> 0 AND floor(l_quantity) >= 10")
def parse_json_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records of the wrong type, with NaN, cut off, or null are left out, and only they."""
    raw, setting, kind = _broken_records(spark, sf_dir, "json")
    return apply_data_spec(raw, DataSpec.parse({**setting, "filter": "l_quantity >= 10", "onInvalid": "skip"}), kind)


@query(
    f"""WITH lines AS (
          SELECT {LINE} % 400 AS way, CAST(l_orderkey AS VARCHAR) AS k, CAST(l_linenumber AS VARCHAR) AS n,
                 CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) AS q FROM lineitem WHERE {LINE} % 100 = 0
        ), json AS (
          SELECT 'json' AS form, way,
                 CASE WHEN way = 300 THEN 'null' ELSE
                   '{{"l_orderkey": ' || k || ', "l_linenumber": ' || n || ', "l_quantity": ' ||
                   CASE way WHEN 0 THEN '"bad"' WHEN 100 THEN 'NaN' ELSE q END || CASE WHEN way = 200 THEN '' ELSE '}}' END END AS text,
                 CASE WHEN way = 100 THEN 'bad value of l_quantity' ELSE 'no JSON object of the schema' END AS reason FROM lines
        ), cells AS (
          SELECT form, way, k || d || n || CASE way WHEN 0 THEN d || 'bad' WHEN 100 THEN d || 'NaN' WHEN 200 THEN '' ELSE d || q || d || 'more' END AS text,
                 CASE WHEN way = 100 OR (way = 0 AND d = '|') THEN 'bad value of l_quantity' WHEN d = ',' THEN 'bad cell, or too few or too many'
                      WHEN way = 200 THEN '2 cells instead of 3' ELSE '4 cells instead of 3' END AS reason
          FROM lines, (VALUES ('delimited', '|'), ('csv', ',')) AS forms(form, d)
        )
        SELECT form, text, 'malformed record: ' || reason AS reason, TRUE AS has_path FROM json
        UNION ALL SELECT form, text, 'malformed record: ' || reason, TRUE FROM cells
        UNION ALL SELECT form, CAST(count(*) AS VARCHAR), 'good', TRUE FROM lineitem, (VALUES ('json'), ('delimited'), ('csv')) AS forms(form)
                  WHERE {LINE} % 100 <> 0 GROUP BY form"""
)
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parse of each form yields the good records and those rejected, with file, text and reason."""
    parts = []
    for form in FORMS:
        raw, setting, kind = _broken_records(spark, sf_dir, form)
        good, rejected = divide(raw, DataSpec.parse(setting), kind)
        has_path = F.coalesce(F.col("path").contains(f"/{form}-"), F.lit(False)).alias("has_path")
        parts.append(rejected.select(F.lit(form).alias("form"), "text", "reason", has_path))
        parts.append(good.agg(F.count("*").cast("string").alias("text")).select(F.lit(form).alias("form"), "text", F.lit("good").alias("reason"), F.lit(True).alias("has_path")))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def source_object_jvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBJECT: rows that the JVM serialised, as maps."""
    path = fresh_path(spark, "object")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name").rdd.map(lambda r: {"key": r[0], "value": r[1]})
    rows._to_java_object_rdd().saveAsObjectFile(path)
    options = {"serialization": "java"}
    return load_source(spark, {"source": path, "type": "object", "schema": "key bigint, value string", "options": options})
