"""The corpus pipeline: documents of a known language, without recurring lines, near copies or secrets, packed.

Each stage works on all documents that the one before it kept and returns the columns of
``documents``; the last returns the pieces of the packed sequences. Nulls, empty texts, repeated
rows, ties and more columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscore.llm import langid, line_dedup, near_dedup, packing, secret_scan
from trainscore.llm.queries import BYTE_RANKS, WORD_BPE
from trainscore.llm.tables import Scratch
from trainscore.storage import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns with another text, and its length where the table has one."""
    size = F.length(text).cast("long")
    changed = {"text": text, **({"n_chars": size} if "n_chars" in columns else {})}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told from the labelled ones; rejected ones go."""
    ship_package(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return langid.predict(rows, model, F.col("row")).filter("not rejected").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; so do documents that lose all."""
    rows, dropped, left = line_dedup.without_recurring(docs)
    some = rows.filter((F.col(dropped) == 0) | (F.trim(F.translate(left, "\n\r\t\x0b\f", "     ")) != ""))
    return with_text(some, docs.columns, F.col(left))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    ship_package(spark)
    return near_dedup.deduplicated(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are masked."""
    ship_package(spark)
    return with_text(secret_scan.redacted(docs, BYTE_RANKS), docs.columns, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents fill."""
    ship_package(spark)
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
