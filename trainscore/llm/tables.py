"""Intermediate tables on the shared storage, and connected components over them."""

from __future__ import annotations

import atexit

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_path, fresh_path


class Scratch:
    """Written tables of one job: they cut lineage and outlive the loss of an executor.

    Each is a folder under the cluster's shared folder, removed by ``drop`` or, for those
    that a returned result still reads, when the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        atexit.register(self._clear)

    def keep(self, rows: DataFrame, purpose: str) -> DataFrame:
        path = fresh_path(self.spark, purpose)
        rows.write.parquet(path)
        table = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if id(table) in self.paths:
                delete_path(self.spark, self.paths.pop(id(table))[0])

    def _clear(self) -> None:
        try:
            for path, _ in self.paths.values():
                delete_path(self.spark, path)
        except (Py4JError, PySparkException, OSError, AttributeError):
            pass  # the session is gone; the cluster's own cleaning remains


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, root``: for each node of the edges ``a, b`` the least node it is joined with.

    Alternating large-star and small-star steps, each a pre-aggregated minimum and a join,
    written between rounds; the rounds grow with the logarithm of the longest path.
    """
    pairs = edges.filter(F.col("a") != F.col("b"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = scratch.keep(pairs, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == state or not state["n"]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.keep(small, "edges")
        scratch.drop(now)
        now = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
