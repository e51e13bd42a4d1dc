"""The queries the engine is checked and timed with, one per piece of work.

Each query reads whole tables. Those that need files of another kind first write
the table in that form to a fresh folder on the shared storage and read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with the SQL that must agree with it."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


from . import sources, training, verifying, scoring  # noqa: E402,F401,I001
