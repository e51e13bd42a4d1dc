"""Every registered query against the SQL it must equal, values and types."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from workload import ORACLES, QUERIES


SPARK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(r[i]).__name__, r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.dtypes) == sorted((d[0], SPARK_TYPES[str(d[1])]) for d in expected.description)
    got, want = _rows(df.columns, df.collect()), _rows(columns, expected.fetchall())
    assert got == want, f"only ours: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"


def test_entry(spark):
    assert driver.entry(spark).count() == 1
