"""Every registered query against DuckDB on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from wattscope.plans import catalog, oracle

DATA = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = duck.execute(oracle.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = list(types)
    want = [tuple(dict(zip(order, r))[c] for c in columns) for r in cursor.fetchall()]
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
